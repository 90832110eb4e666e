"""Listing cards and named parts of HTML pages, cut in one pass over the markup with a stack of open tags.

An element is a range of the page's elements and a range of its text pieces, so cutting takes time in proportion to the page
however many cards it holds, and a card's parts are looked for in its own range only. Selectors are `tag`, `.class`, `tag.class`,
`#id`, `[name=value]`, `[name*=part]` (case as written) and `~pattern` (class name, any case); the first alternative that is on
the page, or in the card, wins.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import lru_cache
from html import unescape
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# a comment, a tag, a tag whose quotes do not close (it ends at the next bracket), or the start of a tag that never ends
MARK = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9-]*)(?:((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>|([^>]*)>)|(?=/?[a-zA-Z]))")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SKIPPED = re.compile(r"</(?:script|style)\s*>", re.I)
KNOWN, SHORT = 4096, 256  # so many tags as written, up to so long, whose reading is kept; pages of a site repeat the same few


class Page:
    def __init__(self, html: str, selectors: list[str] = (), known: dict | None = None, around: list[str] = ()):
        """`places[s]` are the elements that fit a selector, in page order; `known` keeps tags that were read before; `near[i]` is
        the nearest element of the first kind of `around` that encloses the link i, or the link itself. Elements that fit no
        selector and are of no such kind are followed to their end, but not kept."""
        self.attributes, self.ends, self.texts, self.text_from, self.text_to = [], [], [], [], []
        self.places: dict[str, list[int]] = {s: [] for s in selectors}
        self.near: dict[int, int] = {}
        known = {} if known is None else known
        every, ends, texts, text_from, text_to, places = self.attributes, self.ends, self.texts, self.text_from, self.text_to, self.places
        # at: the end of the last mark; seen: from where the next bracket is looked for, which may be later as "<" is text too;
        # opened and nodes: tag and number (-1: not kept) of the open elements; by_tag: their places by tag
        opened, nodes, at, seen, by_tag, find, closes, size = [], [], 0, 0, {}, html.find, 0, len(html)
        while at < size:
            start = find("<", seen)
            read = found = None
            if start >= 0:
                if 0 <= closes <= start:
                    closes = find(">", start)
                written = html[start : closes + 1] if 0 <= closes < start + SHORT else ""
                # a kept tag reads the same wherever it stands: it ends at its first bracket and its quotes close before
                read = known.get(written)
                if read is None:
                    name = written[2:-1]
                    if written[1:2] == "/" and name.isascii() and name.isalnum() and name[0].isalpha():
                        read = name.lower(), None, ()  # a closing tag
                    else:
                        found = MARK.match(html, start)
                        if not found:
                            seen = start + 1
                            continue
            if opened and (start > at or start < 0):
                text = (html[at:start] if start >= 0 else html[at:]).strip()
                if text:
                    texts.append(unescape(text).strip() if "&" in text else text)
            if start < 0:
                break
            if found:
                at = seen = found.end()
                comment, closing, name, quoted, other = found.groups()
                if comment:
                    end = find("-->", at)
                    at = seen = end + 3 if end >= 0 else size
                    continue
                if name is None:
                    break
                if closing:
                    read = name.lower(), None, ()
                else:
                    read = _read(name.lower(), other if quoted is None else quoted, selectors)
                    if quoted is not None and found[0] == written:
                        if len(known) >= KNOWN:
                            known.clear()
                        known[written] = read
            else:
                at = seen = closes + 1
            name, attributes, fits = read
            if attributes is None:
                if by_tag.get(name):
                    place = by_tag[name][-1]
                    for k in range(len(opened) - 1, place - 1, -1):
                        by_tag[opened[k]].pop()
                        if nodes[k] >= 0:
                            ends[nodes[k]], text_to[nodes[k]] = len(every), len(texts)
                    del opened[place:], nodes[place:]
                continue
            node = -1
            if fits or name in around:
                node = len(every)
                every.append(attributes)
                for s in fits:
                    places[s].append(node)
                text_from.append(len(texts))
                text_to.append(len(texts))
                ends.append(node + 1)
                if around and name == "a":
                    self.near[node] = next((nodes[by_tag[kind][-1]] for kind in around if by_tag.get(kind)), node)
            if name in ("script", "style"):
                end = SKIPPED.search(html, at)
                at = seen = end.end() if end else size
            elif name not in VOID:
                if name in by_tag:
                    by_tag[name].append(len(opened))
                else:
                    by_tag[name] = [len(opened)]
                opened.append(name)
                nodes.append(node)
        for node in nodes:
            if node >= 0:
                ends[node], text_to[node] = len(every), len(texts)

    def text(self, node: int, between: str = "") -> str:
        return between.join(self.texts[self.text_from[node] : self.text_to[node]])


def _read(name: str, text: str, selectors) -> tuple[str, dict, list[str]]:
    """Tag, attributes and the selectors that fit."""
    attributes = {k.lower(): unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(text)} if text.strip(" /") else {}
    return name, attributes, [s for s in selectors if _test(s)(name, attributes)]


@lru_cache(maxsize=None)
def _test(selector: str):
    """One selector as a function of tag and attributes."""
    if selector.startswith("~"):
        pattern = re.compile(selector[1:], re.I)
        return lambda tag, a: any(pattern.search(x) for x in a.get("class", "").split())
    if selector.startswith("["):
        name, part, value = re.match(r"\[([\w-]+)(\*?)=(.*)\]$", selector).groups()
        return (lambda tag, a: value in a.get(name, "")) if part else (lambda tag, a: a.get(name) == value)
    if selector.startswith("#"):
        return lambda tag, a: a.get("id") == selector[1:]
    tag, _, cls = selector.partition(".")
    return lambda t, a: (not tag or t == tag) and (not cls or cls in a.get("class", "").split())


class Rule:
    """Selectors of a profile, compiled; picklable, so it travels with the job."""

    def __init__(self, cards: list[str], parts: dict[str, list[str]], link: str = "", around: list[str] | None = None, skip: str = "", most: int | None = None):
        self.cards, self.parts, self.link, self.around, self.skip, self.most = cards, parts, link, around or [], skip, most

    def selectors(self) -> list[str]:
        return list(dict.fromkeys([*self.cards, *(s for some in self.parts.values() for s in some), "a", "img"]))

    def cut(self, html: str | None, known: dict | None = None) -> list[dict]:
        # a page without the fixed text of its cards is not read further
        if not html or (self.skip and self.skip not in html):
            return []
        page = Page(html, self.selectors(), known, self.around if self.link else ())
        if self.link:
            roots = self._linked(page)
        else:
            some = next((r for s in self.cards if (r := page.places[s])), [])
            roots = [(r, None) for r in some]
        where: dict[str, list[list[int]]] = {name: [page.places[s] for s in selectors] for name, selectors in self.parts.items()}
        images = page.places["img"]
        links = [i for i in page.places["a"] if page.attributes[i].get("href")]
        return [self._record(page, root, link, where, links, images) for root, link in roots[: self.most]]

    def _linked(self, page: Page) -> list[tuple[int, int]]:
        """Nearest enclosing element of a kind around the first link of every number, and the link."""
        pattern, seen, out = re.compile(self.link), set(), []
        for i in page.places["a"]:
            found = pattern.search(page.attributes[i].get("href") or "")
            if found and found[1] not in seen:
                seen.add(found[1])
                out.append((page.near[i], i))
        return out

    @staticmethod
    def _within(places: list[int], page: Page, root: int) -> list[int]:
        return places[bisect_left(places, root) : bisect_left(places, page.ends[root])]

    def _record(self, page: Page, root: int, link: int | None, where, links: list[int], images: list[int]) -> dict:
        own = self._within(links, page, root)
        link = own[0] if link is None and own else link
        parts = {}
        for name, found in where.items():
            for places in found:
                inside = [i for i in self._within(places, page, root) if i != root or name == "self"]
                if inside:
                    many = name.endswith("s")  # a plural part is the text of all such elements
                    parts[name] = " ".join(page.text(i) for i in inside) if many else page.text(inside[0])
                    break
        a = page.attributes
        return {"href": a[link].get("href") if link is not None else None, "link_title": a[link].get("title") if link is not None else None,
                "texts": page.texts[page.text_from[root] : page.text_to[root]], "parts": parts, "images": [a[i] for i in self._within(images, page, root)]}


def cut(html: Column, rule: Rule, images: list[str], texts: bool = False, first_image: bool = False) -> Column:
    """Array of cards of every page, in page order: struct of href, link_title, text (the card's texts joined by spaces), parts (a
    struct, NULL where the card has none) and images, each a struct of the attributes asked for; with `texts` also the
    list of texts, with `first_image` no image but the first."""
    names, some = list(rule.parts), 1 if first_image else None
    fields = [("href", T.StringType()), ("link_title", T.StringType()), ("text", T.StringType()),
              *([("texts", T.ArrayType(T.StringType()))] if texts else []), ("parts", _strings(names)), ("images", T.ArrayType(_strings(images)))]

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(*f) for f in fields])))
    def run(pages: pa.Array) -> pa.Array:
        known: dict = {}
        found = [rule.cut(html, known) for html in pages.to_pylist()]
        cards = [card for page in found for card in page]
        shown = [card["images"][:some] for card in cards]
        arrays = [pa.array([card[k] for card in cards], pa.string()) for k in ("href", "link_title")]
        arrays.append(pa.array([" ".join(card["texts"]) for card in cards], pa.string()))
        if texts:
            arrays.append(pa.array([card["texts"] for card in cards], pa.list_(pa.string())))
        arrays.append(_columns([card["parts"] for card in cards], names))
        arrays.append(pa.ListArray.from_arrays(_offsets(shown), _columns([image for some in shown for image in some], images)))
        return pa.ListArray.from_arrays(_offsets(found), pa.StructArray.from_arrays(arrays, [name for name, _ in fields]))

    return run(html)


def _strings(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


def _columns(rows: list[dict], names: list[str]) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array([row.get(name) for row in rows], pa.string()) for name in names], names)


def _offsets(lists: list[list]) -> pa.Array:
    return pa.array(list(accumulate(map(len, lists), initial=0)), pa.int32())
