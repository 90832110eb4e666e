"""Trees of web pages in one pass: elements in page order with parent, attribute words and text, also for broken markup.

Time is linear in the page: open elements are looked up by tag, and every element is opened and closed once.
"""

from __future__ import annotations

import html
import re

# fixed values of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
                  "head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - frozenset("body caption head html legend noscript optgroup option tbody td tfoot th thead tr".split())
# a start tag closes an open element of the first set unless one of the second was opened since
CLOSES = {
    **{t: (("p",), ("td", "th", "table", "caption", "button", "object")) for t in ENDS_P},
    "li": (("li", "p"), ("ul", "ol", "menu", "dir", "td", "th", "table")),
    "dt": (("dt", "dd"), ("dl", "table")), "dd": (("dt", "dd"), ("dl", "table")),
    "tr": (("tr", "caption"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    **{t: (("thead", "tbody", "tfoot", "caption"), ("table",)) for t in ("thead", "tbody", "tfoot")},
    "option": (("option",), ("select", "datalist")), "optgroup": (("optgroup", "option"), ("select",)), "body": (("head",), ()),
}
OUTER = frozenset("table tbody thead tfoot tr td th body html".split())
# no text of these is ever page text
HIDDEN = frozenset("head script style title textarea template iframe noembed noframes svg math select datalist button canvas audio video object".split())

TAG = re.compile(r"<([a-zA-Z][^\s/>]*)((?:[\s/]+|[^\s/>=]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?|=)*+)>")
ATTR = re.compile(r"([^\s/>=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))")
END = re.compile(r"</([a-zA-Z][^\s/>]*)")
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
READ = {"class", "id", "role", "itemprop", "data-label"}
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def attribute_words(values: list[str]) -> list[str]:
    """Lower-case words of class names and ids, without plural s: siteHeader, comment-list -> site, header, comment, list."""
    found = {w.lower() for v in values for w in WORDS.findall(v)}
    return sorted({w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w for w in found})


class Page:
    """Elements in page order (0 is the page itself), and text pieces as (element, run, text); a block's text is one run."""

    def __init__(self):
        self.tag, self.parent, self.depth, self.words, self.label = ["#page"], [-1], [0], [[]], [""]
        self.pieces: list[tuple[int, int, str]] = []

    def add(self, tag: str, parent: int, words: list[str], label: str) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.words.append(words)
        self.label.append(label)
        return len(self.tag) - 1


class _Open:
    """The stack of open elements with, per tag, the places of its open elements."""

    def __init__(self, page: Page):
        self.page, self.nodes, self.at, self.blocks, self.hidden = page, [0], {}, [0], 0

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def push(self, node: int, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.nodes))
        if tag in BLOCK:
            self.blocks.append(len(self.nodes))
        self.hidden += tag in HIDDEN
        self.nodes.append(node)

    def cut(self, place: int) -> bool:
        """Closes the element at a place of the stack and all in it; true if one was a block."""
        block = False
        while len(self.nodes) > place:
            tag = self.page.tag[self.nodes.pop()]
            self.at[tag].pop()
            self.hidden -= tag in HIDDEN
            if tag in BLOCK:
                self.blocks.pop()
                block = True
        return block


def parse(source: str) -> Page:
    page = Page()
    up, run, pos, end = _Open(page), 0, 0, len(source)
    while pos < end:
        at = source.find("<", pos)
        if at != pos:
            piece = source[pos : at if at >= 0 else end]
            if not up.hidden:
                page.pieces.append((up.nodes[-1], run, html.unescape(piece) if "&" in piece else piece))
            if at < 0:
                break
        after = source[at + 1 : at + 2]
        if after in "!?" and after:
            close = source.find("-->", at + 2) if source.startswith("<!--", at) else source.find(">", at)
            if close < 0:
                break
            pos = close + (3 if source.startswith("<!--", at) else 1)
        elif after == "/":
            found = END.match(source, at)
            close = source.find(">", at)
            if close < 0:
                break
            pos = close + 1
            if found:
                tag = found[1].lower()
                place = up.last((tag,))
                # an inline end tag does not reach over a block, nor that of a block over a table
                bound = up.blocks[-1] if tag not in BLOCK else -1 if tag in OUTER else up.last(("td", "th", "table"))
                if place > bound:
                    run += up.cut(place)
        else:
            found = TAG.match(source, at)
            if not found:
                if after.isascii() and after.isalpha() and source.find(">", at) < 0:
                    break  # the page ends inside a tag
                if not up.hidden:
                    page.pieces.append((up.nodes[-1], run, "<"))
                pos = at + 1
                continue
            pos, tag = found.end(), found[1].lower()
            if tag in CLOSES:
                these, bounds = CLOSES[tag]
                place = up.last(these)
                while place >= 0 and place > up.last(bounds):
                    up.cut(place)
                    place = up.last(these)
            run += tag in BLOCK
            if tag == "br" and not up.hidden:
                page.pieces.append((up.nodes[-1], run, " "))
            if tag in VOID:
                continue
            values, label = [], ""
            if "=" in found[2]:
                for name, a, b, c in ATTR.findall(found[2]):
                    name = name.lower()
                    if name == "data-label":
                        label = a or b or c
                    elif name in READ:
                        values.append(a or b or c)
            node = page.add(tag, up.nodes[-1], attribute_words(values) if values else [], label)
            if tag in RAW:
                stop = RAW_END[tag].search(source, pos)
                close = source.find(">", stop.end()) if stop else -1
                if close < 0:
                    break
                pos = close + 1
            elif not (found[2].endswith("/") and (up.at.get("svg") or up.at.get("math"))):
                up.push(node, tag)
    return page
