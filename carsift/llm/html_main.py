"""Main text of web pages by a graphical model on the tree of elements.

Every element belongs to the frame of the page, to its main text, to a part of links (menu, share bar) or
to a part that talks (advert, notice, comments). A node's own evidence (tag, words of its class and id, amount of text, share of links,
sentence ends, place in the page) and the tie to its parent (one table for blocks, one for inline elements) are potentials learned
by counting labelled pages. Sum-product messages go up and down the tree once and give every element its exact marginal; text
whose innermost element is more likely main than not is kept. Scripts, styles and other elements without page text are left
out by the parser.

Labelled pages are those of `layouts` and, from the table itself, pages that mark their article (one `article` or `main`
element), fitted with the mark as it is and with the mark hidden, so that the model does not rest on it. Counting is one Spark
aggregation over a bounded sample (`max_pages` of the table, `n_layouts` built ones); its result has at most some thousand rows. All
pages of the table are then extracted from their whole html, in batches whose trees are passed level by level at once.

Defined cases: a null or empty page has an empty text; white space of any kind inside a block is one space; text outside any block is a
block of the element around it; br is a space; repeated rows each keep their own result; input columns named like a result
column are replaced; an empty table gives an empty result, and a fit without labelled pages keeps no text.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carsift.llm.dom import BLOCK, Page, parse
from carsift.llm.layouts import labelled_pages

SLICE = 1 << 20     # characters of html whose trees are passed together
LIMIT = 6.0         # largest say of one word of a class or id
TEMPER = 0.7        # evidence of one element is partly the same fact seen twice
SPACE = re.compile(r"\s+")
NOT_MAIN = {"nav", "aside", "footer", "form"}
NAVIGATION = {"nav", "footer", "header", "a", "ul"}


def _bin(value: float, cuts: tuple[float, ...]) -> int:
    return sum(value >= c for c in cuts)


def above(page: Page, v: int, hide: frozenset[int]) -> str:
    """Tag of the parent as evidence; a page without html and body is read as if it had them."""
    if v == 0 or page.parent[v] in hide:
        return "#"
    p = page.parent[v]
    return "body" if p == 0 and page.tag[v] not in ("html", "head", "body") else page.tag[p]


def features(page: Page, hide: frozenset[int] = frozenset()) -> list[tuple[list[str], list[str]]]:
    """Per element: one value of every kind of evidence, and the words of its class and id. Marks of hidden elements are not seen."""
    n = len(page.tag)
    own, own_links, inside, inside_links, start, last = [0] * n, [0] * n, [0] * n, [0] * n, [-1] * n, [""] * n
    link = [False] * n  # in a link
    holder = list(range(n))  # the block whose text it is
    for v in range(1, n):
        link[v] = page.tag[v] == "a" or link[page.parent[v]]
        if page.tag[v] not in BLOCK:
            holder[v] = holder[page.parent[v]]
    total = 0
    for v, _, text in page.pieces:
        words = len(text.split())
        if not words:
            continue
        for x in {v, holder[v]}:
            own[x] += words
            own_links[x] += words * link[v]
            last[x] = text.rstrip()[-1]
        inside[v] += words
        inside_links[v] += words * link[v]
        if start[v] < 0:
            start[v] = total
        total += words
    for v in range(n - 1, 0, -1):
        p = page.parent[v]
        inside[p] += inside[v]
        inside_links[p] += inside_links[v]
        if start[v] >= 0 and (start[p] < 0 or start[v] < start[p]):
            start[p] = start[v]
    out = []
    for v in range(n):
        tag, words = (("div" if page.tag[v] in BLOCK else "span"), []) if v in hide else (page.tag[v], page.words[v])
        seen = [
            f"tag {tag}",
            f"own {_bin(own[v], (1, 3, 6, 12, 25, 60))} {_bin(own_links[v] / max(1, own[v]), (0.01, 0.34, 0.67))}",
            f"end {'' if not own[v] else 'stop' if last[v] in '.!?…:;' else 'open'}",
            f"in {_bin(inside[v], (1, 10, 40, 150))} {_bin(inside_links[v] / max(1, inside[v]), (0.01, 0.2, 0.6))}",
            f"at {_bin(max(0, start[v]) / max(1, total), (0.02, 0.2, 0.8, 0.97)) if start[v] >= 0 else ''}",
            f"up {above(page, v, hide)}",
        ]
        out.append((seen, words))
    return out


FRAME, MAIN, LINKS, TALK = range(4)
NAMES = {"main": MAIN, "links": LINKS, "talk": TALK}


def labels(page: Page) -> list[int]:
    """Labels by data-label: it holds for an element and what is in it; elements outside any are frame."""
    out = [FRAME] * len(page.tag)
    for v in range(1, len(out)):
        out[v] = NAMES.get(page.label[v], out[page.parent[v]])
    return out


def self_labels(page: Page) -> tuple[list[int], frozenset[int]] | None:
    """Labels of a page that marks its article by one element, and the marked element; None for others."""
    marked = [v for v, t in enumerate(page.tag) if t == "article"] or [v for v, t in enumerate(page.tag) if t == "main"]
    if len(marked) != 1:
        return None
    out, v = [TALK] * len(page.tag), marked[0]
    while v >= 0:
        out[v], v = FRAME, page.parent[v]
    for v in range(1, len(out)):
        above = out[page.parent[v]]
        if v == marked[0] or (above == MAIN and page.tag[v] not in NOT_MAIN):
            out[v] = MAIN
        elif above == LINKS or (out[v] == TALK and page.tag[v] in NAVIGATION):
            out[v] = LINKS
    return out, frozenset(marked)


def _count(page: Page, y: list[int], hide: frozenset[int], into: Counter) -> None:
    for v, (seen, words) in enumerate(features(page, hide)):
        for s in seen:
            into[s, y[v]] += 1
        for w in words:
            into[f"word {w}", y[v]] += 1
        if v:
            into[f"edge {int(page.tag[v] in BLOCK)} {y[page.parent[v]]}", y[v]] += 1
        into["nodes", y[v]] += 1


def _counted(column: str, marked: bool):
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for source in batch.column(batch.schema.get_field_index(column)).to_pylist():
                page = parse(source or "")
                if marked:
                    _count(page, labels(page), frozenset(), counts)
                elif (own := self_labels(page)) is not None:
                    _count(page, own[0], frozenset(), counts)
                    _count(page, own[0], own[1], counts)
            keys = list(counts)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([y for _, y in keys], pa.int32()), pa.array(list(counts.values()), pa.int64())], ["key", "label", "n"])

    return run


class Model:
    """Log potentials: evidence[key] over the labels of an element; edges[inline or block][label of parent][label]."""

    def __init__(self, counts: dict[str, list[int]]):
        nodes = np.array(counts.get("nodes", [0] * 4), float)
        self.trained = bool(nodes[MAIN])
        self.evidence: dict[str, np.ndarray] = {}
        for kind in {k.split(" ", 1)[0] for k in counts} - {"edge", "nodes", "word"}:
            rows = {k: np.array(c, float) for k, c in counts.items() if k.split(" ", 1)[0] == kind}
            sums = sum(rows.values()) + len(rows) + 1
            for k, c in rows.items():
                self.evidence[k] = TEMPER * np.log((c + 1) / sums)
        for k, c in counts.items():
            if k.startswith("word "):
                ratio = np.log((np.array(c, float) + 0.5) / (nodes + 50))
                self.evidence[k] = np.maximum(ratio - ratio.max(), -LIMIT)
        self.edges = np.zeros((2, 4, 4))
        for kind in (0, 1):
            for up in range(4):
                c = np.array(counts.get(f"edge {kind} {up}", [0] * 4), float)
                self.edges[kind, up] = np.log((c + 0.2) / (c.sum() + 0.8))

    def score(self, seen: list[str], words: list[str]) -> np.ndarray:
        found = [e for k in (*seen, *(f"word {w}" for w in words)) if (e := self.evidence.get(k)) is not None]
        return sum(found, NOTHING)


NOTHING = np.zeros(4)


def marginals(parent: np.ndarray, depth: np.ndarray, block: np.ndarray, score: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Probabilities of the labels of every node of a forest (roots: depth 0, parent -1), exact by two passes over its levels.

    The joint is prod exp(score[node, label]) * prod exp(edges[block of child, label of parent, label]); a root is frame.
    """
    own = score.astype(float).copy()
    own[depth == 0, 1:] = -1e9
    table = edges[block.astype(int)]  # node, label of parent, label
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    message, down = np.zeros_like(own), np.zeros_like(own)
    for level in range(len(bounds) - 2, 0, -1):
        v = order[bounds[level] : bounds[level + 1]]
        message[v] = np.logaddexp.reduce(table[v] + own[v, None, :], axis=2)
        np.add.at(own, parent[v], message[v])
    for level in range(1, len(bounds) - 1):
        v = order[bounds[level] : bounds[level + 1]]
        p = parent[v]
        down[v] = np.logaddexp.reduce(table[v] + (own[p] - message[v] + down[p])[:, :, None], axis=1)
    both = own + down
    return np.exp(both - np.logaddexp.reduce(both, axis=1)[:, None])


def main_texts(sources: list[str | None], model: Model) -> list[str]:
    """Main text of every page of a slice; their trees are one forest."""
    pages = [parse(s or "") for s in sources]
    sizes = np.array([len(p.tag) for p in pages])
    first = np.concatenate([[0], np.cumsum(sizes)])
    parent = np.concatenate([np.where(np.array(p.parent) < 0, -1, np.array(p.parent) + f) for p, f in zip(pages, first)])
    depth = np.concatenate([p.depth for p in pages])
    block = np.array([t in BLOCK for p in pages for t in p.tag])
    score = np.array([model.score(*f) for p in pages for f in features(p)])
    keep = (marginals(parent, depth, block, score, model.edges)[:, MAIN] >= 0.5) & model.trained
    out = []
    for page, f in zip(pages, first):
        runs: dict[int, list[str]] = {}
        for v, run, text in page.pieces:
            if keep[f + v]:
                runs.setdefault(run, []).append(text)
        blocks = (SPACE.sub(" ", "".join(r)).strip() for r in runs.values())
        out.append("\n".join(b for b in blocks if b))
    return out


def built_pages(spark: SparkSession, n: int) -> DataFrame:
    """Labelled pages of `layouts`, as html."""
    return spark.createDataFrame([(x,) for x in labelled_pages(n)], "html string")


def fit(pages: DataFrame | None, labelled: DataFrame, max_pages: int = 200, html: str = "html", key: str = "page_id") -> Model:
    """Counts labelled pages, and a sample of `pages` of about max_pages rows (by a hash of the key) that mark their article."""
    kinds = "key string, label int, n long"
    rows = labelled.mapInArrow(_counted(html, True), kinds)
    if pages is not None:
        share = min(1.0, max_pages / max(1, pages.count()))
        sample = pages.where(F.pmod(F.xxhash64(key, F.lit("pages")), F.lit(1 << 30)) < int(share * (1 << 30)))
        rows = rows.union(sample.select(html).mapInArrow(_counted(html, False), kinds))
    counts: dict[str, list[int]] = {}
    for r in rows.groupBy("key", "label").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault(r["key"], [0] * 4)[r["label"]] = r["n"]
    return Model(counts)


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """All columns of pages but the html, then text and n_chars."""
    taken = {"text", "n_chars"} - {html}
    pages = pages.select(*[F.col(f"`{c}`") for c in pages.columns if c.lower() not in taken])
    schema = T.StructType([*[f for f in pages.schema.fields if f.name != html], T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])
    shipped = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shipped.value
        for batch in batches:
            at = batch.schema.get_field_index(html)
            size = max(1, batch.num_rows * SLICE // max(1, batch.column(at).nbytes))
            for lo in range(0, batch.num_rows, size):
                some = batch.slice(lo, size)
                texts = main_texts(some.column(at).to_pylist(), model)
                columns = [c for i, c in enumerate(some.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return pages.mapInArrow(run, schema)
