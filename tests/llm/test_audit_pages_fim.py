"""Filter audit, main text of pages and fill-in-middle against brute force."""

import hashlib
import html
import random
import re
import time
from collections import Counter
from itertools import permutations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from carsift.llm import dom, filter_audit, fim, html_main
from carsift.llm.layouts import labelled_pages
from tests.llm.fixtures import HOSTILE, copies

DOCS = "doc_id long, text string, source string"


def audit_by_force(rows, labels):
    lowest = {}
    for i, text, _ in rows:
        if i is not None:
            lowest[text or ""] = min(i, lowest.get(text or "", i))
    marks = {k: {i for i, *m in labels if i is not None and m[k] == 1} for k in (0, 1)}
    found = []
    for i, text, source in rows:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
                 "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and text in lowest and lowest[text] < i}
        found.append((source or "", i, {f for f in fails if fails[f]}))
    out = {}
    for part in {s for s, *_ in found}:
        mine = [(i, f) for s, i, f in found if s == part]
        total = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = list(mine)
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                total[f] += len(here)
                out[part, order, step] = [len(left), len(here), sum(f in x[1] for x in mine) - len(here), sum(x[1] == {f} for x in mine),
                                          sum(i in marks[0] for i, _ in here), sum(i in marks[1] for i, _ in here)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


def test_audit_matches_brute_force(spark):
    rnd = random.Random(4)
    plain = [(i, t, rnd.choice(["hot", "hot", "s1", None])) for i, t in copies(7, groups=20)]
    rows = plain + [(1000 + i, t.upper() + " #" * (i % 2), "hot") for i, t, _ in plain[:8]] + [(2000 + i, plain[3][1], "s1") for i in range(30)]
    rows += [(i, t, "") for i, t in HOSTILE] + [(None, plain[3][1], "s1"), (5, plain[3][1], "hot"), (5, plain[3][1], "hot"), (9, "$ " * 200_000, "long")]
    labels = [(i, rnd.choice([0, 1, None]), rnd.choice([0, 1])) for i, *_ in rows if i is None or i % 3] + [(1, 1, 1), (1, 0, 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("part", F.lit("clash")).withColumn("copies", F.lit(1)).withColumn("total", F.lit("x"))
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    values = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {(r["part"], r["filter_order"], r["step"]): [r[v] for v in values] for r in got} == audit_by_force(rows, labels)
    assert len(got) == 600 * len({r["part"] for r in got})


def test_audit_relations_and_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], DOCS), none).count() == 0
    docs = spark.createDataFrame([(1, "x " * 60, "a"), (2, " ".join(f"w{i}" for i in range(60)), "a"), (3, "x " * 60, "a")], DOCS)
    fails = filter_audit.failing_ids(docs, none)
    assert sorted((r["filter"], r["doc_id"], r["copies"]) for r in fails.collect()) == [("B", 1, 1), ("B", 3, 1), ("E", 3, 1)]
    clean = filter_audit.audit(docs.where("doc_id = 2"), none)
    assert clean.count() == 600 and clean.where("kept <> 1 or removed + redundant + shapley <> 0").count() == 0


def test_marginals_match_enumeration():
    rnd = np.random.default_rng(5)
    for n in (1, 2, 5, 7):
        parent = np.array([-1] + [int(rnd.integers(0, i)) for i in range(1, n)])
        depth = np.zeros(n, int)
        for v in range(1, n):
            depth[v] = depth[parent[v]] + 1
        block, score, edges = rnd.integers(0, 2, n).astype(bool), rnd.normal(0, 2, (n, 4)), np.log(rnd.dirichlet(np.ones(4), (2, 4)))
        total = np.zeros((n, 4))
        for y in product(range(4), repeat=n):
            if y[0] == html_main.FRAME:
                w = np.exp(sum(score[v, y[v]] for v in range(n)) + sum(edges[int(block[v]), y[parent[v]], y[v]] for v in range(1, n)))
                total[np.arange(n), list(y)] += w
        got = html_main.marginals(parent, depth, block, score, edges)
        assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-9)


def test_broken_markup():
    def texts(source):
        runs = {}
        for _, run, text in dom.parse(source).pieces:
            runs.setdefault(run, []).append(text)
        return [b for r in runs.values() if (b := re.sub(r"\s+", " ", "".join(r)).strip())]

    assert texts("<p>one<p>two <b>three<br>four<p>five") == ["one", "two three four", "five"]
    assert texts("<ul><li>a<li>b<ul><li>c</ul>d</ul>e") == ["a", "b", "c", "d", "e"]
    assert texts("x < y &amp; z &copy; <!-- <p>no --> w<script>if (a<b) '</p>'</script>!") == ["x < y & z © w!"]
    assert texts('<a title="a>b" href=x>l</a></div></b> m<table><tr><td>1<td>2</table>') == ["l m", "1", "2"]
    assert texts("<div><b>x</div>y</b>z") == ["x", "yz"] and texts("a<div") == ["a"] and texts("<!--") == [] and texts("") == []
    assert texts("<textarea><p>no</textarea><svg><g/><text>no</text></svg>yes<script>never") == ["yes"]


@pytest.mark.parametrize("part", ["<div>", "<p title='", "</b>", "<b>", "<!--", "<li>", "<table><td>", "&amp;", "<a b=\"", "<p>"])
def test_long_pages_take_linear_time(part):
    start = time.time()
    dom.parse(part * (400_000 // len(part)))
    assert time.time() - start < 8


@pytest.fixture(scope="module")
def model(spark):
    return html_main.fit(None, html_main.built_pages(spark, 600))


def bare(page):
    return re.sub(r" data-label=(main|links|talk)", "", page)


def test_held_out_layouts(spark, model):
    held = labelled_pages(150, seed=77)
    got = html_main.main_texts([bare(p) for p in held], model)
    scores = []
    for page, text in zip(held, got):
        tree, runs = dom.parse(page), {}
        labels = html_main.labels(tree)
        for v, run, piece in tree.pieces:
            if labels[v] == html_main.MAIN:
                runs.setdefault(run, []).append(piece)
        want, have = Counter(" ".join("".join(r) for r in runs.values()).split()), Counter(text.split())
        scores.append(2 * sum((want & have).values()) / max(1, sum(want.values()) + sum(have.values())))
    assert np.mean(scores) > 0.95 and np.mean(np.array(scores) == 1) > 0.8


def test_written_page(model):
    page = """<body><div id="siteHeader"><a href=/>Home</a> The Daily Sheet</div><ul class=mainMenu><li><a href=a>News</a><li><a href=b>Sports</a></ul>
    <div class="cookieNotice">We use cookies to make this site better. Please accept them.</div>
    <div class="post-body"><h1>Rivers &amp; rain</h1><p>The river rose by two&nbsp;metres
    overnight, as the council had warned on Monday.</p><div class="advert"><p>Buy umbrellas now! They last a lifetime.</p></div>
    <p>Nobody was hurt. The bridge stays closed until <b>Friday</b>, and trains go round by the coast.</p></div>
    <div class=comments><div class=comment><b>Ann</b><p>I have seen this before. It was worse in my youth, and nobody closed a bridge then.</p></div></div>
    <form><label>Mail</label><p>Get our newsletter every week.</p></form><div id=footer>&copy; The Daily Sheet. All rights reserved.</div>"""
    want = ["Rivers & rain", "The river rose by two metres overnight, as the council had warned on Monday.",
            "Nobody was hurt. The bridge stays closed until Friday, and trains go round by the coast."]
    assert html_main.main_texts([page], model)[0].split("\n") == want


def test_pages_of_every_kind(spark, model):
    article = "<article><h1>Head</h1>" + "".join(f"<p>Word {i} stands in this long paragraph, and more words follow it here.</p>" for i in range(9))
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "just words"), (4, "u", article), (4, "u", article), (None, None, article), (6, "u", article * 1200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = html_main.extract(pages, model)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    found = {(r["page_id"], r["text"]) for r in got.collect()}
    assert {t for i, t in found if i in (1, 2)} == {""} and len(found) == 6 and got.count() == len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())
    assert next(t for i, t in found if i == 4).startswith("Head\nWord 0 stands")
    assert html_main.extract(pages.limit(0), model).count() == 0
    none = html_main.fit(pages.limit(0), html_main.built_pages(spark, 1).limit(0))
    assert {r["text"] for r in html_main.extract(pages, none).collect()} == {""}


def test_extraction_learns_from_marked_pages(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    own = html_main.fit(rows, html_main.built_pages(spark, 600), max_pages=50)
    for r, source in zip(html_main.extract(rows.orderBy("page_id"), own).collect(), [x["html"] for x in rows.orderBy("page_id").collect()]):
        blocks = re.split(r"</?(?:p|h1)>", source.split("<article>")[1].split("</article>")[0].replace("<br>", " "))
        blocks = [html.unescape(re.sub(r"\s+", " ", re.sub("<[^>]*>", "", b)).strip()) for b in blocks]
        assert r["text"] == "\n".join(b for b in blocks if b)


def fim_by_force(i, text):
    text = text or ""
    code = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    h = [int(code[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    parts = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, "<S>" + parts[2] + "<P>" + parts[0] + "<M>" + parts[1]
    return n, "psm", a, b - a, "<P>" + parts[0] + "<S>" + parts[2] + "<M>" + parts[1]


def test_fill_in_middle(spark, tmp_path):
    rnd = random.Random(2)
    long = "".join(rnd.choice("aé漢🙂 \n<PS>") for _ in range(3 * fim.FRAME + 5))
    docs = [*HOSTILE, *copies(9, groups=12), *[(500 + i, long.replace("P", "p") + str(i)) for i in range(12)], (600, long), (601, "x<M>y"), (602, "a<" * 9), (603, "🙂")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("form", F.lit(1)).withColumn("N", F.lit("x")).withColumn("frames", F.lit(0))
    fim.store(frame).write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    made = fim.transform(stored)
    want = sorted(((i, *fim_by_force(i, t)) for i, t in docs), key=str)
    fields = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]
    assert sorted((tuple(r) for r in fim.texts(made).select(*fields, "text").collect()), key=str) == want
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in fim.digests(made).select("doc_id", "output_sha256", "restored_sha256").collect()), key=str)
    assert got == sorted(((i, sha(fim_by_force(i, t)[-1]), sha(t or "")) for i, t in docs), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in fim.texts(fim.restore(made)).collect()), key=str) == sorted(((i, t or "") for i, t in docs), key=str)
    assert fim.digests(fim.transform(fim.store(frame.limit(0)))).count() == 0
    assert {r["form"] for r in made.collect()} == {"plain", "psm", "spm"}


def test_cuts_open_only_their_frames():
    class Counting:
        opened = 0

        def decompress(self, data):
            Counting.opened += 1
            return data

    class Raw:
        def compress(self, data):
            return data

    text = "ab" * (5 * fim.FRAME)
    stored = fim.cut(text, Raw())
    out = fim.Writer(Raw())
    fim.arrange(fim.Frames(stored.upto, stored.data, Counting()), "psm", 3 * fim.FRAME + 7, 4 * fim.FRAME, out)
    out.flush()
    a, b = 3 * fim.FRAME + 7, 7 * fim.FRAME + 7
    assert b"".join(out.data).decode() == "<P>" + text[:a] + "<S>" + text[b:] + "<M>" + text[a:b]
    assert Counting.opened <= 4 and out.upto[-1] == len(text) + 9
