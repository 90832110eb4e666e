"""Quality ledger, license scan, language, toxicity, mixing, BPE and top-k."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from carsift.llm import bpe, langid, licenses, mixing, quality, topk, toxicity
from tests.llm.fixtures import HOSTILE, copies, documents


def test_quality_measures_match_brute_force(spark):
    docs = [*copies(5), *HOSTILE, (70, "a b c a b c a b c"), (71, "Of " * 80), (72, "a#\n\nb | c\na#\n  \n")]
    got = sorted((tuple(r) for r in quality.ledger(documents(spark, docs), keep_text=False).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()), key=str)
    expect = []
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        grams = Counter(zip(w, w[1:], w[2:]))
        hit = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        expect.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)))
    assert got == sorted(expect, key=str)


def test_quality_policies_and_ablations(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = documents(spark, [(1, good), (2, "short"), (3, good.replace(" ", "# $% ")), (4, "Of " * 80), (5, None)])
    rows = quality.ledger(docs)
    assert {r["doc_id"] for r in rows.where(quality.kept("v1")).collect()} == {1}
    assert {r["doc_id"] for r in rows.where(quality.kept("base")).collect()} == {1, 3}
    cost = {r["rule"]: (r["failed"], r["failed_alone"], r["kept_without"]) for r in quality.ablations(rows, "v1").collect()}
    assert cost["symbols"] == (1, 1, 2) and cost["repeated_words"] == (1, 1, 2) and cost["few_words"][0] == 2
    clash = quality.ledger(docs.withColumn("n_words", F.lit("x")).withColumn("FAIL_bits", F.lit(1)))
    assert clash.count() == 5 and dict(clash.dtypes)["n_words"] == "bigint"
    assert quality.ledger(documents(spark, [])).count() == 0


def test_licenses_match_brute_force(spark):
    phrases = [p for p, _ in licenses.PHRASES]
    texts = ["GNU General-Public license, cc by cc BY.", "..MIT License", "mit\nlicenses mit license mit license", "apacKe license", "cc by" * 3, "ñcc by ñ", "a" + " cc by" * 50]
    docs = [*HOSTILE, *[(100 + i, t) for i, t in enumerate(texts)]]
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    expect = []
    for i, text in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))
        at = [(k, label) for p, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        expect.append((i, len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    got = licenses.scan(documents(spark, docs)).collect()
    assert phrases and sorted((tuple(r)[:6] for r in got), key=str) == sorted(expect, key=str)
    assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)
    assert licenses.scan(documents(spark, [])).count() == 0


def test_license_spans_bridge_edits(spark):
    notice = "Permission is hereby granted, free of charge, to any person (or firm) obtaining a copy of this software and its associated documentation files"
    got = licenses.spans(documents(spark, [(1, "xx yy " + notice + " zz")])).collect()
    assert [(r["label"], r["first_word"], r["exact"]) for r in got] == [("mit", 2, False)]
    assert licenses.scan(documents(spark, [(1, "permission is hereby refused to any person")])).first()["labels"] == ""


LANGS = {"aa": ["tora", "miko", "neru", "sato"], "bb": ["schlag", "grund", "pfeil", "wacht"]}


def language_rows(n):
    rng = np.random.default_rng(3)
    return [(i, " ".join(rng.choice(LANGS[x], 12)), x) for i in range(n) for x in [["aa", "bb"][i % 2]]]


def test_language(spark):
    docs = documents(spark, [*language_rows(60), (90, None, "aa"), (91, "tora miko", None)], ", lang string")
    model = langid.fit(docs)
    assert model.langs == ["aa", "bb"]
    probe = documents(spark, [(1, "Tora neru"), (2, "schlagpfeil"), (3, None), (4, "12 ²!?"), (5, ""), (None, "grund"), (7, "tora " * 50_000)])
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(probe, model).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5, None, 7)] == ["aa", "bb", "und", "und", "und", "bb", "aa"]
    assert all(0 <= s <= 1 for _, s in got.values())
    assert langid.predict(documents(spark, []), model).count() == 0
    none = langid.fit(documents(spark, [], ", lang string"))
    assert {r["lang_pred"] for r in langid.predict(probe, none).collect()} == {"und"}


def nearest_by_force(index, vectors, q, k):
    sims = sorted((-round(sum(q.get(t, 0) * w for t, w in v.items()), 12), i, y) for i, y, v in vectors)
    return [(-s, i, y) for s, i, y in sims if s < 0][:k]


def test_toxic_neighbours_are_exact():
    rng = np.random.default_rng(1)
    terms = [chr(97 + i) * 2 for i in range(20)]
    idf = {t: 1 + i / 7 for i, t in enumerate(terms)}
    probe = toxicity.Index(idf, np.zeros(0), np.zeros(0), [], 5)
    texts = [" ".join(rng.choice(terms, rng.integers(1, 6))) for _ in range(700)]
    vectors = [(i, int(rng.random() < 0.3), probe.vector(t)) for i, t in enumerate(texts)]
    index = toxicity.Index(idf, np.array([v[0] for v in vectors]), np.array([v[1] for v in vectors]), [v[2] for v in vectors], 5)
    for text in texts[:150] + ["", "zz unknown"]:
        q = index.vector(text)
        got, expect = index.nearest(q), nearest_by_force(index, vectors, q, 5)
        assert [(i, y) for _, i, y in got] == [(i, y) for _, i, y in expect]


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    plain = ["tree", "river", "stone", "cloud", "meadow", "harbour"]
    rows = [(i, " ".join([*rng.choice(plain, 20), *(["scoundrel"] if i % 5 == 0 else [])]), int(i % 5 == 0)) for i in range(200)]
    docs, labels = documents(spark, [(i, t) for i, t, _ in rows]), spark.createDataFrame([*[(i, y) for i, _, y in rows], (3, None), (None, 1)], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    probe = documents(spark, [(1, "You Scoundrel!"), (2, "river and stone"), (3, None), (4, ""), (None, "scoundrel")])
    got = {r["doc_id"]: r for r in toxicity.score(probe, index).collect()}
    assert [got[k]["predicted"] for k in (1, 2, 3, 4, None)] == [1, 0, 0, 0, 1]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[1]["evidence"][0]["toxic"] == 1
    empty = toxicity.fit(docs.limit(0), labels)
    assert {r["score"] for r in toxicity.score(probe, empty).collect()} == {0.0}


@pytest.mark.parametrize("toxic", [lambda i: i % 2, lambda i: 1])
def test_toxic_terms_are_all_indexed(spark, toxic):
    """Half or all of the labels toxic, words of one example, mixed evidence, words of clean texts: neighbours by all terms."""
    rng = np.random.default_rng(6)
    words = [chr(97 + i) * 3 for i in range(26)]
    rows = [(i, " ".join([*rng.choice(words, 6), *(["mixed"] if i % 3 else []), f"only{chr(97 + i % 26)}{chr(97 + i // 26)}"]), toxic(i)) for i in range(120)]
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    index = toxicity.fit(documents(spark, [(i, t) for i, t, _ in rows]), labels)
    assert set(index.idf) == {w for _, t, _ in rows for w in t.split()}
    df = Counter(w for _, t, _ in rows for w in set(t.split()))
    vector = lambda text: toxicity.unit({t: (1 + np.log(n)) * (1 + np.log(121 / (1 + df[t]))) for t, n in Counter(text.split()).items() if t in df})
    vectors = [(i, y, vector(t)) for i, t, y in rows]
    probes = ["mixed", "aaa bbb mixed", "onlyab", rows[7][1], "ccc zzz unknown"]
    got = toxicity.score(documents(spark, list(enumerate(probes))), index).collect()
    for i, text in enumerate(probes):
        found = next(r["evidence"] for r in got if r["doc_id"] == i)
        assert [(r["doc_id"], r["toxic"]) for r in found] == [(d, y) for _, d, y in nearest_by_force(None, vectors, vector(text), 15)]
    few = toxicity.fit(documents(spark, [(i, t) for i, t, _ in rows]), labels, max_terms=10)
    assert len(few.idf) == 10


def test_mixing_meets_the_marginals(spark):
    cells = spark.createDataFrame([(s, x, t, n) for s, x, t, n in [("a", "en", "p", 900), ("a", "fr", "p", 50), ("b", "en", "q", 30), ("b", "fr", "p", 300), ("c", "fr", "q", 80), ("c", "en", "p", 0)]], "source string, lang string, topic string, tokens long")
    target = lambda axis, rows: spark.createDataFrame(rows, f"{axis} string, target double")
    want = {"source": [("a", 0.4), ("b", 0.4), ("c", 0.2)], "lang": [("en", 0.4), ("fr", 0.6)], "topic": [("p", 0.7), ("q", 0.3)]}
    rows = mixing.rake(cells, {k: target(k, v) for k, v in want.items()}, tolerance=1e-6, most_rounds=200).collect()
    total = sum(r["tokens"] * r["factor"] for r in rows)
    for axis, shares in want.items():
        for value, share in shares:
            assert sum(r["tokens"] * r["factor"] for r in rows if r[axis] == value) / total == pytest.approx(share, abs=1e-4)


def test_mixing_documents(spark):
    words = "word " * 20
    rows = [(i, words, "big" if i % 10 else "small", "en") for i in range(400)] + [(900, None, None, None), (901, "", "big", None), (1, words, "big", "en")]
    docs = documents(spark, rows, ", source string, lang string").withColumn("Probability", F.lit("x"))
    got = mixing.mix(docs, {"source": {"big": 0.5, "small": 0.5}}, keep=0.15)
    by = {r["source"]: r["p"] for r in got.where("n_tokens > 0").groupBy("source").agg(F.avg("probability").alias("p")).collect()}
    assert by["small"] > 5 * by["big"] and got.count() == len(rows)
    kept = mixing.sampled(docs, {"source": {"big": 0.5, "small": 0.5}}, keep=0.15)
    assert kept.columns == docs.columns and 20 < kept.count() < 120
    assert mixing.mix(documents(spark, [], ", source string, lang string")).count() == 0


def test_mixing_expects_the_marginals_of_skewed_input(spark):
    rows = [(i, "word " * 20, "a" if i % 20 else "b", "en") for i in range(400)]
    docs = documents(spark, rows, ", source string, lang string")
    for keep, share in [(0.8, 0.1), (0.05, 0.05)]:
        got = mixing.mix(docs, {"source": {"a": 0.5, "b": 0.5}}, keep=keep).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("probability")).alias("m")).collect()
        mass = {r["source"]: r["m"] for r in got}
        assert mass["b"] / sum(mass.values()) == pytest.approx(0.5, abs=1e-3)
        assert sum(mass.values()) == pytest.approx(share * 400 * 20, rel=1e-2)


def bounded_by_force(cells, targets, share):
    """Multipliers per axis value; the expected sample, cut at probability 1, is raked to share * target * all tokens."""
    tokens = np.array([c[3] for c in cells], float)
    p = np.ones(len(cells)) * share
    for _ in range(500):
        for axis, target in enumerate(targets):
            for value, t in target.items():
                mine = np.array([c[axis] == value for c in cells])
                p[mine] *= t * share * tokens.sum() / (np.minimum(1, p) * tokens)[mine].sum()
        p = np.minimum(p, 1e6)
    return np.minimum(1, p)


def test_bounded_raking_matches_brute_force(spark):
    cells = [("a", "en", "p", 9000), ("a", "fr", "p", 500), ("b", "en", "q", 300), ("b", "fr", "p", 3000), ("c", "fr", "q", 800), ("c", "en", "p", 60)]
    targets = [{"a": 0.6, "b": 0.3, "c": 0.1}, {"en": 0.55, "fr": 0.45}, {"p": 0.9, "q": 0.1}]
    frame = spark.createDataFrame(cells, "source string, lang string, topic string, tokens long")
    wanted = {x: spark.createDataFrame(list(t.items()), f"{x} string, target double") for x, t in zip(mixing.AXES, targets)}
    rows = mixing.bounded(frame, wanted, 0.7, dict.fromkeys(mixing.AXES, 0.05), most_rounds=25)
    got = {tuple(r[x] for x in mixing.AXES): r["probability"] for r in rows.collect()}
    expect = bounded_by_force(cells, targets, 0.7)
    assert max(expect) == 1  # the bound is met
    assert [got[c[:3]] for c in cells] == pytest.approx(expect, abs=2e-2)
    for r in mixing.balance(rows).collect():
        mass = sum(p * c[3] for c, p in zip(cells, expect) if r["value"] in c)
        assert r["expected"] == pytest.approx(mass / sum(p * c[3] for c, p in zip(cells, expect)), abs=5e-3)
        assert abs(r["expected"] - r["target"]) <= 0.05


def test_mixing_a_rare_value_does_not_empty_the_corpus(spark):
    rows = [(i, "word " * 100, "a", "en") for i in range(2000)] + [(5000, "one two three", "b", "fr")]
    docs = documents(spark, rows, ", source string, lang string").withColumn("__doc", F.lit(1)).withColumn("__key", F.lit(2))
    kept = mixing.sampled(docs)
    assert kept.columns == docs.columns
    found = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert 5000 in found and 1400 <= len(found) <= 1700


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 10), (60, 12), (20, 4)])
def test_bpe_equals_whole_text_encoding(spark, chunk, overlap):
    vocabulary = bpe.public_vocabulary()
    texts = [*[t for _, t in HOSTILE], "it's he'll we'd 'll ''s  \n\n  end   ", "a" * 500 + " b" * 40, " " * 200 + "x", "日本語 text 123456 " * 30, "<|endoftext|>"]
    docs = documents(spark, [(i, t, 1) for i, t in enumerate(texts)] + [(None, "x y z " * 50, 2)] * 2, ", n_tokens int")
    coded = bpe.encode(docs, vocabulary, chunk=chunk, overlap=overlap)
    coder = vocabulary.encoder()
    got = {r["doc_id"]: r for r in bpe.decode(coded, vocabulary).collect()}
    assert coded.count() == len(texts) + 2
    for i, t in enumerate(texts):
        ids = coder.encode_ordinary(t or "")
        assert np.frombuffer(got[i]["ids_le"], "<u4").tolist() == ids and got[i]["n_tokens"] == len(ids)
        assert bytes(got[i]["decoded"]).decode() == (t or "")


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(3000, 16)) * rng.gamma(2, 1, size=(3000, 1))
    m[100:160] = m[100]
    rows = [(i, v.tolist()) for i, v in enumerate(m)]
    rows += [(5000, None), (5001, [1.0, None] * 8), (5002, [float("nan")] * 16), (5003, [float("inf")] * 16), (5004, [2.0]), (None, [1.0] * 16), (7, rows[7][1]), (5100, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    block, topk.BLOCK, topk.DENSE = topk.BLOCK, 256, 16
    try:
        got = topk.search(frame, F.col("vec_id") % 100 == 0, k=10).collect()
    finally:
        topk.BLOCK, topk.DENSE = block, 512
    usable = {i: np.floor(1024 * np.pad(np.array(v, float), (0, 16 - len(v)))).astype(np.int64) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expect = set()
    for q in [i for i in usable if i % 100 == 0]:
        best = sorted((-int(usable[q] @ c), i) for i, c in usable.items() if i != q)[:10]
        expect |= {(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)}
    assert {tuple(r) for r in got} == expect and len(got) == len(expect)
    few = topk.search(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=10)
    assert few.count() == 3
    assert topk.search(frame.limit(0), F.lit(True)).count() == 0
