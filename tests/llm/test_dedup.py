"""Line dedup, Jaccard join, substring dedup and components against brute force."""

import hashlib
import random
import re
from itertools import combinations

import pytest

from carsift.llm import components, jaccard, line_dedup, substrings
from tests.llm.fixtures import HOSTILE, copies, documents, roots

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 50), (60, 60)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == roots(nodes, [e for e in edges if e[0] != e[1]])


def shingles(text, n):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize("n,num,den", [(5, 4, 5), (3, 9, 10), (2, 7, 10)])
def test_jaccard_classes_match_all_pairs(spark, n, num, den):
    docs = copies(n)
    docs += [(900, None), (901, ""), (902, " \n"), (903, "W1 w1"), (None, "w1 w2 w3"), docs[0]]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.classes(documents(spark, docs), n, num, den).collect()}
    sets = {i: shingles(x, n) for i, x in docs if i is not None}
    links = [(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    root = roots(sets, links)
    assert links
    assert got.pop(None)[1] is None
    assert got == {i: (len(s), root[i]) for i, s in sets.items()}


def test_keys_are_shuffled_in_turns_that_make_all_of_them(spark, monkeypatch):
    docs = [*copies(7), (901, None), (902, ""), (None, "w1 w2 w3"), (3, "another text of the same id")]
    made = []
    real = jaccard.candidate_tiles
    monkeypatch.setattr(jaccard, "candidate_tiles", lambda *members: made.append([[tuple(r) for r in m.select("id", "key").collect()] for m in members]) or real(*members))
    one = sorted(map(tuple, jaccard.classes(documents(spark, docs)).collect()), key=str)
    monkeypatch.setattr(jaccard, "TURNS", 1)
    assert sorted(map(tuple, jaccard.classes(documents(spark, docs)).collect()), key=str) == one
    turns, (whole,) = made
    assert len(turns) == 2 and sorted(x for t in turns for x in t) == sorted(whole)
    assert max(map(len, turns)) < 0.7 * len(whole)
    assert not set.intersection(*({k for _, k in t} for t in turns))


def test_jaccard_large_group_of_near_copies(spark):
    base = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join([*base[:30], f"v{i}", *base[31:]])) for i in range(300)]
    got = jaccard.classes(documents(spark, docs), 3, 9, 10)
    assert {r["component_id"] for r in jaccard.classes(documents(spark, docs), 3, 4, 5).collect()} == {0}
    assert got.count() == 300


def test_jaccard_keep_one(spark):
    rows = [(3, "a b c d e f g", 1), (1, "a b c d e f g", 2), (2, "other words are in this one", 3), (None, "a b c d e f g", 4)]
    got = jaccard.keep_one(documents(spark, rows, ", component_id long"))
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in got.collect()) == [(0, 4), (1, 2), (2, 3)]
    assert jaccard.classes(documents(spark, [])).count() == 0
    assert jaccard.classes(documents(spark, HOSTILE)).count() == len(HOSTILE)


def line_classes_by_force(docs):
    places = {}
    for i, text in docs:
        for k, line in enumerate((text or "").split("\n")):
            if line.strip(" \t\n\x0b\x0c\r"):
                places.setdefault(line, []).append((i, k))
    sets = {x: frozenset(x.encode()[j : j + 10] for j in range(max(1, len(x.encode()) - 9))) for x in places}
    root = roots(sets, [(a, b) for a, b in combinations(sets, 2) if 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b]))])
    firsts = {}
    for line, at in places.items():
        firsts[root[line]] = min(min(at), firsts.get(root[line], min(at)))
    return {p: firsts[root[line]] for line, at in places.items() for p in at}


def test_line_classes_match_all_pairs(spark):
    docs = [*copies(11, groups=20), (700, "abc\n\n \nabc\nabd"), (701, None), (702, ""), (703, "w1 w2\r\nw1 w2")]
    got = {(r["doc_id"], r["line_no"]): (r["first_doc"], r["first_line"]) for r in line_dedup.line_classes(documents(spark, docs)).collect()}
    assert got == line_classes_by_force(docs)


@pytest.mark.parametrize("size", [14, 15, 19, 21, 25])
def test_bands_find_short_similar_lines(spark, size):
    """Lines of 5 to 16 shingles and the same without their last byte: 0.9997 share a band at similarity 0.8, more above it."""
    rnd = random.Random(size)
    shingle = lambda x: {x[j : j + 10] for j in range(len(x) - 9)}
    pairs = []
    for _ in range(3000):
        line = "".join(rnd.choices("abcdefghijklmnopqrstuvwxyz ", k=size - 1)) + "z"
        other = line[:-1]
        a, b = shingle(line), shingle(other)
        assert 5 * len(a & b) >= 4 * len(a | b)
        pairs.append((line, other))
    rows = spark.createDataFrame([(2 * i + j, i, x) for i, p in enumerate(pairs) for j, x in enumerate(p)], "k1 long, k2 long, line string")
    signed = {r["k1"]: r for r in line_dedup.signatures(rows, line_dedup.SHINGLE, line_dedup.BANDS * line_dedup.ROWS).collect()}
    shared = lambda a, b: any(all(a[f"m{2 * k + j}"] == b[f"m{2 * k + j}"] for j in range(2)) for k in range(line_dedup.BANDS))
    missed = sum(not shared(signed[2 * i], signed[2 * i + 1]) for i in range(len(pairs)))
    assert missed <= 5  # 0.9 expected


def test_removed_lines(spark):
    long = "a line of some length that two documents share word for word"
    near = "a line of some length that two documents share word for work"
    rows = [(2, f"{near}\nalone", 0), (1, f"first\n{long}\n\nlast", 0), (3, long, 0), (4, None, 7), (5, "", 7), (None, long, 9), (1, f"first\n{long}\n\nlast", 0)]
    got = line_dedup.remove_lines(documents(spark, rows, ", n_chars long"))
    whole = f"first\n{long}\n\nlast"
    assert got.columns == ["doc_id", "text", "n_chars"]
    assert sorted(((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in got.collect()), key=str) == sorted(
        [(0, long, len(long)), (1, whole, len(whole)), (1, whole, len(whole)), (2, "alone", 5), (4, None, None), (5, "", 0)], key=str)
    assert line_dedup.line_classes(documents(spark, [])).count() == 0
    assert line_dedup.line_classes(documents(spark, HOSTILE)).count() > 0


def removed_by_force(docs, size):
    first = {}
    for i, text in docs:
        w = WORD.findall(text or "")
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, i), i)
    out = {}
    for i, text in docs:
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


@pytest.mark.parametrize("size,gram", [(50, 12), (6, 3), (4, 4)])
def test_repeats_match_brute_force(spark, size, gram):
    docs = [*copies(size, groups=20), (800, None), (801, ""), (802, "w1 w2 " * 90), (803, "w2 w1 " * 40)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substrings.remove_repeats(documents(spark, docs), size, gram).collect()}
    expect = removed_by_force(docs, size)
    assert sum(x[1] for x in expect.values())
    assert got == expect


def test_repeat_intervals_and_odd_rows(spark):
    rows = [(2, "x a b c d y c d e f z", 1), (1, "a b c d e f", 1), (None, "a b c d e f", 1), (1, "a b c d e f", 1)]
    got = substrings.remove_repeats(documents(spark, rows, ", n_words long"), 3, 2)
    two = next(r for r in got.collect() if r["doc_id"] == 2)
    assert [tuple(x) for x in two["intervals"]] == [(1, 4), (6, 9)] and two["kept_text"] == "x y z" and two["n_words"] == 11
    assert {r["n_removed"] for r in got.collect() if r["doc_id"] != 2} == {0}
    assert substrings.remove_repeats(documents(spark, [])).count() == 0
    assert substrings.remove_repeats(documents(spark, HOSTILE), 3, 2).count() == len(HOSTILE)
