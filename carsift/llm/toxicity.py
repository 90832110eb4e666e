"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

The terms are all terms of the labelled sample or, where it has more, the `max_terms` whose presence goes most with the label
(largest chi-square, in either direction); there is no other test of a term. The examples are indexed by
term: postings lie in blocks, each with its largest weight, so a block's best possible cosine is known before it is opened.
The blocks of the largest bounds give a limit, then all blocks are opened whose bound reaches it; the neighbours found are
exact. They vote by inverse distance; a logistic curve fitted on leave-one-out votes of the examples turns votes into probabilities. The
neighbours are returned as evidence.

The fit reads a bounded sample of the labelled rows (`max_docs`, chosen by a hash of doc_id) and keeps at most `max_terms`
terms, which bounds the index that is shipped to tasks. Scoring reads every word of every whole text.

Defined cases: a null or empty text, or one without a known term, gets the share of toxic examples among such examples; with
no labelled rows every score is 0; ties between neighbours go to the smaller doc_id; repeated rows are scored one by one;
other input columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = regex.compile(r"\p{L}+")
NONLETTERS = r"[^\p{L}]+"
BLOCK = 64
HEAD = 4  # blocks opened for a first limit
EVIDENCE = "array<struct<doc_id:bigint,similarity:double,toxic:int>>"


class Index:
    """Examples as unit TF-IDF vectors, and their postings in blocks."""

    def __init__(self, idf: dict[str, float], ids: np.ndarray, toxic: np.ndarray, vectors: list[dict[str, float]], k: int):
        # examples with the same leading term lie together, so block bounds are tight
        order = sorted(range(len(ids)), key=lambda i: (max(vectors[i], key=lambda t: (vectors[i][t], t), default=""), int(toxic[i]), int(ids[i])))
        self.idf, self.k = idf, k
        self.ids, self.toxic = np.asarray(ids, np.int64)[order], np.asarray(toxic, np.int64)[order]
        self.number = {t: i for i, t in enumerate(idf)}
        term = np.array([self.number[t] for i in order for t in vectors[i]], np.int64)
        at = np.repeat(np.arange(len(order)), [len(vectors[i]) for i in order])
        by = np.argsort(term, kind="stable")
        # postings by term and place; runs of one term in one block, with their largest weight
        self.at, self.weight = at[by], np.array([w for i in order for w in vectors[i].values()], float)[by]
        term, block = term[by], self.at // BLOCK
        start = np.flatnonzero(np.append(True, (term[1:] != term[:-1]) | (block[1:] != block[:-1]))[: len(term)])
        self.run = np.append(start, len(term))
        self.run_block = block[start]
        self.run_most = np.maximum.reduceat(self.weight, start) if len(start) else np.zeros(0)
        self.first = np.searchsorted(term[start], np.arange(len(idf) + 1))
        self.slope, self.shift, self.empty = 1.0, 0.0, 0.0

    def vector(self, text: str | None) -> dict[str, float]:
        counts = Counter(w for w in WORD.findall(text.lower()) if w in self.idf) if text else {}
        return unit({t: (1 + math.log(n)) * self.idf[t] for t, n in counts.items()})

    def nearest(self, q: dict[str, float], but: int | None = None) -> list[tuple[float, int, int]]:
        """(similarity, doc_id, toxic) of the k most similar examples with similarity above 0."""
        known = np.array([self.number[t] for t in q], np.int64)
        runs, of = spans(self.first[known], self.first[known + 1])
        if not len(runs):
            return []
        weight, block = np.array(list(q.values()))[of], self.run_block[runs]
        bound = np.bincount(block, weight * self.run_most[runs])

        def opened(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            some = blocks[block]
            places, of = spans(self.run[runs[some]], self.run[runs[some] + 1])
            scores = np.bincount(self.at[places], self.weight[places] * weight[some][of])
            found = np.flatnonzero(scores > 0)
            if but is not None:
                found = found[self.ids[found] != but]
            scores = np.round(scores[found], 12)
            if len(found) > self.k:
                best = scores >= np.partition(scores, -self.k)[-self.k]
                found, scores = found[best], scores[best]
            return found, scores

        # the k-th best of the most promising blocks is a limit that the bounds of all others are held against
        head = np.zeros(len(bound), bool)
        head[np.argsort(-bound, kind="stable")[:HEAD]] = True
        found, scores = opened(head)
        least = scores.min() - 1e-9 if len(found) >= self.k else 0.0
        if ((bound > 0) & (bound >= least) & ~head).any():
            found, scores = opened((bound > 0) & (bound >= least))
        first = np.lexsort((self.ids[found], -scores))[: self.k]
        return list(zip(scores[first].tolist(), self.ids[found[first]].tolist(), self.toxic[found[first]].tolist()))

    def vote(self, near: list[tuple[float, int, int]]) -> float | None:
        if not near:
            return None
        weight = [1 / (0.05 + math.sqrt(max(0.0, 2 - 2 * s))) for s, _, _ in near]
        return sum(w * y for w, (_, _, y) in zip(weight, near)) / sum(weight)

    def score(self, vote: float | None) -> float:
        if vote is None:
            return self.empty
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * (vote - 0.5) + self.shift))))

    def calibrate(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """Logistic curve through (vote, label) by Newton steps, held rising and finite by a small penalty."""
        if not len(votes):
            return
        x, w = np.column_stack([votes - 0.5, np.ones(len(votes))]), np.array([4.0, 0.0])
        pull = np.diag([0.05, 0.05])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (toxic - p) - pull @ (w - [4.0, 0.0]))
            w = w + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-6:
                break
        self.slope, self.shift = max(0.0, float(w[0])), float(w[1])


def spans(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi-1, one range after the other, and the index of each one's range."""
    length = hi - lo
    of = np.repeat(np.arange(len(lo)), length)
    return np.arange(len(of)) + (lo - (np.cumsum(length) - length))[of], of


def unit(v: dict[str, float]) -> dict[str, float]:
    length = math.sqrt(sum(x * x for x in v.values()))
    return {t: x / length for t, x in v.items()} if length else {}


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 20_000, max_terms: int = 2_000, k: int = 15) -> Index:
    """docs (doc_id, text) and labels (doc_id, toxic), both without held-out rows."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_docs / max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about max_docs rows of two numbers: small enough to broadcast
    train = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).select(
        "doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    n, n_toxic = train.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return Index({}, np.zeros(0), np.zeros(0), [], k)
    terms = train.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), NONLETTERS))).alias("t")).where("t <> ''")
    a, df, n1, n0 = F.col("a"), F.col("df"), F.lit(float(n_toxic)), F.lit(float(n - n_toxic))
    # 2 x 2 table of term and label; 0 where one side of it is empty
    off, sides = a * (n0 - (df - a)) - (df - a) * (n1 - a), df * (F.lit(float(n)) - df) * n1 * n0
    chi = F.when(sides > 0, F.lit(float(n)) * off * off / sides).otherwise(F.lit(0.0))
    counted = terms.groupBy("t").agg(F.sum("toxic").cast("double").alias("a"), F.count("*").cast("double").alias("df"))
    top = counted.withColumn("chi", chi).orderBy(F.desc("chi"), F.desc("df"), "t").limit(max_terms).collect()
    idf = {r["t"]: 1 + math.log((1 + n) / (1 + r["df"])) for r in top}
    probe = Index(idf, np.zeros(0), np.zeros(0), [], k)

    def vectors(batches):
        for batch in batches:
            v = [probe.vector(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([list(x) for x in v], pa.list_(pa.string())), pa.array([list(x.values()) for x in v], pa.list_(pa.float64()))], ["doc_id", "toxic", "terms", "weights"])

    kinds = dict(train.dtypes)
    rows = train.mapInArrow(vectors, f"doc_id {kinds['doc_id']}, toxic {kinds['toxic']}, terms array<string>, weights array<double>").collect()  # bounded by max_docs
    rows.sort(key=lambda r: r["doc_id"])
    full, bare = [r for r in rows if r["terms"]], [r for r in rows if not r["terms"]]
    index = Index(idf, np.array([r["doc_id"] for r in full]), np.array([r["toxic"] for r in full]), [dict(zip(r["terms"], r["weights"])) for r in full], k)
    index.empty = sum(r["toxic"] for r in bare) / len(bare) if bare else n_toxic / n
    # leave-one-out votes, in tasks
    shipped = docs.sparkSession.sparkContext.broadcast(index)

    def votes(batches):
        for batch in batches:
            out, y = [], []
            for doc, toxic, text in zip(*(c.to_pylist() for c in batch.columns)):
                v = shipped.value.vote(shipped.value.nearest(shipped.value.vector(text), doc))
                if v is not None:
                    out.append(v)
                    y.append(float(toxic))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64()), pa.array(y, pa.float64())], ["vote", "toxic"])

    seen = train.mapInArrow(votes, "vote double, toxic double").collect()  # bounded by max_docs
    index.calibrate(np.array([r["vote"] for r in seen]), np.array([r["toxic"] for r in seen]))
    return index


def score(docs: DataFrame, index: Index) -> DataFrame:
    """doc_id, score, predicted, evidence (the nearest examples)."""
    shipped = docs.sparkSession.sparkContext.broadcast(index)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        index = shipped.value
        shape = pa.list_(pa.struct([("doc_id", pa.int64()), ("similarity", pa.float64()), ("toxic", pa.int32())]))
        for batch in batches:
            scores, evidence = [], []
            for text in (x.as_py() for x in batch.column(1)):
                near = index.nearest(index.vector(text))
                scores.append(index.score(index.vote(near)))
                evidence.append([{"doc_id": d, "similarity": s, "toxic": y} for s, d, y in near])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, shape)], ["doc_id", "score", "predicted", "evidence"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, evidence {EVIDENCE}")
