"""Removal of passages that an earlier document also has: every run of `size` words whose sequence starts in a document with a
smaller doc_id is removed, overlapping runs merged into maximal intervals.

Every window of every text gets a Rabin-Karp hash. Windows can repeat only where their smallest inner word-gram hash (the
anchor) repeats, so anchors are counted first, over all documents; the windows of repeated anchors are then counted by
(anchor, window hash), 128 bits. Documents that repeat another's whole word sequence are settled by one fingerprint instead.

Defined cases: a null or short text loses nothing; a row without doc_id is never removed from and never counts as earlier;
rows with one doc_id do not count as earlier than each other; input columns named like a result column are replaced; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carsift.llm.scratch import written
from carsift.llm.words import Reader, Slice, lists, mix

GRAM = 12  # words of an anchor
RESULT = ["n_words", "n_removed", "intervals", "kept_text"]


def _row_key(row: np.ndarray) -> np.ndarray:
    return mix(row.astype(np.uint64) + np.uint64(1))


def _anchors(s: Slice, size: int, gram: int, first: np.ndarray) -> np.ndarray:
    """For each window the smallest hash among the grams inside it."""
    h, at = s.windows(gram, salt=1)
    low = np.full(len(s.hash), np.iinfo(np.uint64).max, np.uint64)
    low[at] = h
    span, step = size - gram + 1, 1
    while 2 * step <= span:  # minima over spans that double
        low[: len(low) - step] = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    return np.minimum(low[first], low[first + span - step])


def _fingerprint(s: Slice, size: int) -> np.ndarray:
    """Hash of each row's whole word sequence; 0 for rows shorter than a window."""
    n = len(s.hash)
    place = np.arange(n, dtype=np.uint64) - np.repeat(s.first[:-1], s.count).astype(np.uint64)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(s.hash + mix(place)))])
    whole = mix(summed[s.first[1:]] - summed[s.first[:-1]] + s.count.astype(np.uint64))
    return np.where(s.count >= size, whole, np.uint64(0))


def _profiles(size: int, gram: int):
    def run(batches):
        reader = Reader()
        for batch in batches:
            for s in reader.slices(batch.column(1)):
                _, first = s.windows(size)
                low = _anchors(s, size, gram, first) if len(first) else np.zeros(0, np.uint64)
                row = s.row[first]
                change = np.ones(len(low), bool)  # runs of windows mostly share their anchor
                change[1:] = (low[1:] != low[:-1]) | (row[1:] != row[:-1])
                anchors = lists(low[change].view(np.int64), row[change], s.hi - s.lo, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(_fingerprint(s, size).view(np.int64)), anchors], ["doc_id", "whole", "anchors"])

    return run


def _flat(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column's rows and the row of each; nulls are empty lists."""
    part = column.slice(lo, hi - lo)
    sizes = np.array([len(x) if x.is_valid else 0 for x in part], np.int64)
    return part.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64), np.repeat(np.arange(hi - lo), sizes)


def _windows(size: int, gram: int):
    """Windows of repeated anchors, one row per document and anchor."""

    def run(batches):
        reader = Reader()
        for batch in batches:
            for s in reader.slices(batch.column(1)):
                hot, hot_row = _flat(batch.column(2), s.lo, s.hi)
                h, first = s.windows(size)
                if not len(h) or not len(hot):
                    continue
                low = _anchors(s, size, gram, first)
                row = s.row[first]
                key = low ^ _row_key(row)
                take = np.flatnonzero(np.isin(key, hot ^ _row_key(hot_row)))
                take = take[np.argsort(key[take], kind="stable")]
                if not len(take):
                    continue
                fresh = np.ones(len(take), bool)
                fresh[1:] = key[take][1:] != key[take][:-1]
                starts = np.flatnonzero(fresh)
                out = pa.ListArray.from_arrays(pa.array(np.append(starts, len(take)).astype(np.int32)), pa.array(h[take].view(np.int64)))
                doc = batch.column(0).slice(s.lo, s.hi - s.lo).take(pa.array(row[take][fresh]))
                yield pa.RecordBatch.from_arrays([doc, pa.array(low[take][fresh].view(np.int64)), out], ["doc_id", "anchor", "windows"])

    return run


def _removed(size: int, schema_names: list[str]):
    def run(batches):
        reader = Reader()
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            texts = batch.column(at["__text"])
            n_words, n_removed, spans, kept = [], [], [], []
            for s in reader.slices(texts):
                gone, gone_row = _flat(batch.column(at["__windows"]), s.lo, s.hi)
                same, same_row = _flat(batch.column(at["__wholes"]), s.lo, s.hi)
                h, first = s.windows(size)
                edge = np.zeros(len(s.hash) + 1, np.int64)
                if len(gone) and len(h):
                    hit = first[np.isin(h ^ _row_key(s.row[first]), gone ^ _row_key(gone_row))]
                    np.add.at(edge, hit, 1)
                    np.add.at(edge, hit + size, -1)
                covered = np.cumsum(edge[:-1]) > 0
                if len(same):
                    whole = _fingerprint(s, size)
                    rows = same_row[whole[same_row] == same]
                    for r in rows:
                        covered[s.first[r] : s.first[r + 1]] = True
                cut = np.bincount(s.row[covered], minlength=s.hi - s.lo)
                for r in range(s.hi - s.lo):
                    text = s.data[s.offsets[r] : s.offsets[r + 1]].tobytes()
                    words = text.split()
                    n_words.append(len(words))
                    n_removed.append(int(cut[r]))
                    if cut[r]:
                        c = covered[s.first[r] : s.first[r + 1]]
                        turn = np.flatnonzero(np.diff(np.concatenate([[0], c.astype(np.int8), [0]])))
                        spans.append([{"first": int(a), "last": int(b) - 1} for a, b in turn.reshape(-1, 2)])
                        words = [w for w, x in zip(words, c) if not x]
                    else:
                        spans.append([])
                    kept.append(b" ".join(words).decode())
            keep = [batch.column(at[n]) for n in schema_names]
            kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.string())], [*schema_names, *RESULT])

    return run


def remove_repeats(docs: DataFrame, size: int = 50, gram: int = GRAM) -> DataFrame:
    """All columns of docs but for the text, with n_words, n_removed, intervals (first and last word, from 0) and kept_text."""
    if not 0 < gram <= size:
        raise ValueError("a window must hold an anchor")
    plain = docs.select("doc_id", "text")
    kind = dict(plain.dtypes)["doc_id"]
    profiles = written(plain.where(F.col("doc_id").isNotNull()).mapInArrow(_profiles(size, gram), f"doc_id {kind}, whole long, anchors array<long>"), "profiles").where("whole <> 0 or size(anchors) > 0")
    # documents whose whole word sequence stands in one with a smaller id
    firsts = profiles.where("whole <> 0").groupBy("whole").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    copied = written(profiles.join(firsts, "whole").where("doc_id > lo").select("doc_id", "whole").distinct(), "copies")
    copies = copied.groupBy("doc_id").agg(F.collect_set("whole").alias("__wholes"))
    own = profiles.join(copied, ["doc_id", "whole"], "left_anti").select("doc_id", F.explode("anchors").alias("anchor"))
    places = written(own, "anchors")
    repeated = places.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor")
    hot = places.join(repeated, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("hot"))
    windows = written(plain.join(hot, "doc_id").select("doc_id", "text", "hot").mapInArrow(_windows(size, gram), f"doc_id {kind}, anchor long, windows array<long>"), "windows")
    each = windows.select("doc_id", "anchor", F.explode("windows").alias("window"))
    earliest = written(each.groupBy("anchor", "window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor", "window", "lo"), "earliest")
    gone = each.join(earliest, ["anchor", "window"]).where("doc_id > lo").groupBy("doc_id").agg(F.collect_set("window").alias("__windows"))
    rest = [c for c in docs.columns if c.lower() not in {*RESULT, "__windows", "__wholes", "__text"} and c != "text"]
    joined = docs.select(*rest, F.col("text").alias("__text")).join(gone, "doc_id", "left").join(copies, "doc_id", "left")
    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
    schema = T.StructType([*docs.select(rest).schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("intervals", span), T.StructField("kept_text", T.StringType())])
    return joined.select(*rest, "__text", "__windows", "__wholes").mapInArrow(_removed(size, rest), schema)
