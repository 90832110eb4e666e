"""Exact n-gram Jaccard join in size-banded tiles.

A document is the set of 64-bit hashes of its distinct word shingles. Sizes are cut into bands so wide that linked sets lie in
one band or in neighbouring ones. For each pair of neighbouring bands the hash range is cut into more parts than linked sets
can differ in elements, so two linked sets agree in a whole part; documents with an equal part (a tile) are candidates. Hashed
bitmaps then bound the overlap from above (sets differ in at least as many elements as their bitmaps in bits), and sorted
arrays are intersected for what is left. No link is missed: parts, bands and bitmaps are necessary conditions.

Equal sets are joined first. Inside a tile every set is compared with the tile's smallest one; the links found give classes,
and only pairs of different classes are then compared with each other. So a large group of near copies costs comparisons in
proportion to its size, and links inside one class that change nothing are not listed.

Defined cases: a null text or one without words has an empty set, linked with nothing; a text with fewer words than a shingle
is one shingle; rows without doc_id are returned unlinked with component_id null; rows that repeat a doc_id share its class
(if their texts differ, one of them is compared); other input columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carsift.llm.scratch import settled, written
from carsift.llm.tiles import BITS, candidate_tiles, may_link, tile_classes
from carsift.llm.words import Reader, Slice, mix

TURNS = 2  # keys are made and shuffled in so many turns: nearly all occur once, and only the others stay on disk


class Bands:
    """Band edges and the number of parts for linked sets whose smaller one lies in a band. t = num / den."""

    def __init__(self, num: int, den: int, largest: int):
        self.edges = [1]
        while self.edges[-1] <= largest:
            self.edges.append(self.edges[-1] * den // num + 1)
        self.edges.append(self.edges[-1] * den // num + 1)
        self.num, self.den = num, den

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.edges, n, "right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """(parts, differences): linked sets of this scheme differ in at most so many elements."""
        differ = (self.edges[band + 1] - 1) * (self.den - self.num) // self.num
        if differ == 0:
            return 0, 0  # only equal sets are linked
        p = differ + 1
        for _ in range(8):  # room for parts that are empty by chance
            empty = p * math.exp(-self.edges[band] / p)
            p = differ + 1 + math.ceil(empty + 4 * math.sqrt(empty))
        return p, differ


def _sets(s: Slice, n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    h, at = s.windows(n)
    row = s.row[at]
    bound = np.searchsorted(row, np.arange(s.hi - s.lo + 1))
    out = []
    for r in range(s.hi - s.lo):
        if s.count[r] == 0:
            out.append(np.zeros(0, np.uint64))
        elif s.count[r] < n:
            w = s.hash[s.first[r] : s.first[r + 1]]
            out.append(mix(np.array([np.bitwise_xor.reduce(mix(w + np.arange(len(w), dtype=np.uint64)))], np.uint64)))
        else:
            out.append(np.unique(h[bound[r] : bound[r + 1]]))
    return out


def _tile_keys(u: np.ndarray, scheme: int, p: int, differ: int) -> np.ndarray:
    edge = np.array([(k << 64) // p for k in range(p)], np.uint64)
    at = np.searchsorted(u, edge)
    summed = np.zeros(len(u) + 1, np.uint64)
    np.cumsum(mix(u ^ np.uint64(0xA5A5A5A55A5A5A5A)), out=summed[1:])
    total = summed[np.append(at[1:], len(u))] - summed[at]
    full = np.append(at[1:], len(u)) > at
    key = mix(total + mix(np.arange(p, dtype=np.uint64) + np.uint64(scheme << 32)))
    # p - differ parts agree; a set with fewer empty parts than that agrees in a full one
    return key[full] if p - int(full.sum()) < p - differ else key


def _set_key(u: np.ndarray) -> int:
    return int(np.sum(mix(u + np.uint64(1)), dtype=np.uint64).view(np.int64))


def _profiles(n: int):
    def run(batches):
        reader = Reader(fold_case=True)
        for batch in batches:
            for s in reader.slices(batch.column(1)):
                size, a, b, bits = [], [], [], []
                for u in _sets(s, n):
                    size.append(len(u))
                    a.append(_set_key(u))
                    b.append(int(np.sum(mix(u ^ np.uint64(0x5BD1E9955BD1E995)), dtype=np.uint64).view(np.int64)))
                    flags = np.zeros(BITS, np.uint8)
                    flags[(mix(u ^ np.uint64(77)) % np.uint64(BITS)).astype(np.int64)] = 1
                    bits.append(np.packbits(flags).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(size, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()),
                     pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "ka", "kb", "bits"])

    return run


def _keys(n: int, num: int, den: int, turn: int):
    """Those tile keys of one turn (of TURNS, by their value) of each text whose set is the one that stands for its doc_id.

    `others` are the set keys of a doc_id that do not stand for it, or NULL."""

    def run(batches):
        reader = Reader(fold_case=True)
        bands = Bands(num, den, 1 << 20)
        for batch in batches:
            for s in reader.slices(batch.column(1)):
                keys = []
                for u, others in zip(_sets(s, n), batch.column(2).slice(s.lo, s.hi - s.lo).to_pylist()):
                    own = []
                    if len(u) and not (others and _set_key(u) in others):
                        if len(u) >= bands.edges[-2]:
                            bands = Bands(num, den, 2 * len(u))
                        band = bands.of(len(u))
                        for scheme in (band - 1, band):
                            p, differ = bands.parts(scheme) if scheme >= 0 else (0, 0)
                            if p:
                                key = _tile_keys(u, scheme, p, differ)
                                own.append(key[key % np.uint64(TURNS) == turn])
                    keys.append(np.concatenate(own).view(np.int64) if own else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(keys, pa.list_(pa.int64()))], ["id", "keys"])

    return run


def _arrays(n: int):
    def run(batches):
        reader = Reader(fold_case=True)
        for batch in batches:
            for s in reader.slices(batch.column(1)):
                sets = _sets(s, n)
                a = [_set_key(u) for u in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.hi - s.lo), pa.array(a, pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())], ["doc_id", "ka", "sorted"])

    return run


def _shared(batches):
    for batch in batches:
        both = [len(np.intersect1d(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), assume_unique=True)) for x, y in zip(batch.column(2), batch.column(3))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64())], ["u", "v", "shared"])


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, n: int, num: int, den: int, kind: str) -> DataFrame:
    """Pairs (u, v) of documents whose sets are similar enough, by exact intersection."""
    wanted = pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))).distinct()
    texts = docs.join(wanted, "doc_id", "left_semi").mapInArrow(_arrays(n), f"doc_id {kind}, ka long, sorted binary")
    # a repeated doc_id with other texts: only the set that stands for it
    sets = sets.select(F.col("id").alias("doc_id"), "ka", "n_shingles")
    arrays = written(texts.join(sets, ["doc_id", "ka"]).dropDuplicates(["doc_id"]), "arrays")
    left = arrays.select(F.col("doc_id").alias("u"), F.col("sorted").alias("a"), F.col("n_shingles").alias("na"))
    right = arrays.select(F.col("doc_id").alias("v"), F.col("sorted").alias("b"), F.col("n_shingles").alias("nb"))
    sized = pairs.join(left.select("u", "na"), "u").join(right.select("v", "nb"), "v")
    counted = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_shared, f"u {kind}, v {kind}, shared long")
    return counted.join(sized, ["u", "v"]).where(F.col("shared") * (num + den) >= num * (F.col("na") + F.col("nb"))).select("u", "v")


def classes(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row; similarity num / den or more."""
    plain = docs.select("doc_id", "text")
    kind = dict(plain.dtypes)["doc_id"]
    profiles = written(plain.mapInArrow(_profiles(n), f"doc_id {kind}, n_shingles long, ka long, kb long, bits array<long>"), "profiles")
    some = profiles.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    equal = some.groupBy("ka", "kb").agg(F.min("doc_id").alias("doc_id"))
    stand = written(equal.groupBy("doc_id").agg(F.min(F.struct("ka", "kb")).alias("k")).select("doc_id", "k.ka", "k.kb"), "stand")
    # by what does not stand, which is little where few sets are equal: the texts then need no shuffle
    spare = some.select("doc_id", "ka").distinct().join(stand.select("doc_id", "ka"), ["doc_id", "ka"], "left_anti")
    spare = written(spare.groupBy("doc_id").agg(F.collect_list("ka").alias("others")), "spare")
    texts = plain.where(F.col("doc_id").isNotNull()).join(spare, "doc_id", "left").select("doc_id", "text", "others")
    turns = [texts.mapInArrow(_keys(n, num, den, turn), f"id {kind}, keys array<long>").select("id", F.explode("keys").alias("key")) for turn in range(TURNS)]
    tiles = settled(docs.sparkSession, "tiles", lambda: candidate_tiles(*turns))
    # written, so that Spark knows its size and need not shuffle all texts for a few ids
    ids = written(tiles.select("id").distinct(), "ids")
    texts = written(plain.join(ids.withColumnRenamed("id", "doc_id"), "doc_id", "left_semi"), "texts")
    shown = some.select("doc_id", "ka", "kb", "n_shingles", "bits").join(stand, ["doc_id", "ka", "kb"]).dropDuplicates(["doc_id"])
    signs = written(shown.withColumnRenamed("doc_id", "id").join(ids, "id", "left_semi"), "signs")
    close = may_link("a_n_shingles", "b_n_shingles", "a_bits", "b_bits", num, den)
    final = tile_classes(tiles, signs.select("id", "n_shingles", "bits"), close, lambda pairs: _linked(pairs, texts, signs, n, num, den, kind))
    named = stand.join(final, F.col("doc_id") == F.col("node"), "left").select("ka", "kb", F.coalesce("root", "doc_id").alias("__class"))
    set_of = profiles.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("ka")).alias("ka"), F.when(F.col("n_shingles") > 0, F.col("kb")).alias("kb"))
    return set_of.join(named, ["ka", "kb"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("__class", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs that stand for their class: those whose doc_id is the class id (and those without a doc_id)."""
    gone = settled(docs.sparkSession, "gone", lambda: classes(docs, n, num, den).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti")
