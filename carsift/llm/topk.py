"""Exact top-k by integer inner product.

Vectors are turned into integers, rotated by the right singular vectors of a sample of them (so the first coordinates hold most
of the length) and dealt into blocks by descending length. Each block of queries first meets the block of longest vectors,
whose scores give every query a bound it must beat. In every other block a pair is dropped as soon as its partial sum over the
first rotated coordinates plus the product of the residual lengths (Cauchy-Schwarz) stays below that bound; what remains gets
its exact integer score. Bounds carry a margin for rounding, so no result is lost.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded with
zeros; rows that repeat a vec_id count once (the smallest vector); a query never meets its own vec_id; ties go to the smaller
vec_id; a query with fewer than k candidates gets them all; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carsift.llm.scratch import written

BLOCK = 8192    # candidates in a block
SLABS = 256     # blocks are dealt by length this finely, then by a hash
FITTED = 4096   # vectors that the rotation is fitted on
QUERIES = 1024  # queries in a block
STEPS = 4       # partial sums
DENSE = 512     # a query with so few pairs left in a block scores them outright


def integers(rows: DataFrame, vector: Column, vec_id: str = "vec_id", scale: float = 1024.0) -> DataFrame:
    """vec_id, v (array of long), length: floor(scale * component) of all usable vectors, one row per vec_id."""
    v = vector.cast("array<double>")
    usable = vector.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x * scale).cast("long"))
    made = rows.where(F.col(vec_id).isNotNull() & F.coalesce(usable, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("v"))
    one = made.groupBy("vec_id").agg(F.min("v").alias("v"))
    return one.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))))


def _packed(dim: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((len(frame), dim), np.int64)
        for i, v in enumerate(frame["v"]):
            m[i, : len(v)] = v
        return pd.DataFrame({"block": [key[0]], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()], "m": [m.tobytes()]})

    return run


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _search(dim: int, rotation: np.ndarray, k: int, bounded: bool):
    """One block of queries against one block of candidates."""
    cuts = np.unique(np.linspace(0, dim, STEPS + 1).astype(int))[1:]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame.itertuples(index=False):
            qid, cid = np.frombuffer(r.q_ids, np.int64), np.frombuffer(r.ids, np.int64)
            q, c = np.frombuffer(r.q_m, np.int64).reshape(-1, dim), np.frombuffer(r.m, np.int64).reshape(-1, dim)
            floor = np.frombuffer(r.q_floor, np.float64) if bounded else np.full(len(qid), -np.inf)
            qr, cr = q @ rotation, c @ rotation
            q_left, c_left = (np.sqrt(np.maximum(0, (x * x).sum(1, keepdims=True) - np.cumsum(x * x, axis=1))) for x in (qr, cr))
            q_len, c_len = np.sqrt((qr * qr).sum(1)), np.sqrt((cr * cr).sum(1))
            for i in range(len(qid)):
                slack = 1e-6 * (1 + q_len[i] * c_len.max(initial=0))
                live = np.flatnonzero((cid != qid[i]) & (q_len[i] * c_len >= floor[i] - slack))
                part, at = np.zeros(len(live)), 0
                for cut in cuts:
                    if len(live) <= DENSE:
                        break
                    part = part + cr[live, at:cut] @ qr[i, at:cut]
                    may = part + q_left[i, cut - 1] * c_left[live, cut - 1] >= floor[i] - slack
                    live, part, at = live[may], part[may], cut
                scores = c[live] @ q[i]
                top = _best(scores, cid[live], k)
                out.append(pd.DataFrame({"query_id": qid[i], "vec_id": cid[live][top], "score": scores[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return lambda frames: (run(f) for f in frames)


def search(rows: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", vec_id: str = "vec_id", scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each row for which is_query holds, against all other rows."""
    spark = rows.sparkSession
    vectors = written(integers(rows, F.col(vector), vec_id, scale), "vectors")
    n, dim = vectors.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n or not dim:
        return empty
    # any rotation gives exact results; a good one comes from a sample of about FITTED vectors
    share = min(1.0, FITTED / n)
    sample = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(2)), F.lit(1 << 30)) < int(share * (1 << 30))).select("v").toLocalIterator()
    fitted = np.array([[*r["v"], *[0] * (dim - len(r["v"]))] for r in sample], float).reshape(-1, dim)
    rotation = np.linalg.svd(fitted, full_matrices=len(fitted) < dim)[2].T.copy()

    # blocks by descending length: equal shares of the rows, from the lengths' quantiles
    blocks = max(1, -(-n // BLOCK))
    slabs = min(SLABS, blocks)
    edges = vectors.stat.approxQuantile("length", [i / slabs for i in range(1, slabs)], 1 / (4 * slabs)) if slabs > 1 else []
    block = F.lit(0)
    for e in edges:
        block = block + (F.col("length") < F.lit(float(e))).cast("int")
    # a slab of more rows (many vectors, or many of one length) is split by a hash
    placed = vectors.withColumn("slab", block)
    crowd = placed.groupBy("slab").agg(F.ceil(F.count("*") / (2 * BLOCK)).cast("int").alias("cuts"))
    placed = placed.join(crowd, "slab").withColumn("block", F.struct("slab", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int").alias("part")))
    packed = written(placed.select(F.to_json("block").alias("block"), "vec_id", "v").groupBy("block").applyInPandas(_packed(dim), "block string, ids binary, m binary"), "blocks")
    longest = placed.where("slab = 0").agg(F.min(F.to_json("block"))).first()[0]

    asked = vectors.where(is_query)
    parts = max(1, -(-asked.count() // QUERIES))
    asked = written(asked.select(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts)).cast("string").alias("block"), "vec_id", "v").groupBy("block")
                    .applyInPandas(_packed(dim), "block string, ids binary, m binary"), "queries").withColumnsRenamed({"block": "q_block", "ids": "q_ids", "m": "q_m"})
    schema = "query_id long, vec_id long, score long"
    first = written(asked.crossJoin(F.broadcast(packed.where(F.col("block") == longest))).repartition(parts, "q_block").mapInPandas(_search(dim, rotation, k, False), schema), "first")
    lowest = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")).where("floor is not null")
    # the bounds travel with the query blocks
    flat = asked.mapInArrow(_unpacked, "q_block string, at long, vec_id long")
    bounds = flat.join(lowest, flat["vec_id"] == lowest["query_id"], "left").groupBy("q_block").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce(F.col("floor").cast("double"), F.lit(float("-inf"))).alias("f")))).alias("b"))
    ready = asked.join(bounds.select("q_block", "b.f"), "q_block").mapInArrow(_floored, "q_block string, q_ids binary, q_m binary, q_floor binary")
    ready = written(ready, "ready")
    # the stated queries, in blocks, against all other blocks
    names = packed.where(F.col("block") != longest)
    pairs = names.crossJoin(ready).repartition(max(1, blocks * parts), "block", "q_block")
    rest = pairs.mapInPandas(_search(dim, rotation, k, True), schema)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _unpacked(batches):
    for batch in batches:
        for block, ids in zip(batch.column(0), batch.column(1)):
            v = np.frombuffer(ids.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([block.as_py()] * len(v)), pa.array(np.arange(len(v))), pa.array(v)], ["q_block", "at", "vec_id"])


def _floored(batches):
    for batch in batches:
        f = [np.array([y for y in x.as_py()], float).tobytes() for x in batch.column(3)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(f, pa.binary())], ["q_block", "q_ids", "q_m", "q_floor"])
