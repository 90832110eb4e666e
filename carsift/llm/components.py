"""Connected components by alternating large-star and small-star steps: a distributed union-find on DataFrames.

Every step groups edges by node and hooks them to the smallest neighbour; the edge set ends as stars around each component's
smallest node. Nothing is collected but two totals per round, by which the end is recognised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from carsift.llm.scratch import written


def _directed(edges: DataFrame) -> DataFrame:
    """Edges as (u, v) with u > v, without loops and repeats."""
    return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _directed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hooked = edges.join(least, "u")
    return _directed(hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))))


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of any order -> (node, root) for every node that has an edge; root is its component's smallest node."""
    now = written(_directed(edges), "edges")
    total = lambda e: e.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    before = total(now)
    while before[0]:
        now = written(_small_star(_large_star(now)), "edges")
        after = total(now)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node")).distinct().join(now.select(F.col("u").alias("node")), "node", "left_anti").select("node", F.col("node").alias("root")))
