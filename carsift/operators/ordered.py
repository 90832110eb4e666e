"""Order-dependent operators over keys that may be very large.

A plain window puts all rows of a key into one task. Here every key is cut into buckets of the order column; the window
runs inside (key, bucket), each bucket is summarised to one row, and the summaries (one row per key and bucket) carry the
state across bucket borders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lag_by_key(df: DataFrame, keys: list[str], order: str, bucket: Column, values: list[str], prefix: str = "prev_",
               least: dict[str, Column] | None = None) -> DataFrame:
    """Adds prev_<value>: the values of the preceding row of the key. `bucket` must grow with `order` (a unique number).

    least: name -> column; adds its smallest value over the key's rows up to and including the row. Null keys are one key.
    """
    least = least or {}
    # key and bucket as one struct, which is never NULL: a join on columns that may be NULL would filter one of its sides
    # below the shuffle, and the input would then be computed and shuffled once for each side
    b = df.withColumn("_cell", F.struct(*keys, bucket.alias("_bucket")))
    inside = W.partitionBy("_cell").orderBy(order)
    packed = F.struct(F.col(order).alias("_o"), *values)
    rows = b.withColumns({"_lag": F.lag(packed).over(inside)} | {f"_least_{n}": F.min(x).over(inside) for n, x in least.items()})
    # from the windowed rows, which lie together by key and bucket already
    ends = rows.withColumn("_next", F.lead(F.col(order)).over(inside)).where(F.col("_next").isNull())
    last = ends.select("_cell", packed.alias("_last"), *[f"_least_{n}" for n in least])
    across = W.partitionBy(*[F.col("_cell")[k] for k in keys]).orderBy(F.col("_cell")["_bucket"])
    earlier = across.rowsBetween(W.unboundedPreceding, -1)
    carry = last.select("_cell", F.lag("_last").over(across).alias("_carry"), *[F.min(f"_least_{n}").over(earlier).alias(f"_before_{n}") for n in least])
    # only the first row of each bucket needs the carried value; the others already have theirs
    # (rows without an order are several ends of one bucket: they are given nothing, or they would be multiplied)
    some = F.col("_carry").isNotNull() & F.col("_cell")["_bucket"].isNotNull()
    joined = rows.join(carry.filter(some), "_cell", "left")
    prev = F.coalesce("_lag", "_carry")
    return joined.withColumns({prefix + v: prev[v] for v in values} | {n: F.least(f"_least_{n}", f"_before_{n}") for n in least}).drop(
        "_cell", "_lag", "_carry", *[f"{p}_{n}" for n in least for p in ("_least", "_before")])


def streaks(df: DataFrame, key: str, order: str, bucket: Column, flag: Column) -> DataFrame:
    """Adds `streak`: the number of consecutive rows with `flag` up to and including the row (0 where the flag is false)."""
    b = df.withColumns({"_bucket": bucket, "_flag": flag})
    inside = W.partitionBy(key, "_bucket").orderBy(order)
    to_here = inside.rowsBetween(W.unboundedPreceding, 0)
    rows = b.withColumn("_n", F.row_number().over(inside)).withColumn(
        "_last_break", F.max(F.when(~F.col("_flag"), F.col("_n"))).over(to_here))
    # one row per bucket: its length and the length of its trailing run
    tail = rows.groupBy(key, "_bucket").agg(F.count("*").alias("n"), F.max(F.when(~F.col("_flag"), F.col("_n"))).alias("lb"))
    tail = tail.withColumn("trailing", F.col("n") - F.coalesce("lb", F.lit(0)))
    across = W.partitionBy(key).orderBy("_bucket")
    # buckets without a break join the run that started after the last break of an earlier bucket
    runs = tail.withColumn("run", F.sum(F.col("lb").isNotNull().cast("int")).over(across))
    open_run = W.partitionBy(key, "run").orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)
    ends = runs.withColumn("open_length", F.sum("trailing").over(open_run)).withColumn(
        "_carry", F.lag("open_length", 1, 0).over(across)).select(key, "_bucket", "_carry")
    joined = rows.join(ends, [key, "_bucket"], "left")
    length = F.col("_n") - F.coalesce(F.col("_last_break"), F.lit(0)) + F.when(F.col("_last_break").isNull(), F.col("_carry")).otherwise(0)
    return joined.withColumn("streak", F.when(F.col("_flag"), length).otherwise(0).cast("bigint")).drop(
        "_bucket", "_flag", "_n", "_last_break", "_carry")
