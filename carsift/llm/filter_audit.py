"""Filter interaction audit: what every order of a set of filters keeps, removes and finds removed already.

Every filter leaves a relation: the ids of the documents that fail it (one id table per filter, written by `failing_ids`).
After a prefix of filters, the removals of the next one are its relation left-anti joined with the relations of the prefix;
its redundant failures are what left-semi joins find that the prefix took. A prefix counts by its set alone, so 31 sets serve all
120 orders of five filters. All these joins run on ids that were shuffled once; texts are read once.

Copies (`copy_of_smaller`) are found by a 128-bit hash of the text: the smallest doc_id of a text is taken over salted parts
first, so a text that a third of all rows share loads no task.

Defined cases: a null text counts as empty; a null part is the empty string; a null doc_id is nobody's copy, has none and no labels;
repeated rows count as often as they occur (a relation keeps one row with its number); a document is good or toxic if any of
its label rows says so; other columns of the input are not read; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carsift.llm.scratch import scratch_path, written

NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
# letter -> the condition under which a document fails, over the columns of `measured`
FILTERS = {
    "A": "n_words < 50",
    "B": "100 * n_distinct < 65 * n_words",
    "C": "100 * n_upper > 5 * n_chars",
    "D": "has_symbol",
    "E": "coalesce(first_id < doc_id, false)",
}
ID = ["doc_id", "version"]  # version tells texts of a repeated doc_id apart
PARTS = 64  # salts of a text's copies, at least


def _count_words(batches):
    for batch in batches:
        words, distinct, upper = [], [], []
        for text in batch.column(0).cast(pa.binary()):
            raw = text.as_py()
            found = raw.split()  # of bytes: at U+0020 and U+0009 to U+000D only
            words.append(len(found))
            distinct.append(len(set(found)))
            upper.append(len(raw.translate(None, NOT_UPPER)))
        counts = [pa.array(c, pa.int64()) for c in (words, distinct, upper)]
        yield pa.RecordBatch.from_arrays([*batch.columns[1:], *counts], [*batch.schema.names[1:], "n_words", "n_distinct", "n_upper"])


def measured(docs: DataFrame, part: str = "source") -> DataFrame:
    """One narrow row per document; the only step that reads texts."""
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "text", "doc_id", "part", F.xxhash64("text", "part", F.col("doc_id").isNull()).alias("version"), F.unhex(F.md5("text")).alias("copy_key"),
        F.length("text").cast("long").alias("n_chars"), F.col("text").rlike("[#$%&*|]").alias("has_symbol"),
    )
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes[1:])
    return rows.mapInArrow(_count_words, kinds + ", n_words long, n_distinct long, n_upper long")


def copy_of_smaller(rows: DataFrame, salts: int) -> DataFrame:
    """rows with first_id, the smallest doc_id of the same text; null where a text has one doc_id only."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
    some = salted.groupBy("copy_key", "salt").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    whole = some.groupBy("copy_key").agg(F.min("lo").alias("first_id"), F.max("hi").alias("hi")).where("first_id < hi").drop("hi")
    firsts = some.select("copy_key", "salt").join(whole, "copy_key")
    return salted.join(firsts, ["copy_key", "salt"], "left").drop("salt")


def failing_ids(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None, part: str = "source") -> DataFrame:
    """One id table per filter: filter, doc_id, version, part, copies (equal rows), good, toxic; written to the shared folder."""
    filters = filters or FILTERS
    salts = max(PARTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = copy_of_smaller(written(measured(docs, part), "measured"), salts)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    failed = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in filters.items()]))
    some = rows.withColumn("failed", failed).where(F.size("failed") > 0).select(*ID, "part", "failed").join(marks, "doc_id", "left")
    no = F.lit(False)
    ids = some.select(*ID, "part", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), F.explode("failed").alias("filter"))
    tables = ids.groupBy("filter", *ID, "part", "good", "toxic").agg(F.count("*").alias("copies"))
    return written(tables, "failing", partition_by="filter")


def set_counts(fails: DataFrame, names: list[str]) -> DataFrame:
    """part, key (set of the prefix and filter), removed, redundant, good_lost, toxic_lost; only where something failed.

    `left` holds, for every set of the filters seen so far, the failures of documents that outlive the set; each filter doubles
    it by an anti join, written before the next one. What a filter takes, found by a semi join, is redundant to every set that begins with the same filters.
    """
    zero = F.lit(0).cast("long")
    count = {"removed": F.col("copies"), "good_lost": F.when(F.col("good"), F.col("copies")), "toxic_lost": F.when(F.col("toxic"), F.col("copies"))}
    # a null never equals a null in a join, so rows without doc_id are matched by a stand-in; version tells them from real ids
    rows = fails.withColumn("doc_id", F.coalesce("doc_id", F.lit(-1 << 63)))
    folder = scratch_path(fails.sparkSession, "left")
    rows.withColumn("mask", F.lit(0)).write.parquet(f"{folder}/0")
    taken = []
    for f, name in enumerate(names):
        left = rows.sparkSession.read.parquet(*[f"{folder}/{k}" for k in range(f + 1)])
        ids, after = rows.where(F.col("filter") == name).select(*ID), (F.col("mask") + (1 << f)).alias("mask")
        columns = [c for c in left.columns if c != "mask"]
        taken.append(left.join(ids, ID, "left_semi").select(*columns, after, F.lit(f).alias("last")))
        left.join(ids, ID, "left_anti").select(*columns, after).write.parquet(f"{folder}/{f + 1}")
    left = rows.sparkSession.read.parquet(*[f"{folder}/{k}" for k in range(len(names) + 1)])
    every = reduce(DataFrame.unionByName, taken, left.withColumn("last", F.lit(-1)))
    counts = every.groupBy("part", "filter", "mask", "last").agg(*[F.sum(c).alias(n) for n, c in count.items()])
    kept, n = F.col("last") == -1, len(names)
    later = F.expr(f"transform(sequence(0, (1 << ({n - 1} - last)) - 1), m -> mask + m * (1 << (last + 1)))")
    cells = counts.select("part", "filter", *[F.when(kept, F.col(c)).alias(c) for c in count], F.when(~kept, F.col("removed")).alias("redundant"),
                          F.explode(F.when(kept, F.array("mask")).otherwise(later)).alias("set"))
    place = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("filter")) - 1
    key = (F.col("set") * len(names) + place).cast("int").alias("key")
    return cells.groupBy("part", key).agg(*[F.coalesce(F.sum(c), zero).alias(c) for c in (*count, "redundant")])


def orders(names: list[str]) -> Column:
    """Every order and step as a constant: the step's key and those of all steps up to it."""
    steps, n = [], len(names)
    for order in permutations(names):
        mask, keys = 0, []
        for step, name in enumerate(order, 1):
            f = names.index(name)
            keys.append(mask * n + f)
            mask |= 1 << f
            lits = F.array(*[F.lit(k) for k in keys])
            steps.append(F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(step).alias("step"), F.lit(f).alias("f"), lits.alias("keys")))
    return F.array(*steps)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] | None = None, part: str = "source") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: all orders, zeros included."""
    names = list(filters or FILTERS)
    n, full = len(names), (1 << len(names)) - 1
    counts = set_counts(failing_ids(docs, labels, filters, part), names)
    values = ["removed", "redundant", "good_lost", "toxic_lost"]
    by_part = counts.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct(*values)))).alias("m"))
    totals = docs.groupBy(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part")).agg(F.count("*").alias("total"))
    none = F.struct(*[F.lit(0).cast("long").alias(v) for v in values])
    dense = F.transform(F.sequence(F.lit(0), F.lit((full + 1) * n - 1)), lambda k: F.coalesce(F.col("m")[k], none))
    wide = totals.join(by_part, "part", "left").select("part", "total", dense.alias("m"))
    # an array item per filter: failures of it alone, its removals summed over all orders
    own = []
    for f in range(n):
        before = [s for s in range(full + 1) if not s >> f & 1]
        weight = {s: factorial(s.bit_count()) * factorial(n - 1 - s.bit_count()) for s in before}
        cells = F.array(*[F.struct(F.lit(s * n + f).alias("k"), F.lit(weight[s]).cast("long").alias("w")) for s in before])
        shapley = F.aggregate(cells, F.lit(0).cast("long"), lambda a, c: a + c["w"] * F.col("m")[c["k"]]["removed"])
        own.append(F.struct(F.col("m")[(full ^ (1 << f)) * n + f]["removed"].alias("alone"), shapley.alias("shapley")))
    rows = wide.withColumn("own", F.array(*own)).select("part", "total", "m", "own", F.explode(orders(names)).alias("o"))
    here, mine = F.col("m")[F.element_at("o.keys", -1)], F.col("own")[F.col("o.f")]
    gone = F.aggregate("o.keys", F.lit(0).cast("long"), lambda a, k: a + F.col("m")[k]["removed"])
    return rows.select(
        "part", "o.filter_order", "o.step", (F.col("total") - gone).alias("kept"), here["removed"].alias("removed"),
        here["redundant"].alias("redundant"), mine["alone"].alias("unique_fails"), here["good_lost"].alias("good_lost"),
        here["toxic_lost"].alias("toxic_lost"), mine["shapley"].alias("shapley"),
    )
