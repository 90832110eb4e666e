"""Mixing sources to target weights by iterative proportional fitting.

Token counts per (source, language, topic) cell are raked in turn to the three target marginals until all agree. A document
is then kept with its cell's probability, decided by a hash of doc_id and text, so a rerun keeps the same documents.

Probabilities are bounded by 1 inside the fit: a value that is asked for more tokens than it has is kept whole, and raking goes on
with the others. The size of the sample is the largest at which this leaves no share further from its target than allowed: targets
that the caller gives are held (the sample shrinks for them), tempered ones may miss by `slack`, so that a rare value with a few
tokens does not set the size of the corpus. `balance` returns expected against target shares.

Only cells are iterated on, never documents; the cell table stays a DataFrame, and its lineage is cut by a written table. Up to
`FEW_CELLS` cells are one partition, so that a round needs no shuffle; more cells are shuffled.

Defined cases: null source, language or topic form a value of their own; a null or empty text has 0 tokens and takes its
cell's probability; a target value without tokens is ignored and the rest scaled up; without tokens all factors are 1;
repeated rows are decided alike; input columns named like a result column are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from carsift.llm.scratch import settled, unused_name, written

AXES = ("source", "lang", "topic")
FEW_CELLS = 100_000
NONE = "\u0000"  # stands for null among an axis' values
RESULT = ("source", "lang", "topic", "n_tokens", "factor", "probability", "kept")


def n_tokens(text: str = "text") -> Column:
    """Words: runs of characters other than U+0020 and U+0009 to U+000D."""
    parts = F.split(F.coalesce(text, F.lit("")), "[\\x09-\\x0D ]+")  # white space at an end leaves an empty part there
    return F.greatest(F.lit(0), F.size(parts) - (parts[0] == "").cast("int") - (F.element_at(parts, -1) == "").cast("int")).cast("long")


def topic_of(text: str = "text") -> Column:
    """A plain default for tables without topics: the form of the text."""
    t = F.coalesce(text, F.lit(""))
    return (
        F.when(F.length(t) - F.length(F.translate(t, "|", "")) > F.length(t) / 50, "table")
        .when(F.length(t) - F.length(F.translate(t, "0123456789", "")) > F.length(t) / 10, "numbers")
        .when(F.length(t) < 500, "note").when(F.length(t) < 3000, "article").otherwise("long read"))


def tempered(cells: DataFrame, axis: str, power: float) -> DataFrame:
    """Target shares of an axis: its token shares raised to a power below 1, so that large values weigh less."""
    sums = cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("s")).where("s > 0")
    return sums.select(axis, F.pow("s", F.lit(power)).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, DataFrame], tolerance: float = 1e-4, most_rounds: int = 60) -> DataFrame:
    """cells (axes.., tokens) -> with factor. targets: for an axis (value, target) in any scale.

    Targets that no factors can meet together (cells are missing) end when another round changes nothing, or after most_rounds.
    """
    axes = list(targets)
    now = cells.withColumn("factor", F.lit(1.0))
    for axis in axes:
        now = now.join(targets[axis].withColumnRenamed("target", f"t_{axis}"), axis, "left")
    now = written(now, "cells")
    whole, count = now.agg(F.sum("tokens"), F.count("*")).first()
    if not whole:
        return now.select(*cells.columns, "factor")
    gathered = _gathered(count)
    now = gathered(now)
    before, total = float("inf"), whole
    for _ in range(most_rounds):
        for axis in axes:
            mine = Window.partitionBy(axis)
            mass = F.sum(F.col("tokens") * F.col("factor")).over(mine)
            now = now.withColumn("mass", mass).withColumn("factor", F.when((F.col("mass") > 0) & F.col(f"t_{axis}").isNotNull(), F.col("factor") * F.col(f"t_{axis}") / F.col("mass")).when(F.col("mass") > 0, 0.0).otherwise(F.col("factor"))).drop("mass")
        now = gathered(written(now, "cells"))
        off, total = _misfit(now, axes)
        if not total:
            raise ValueError("the targets leave no tokens")
        if off <= tolerance or abs(before - off) <= tolerance / 100:
            break
        before = off
    return now.select(*cells.columns, (F.col("factor") * (whole / total)).alias("factor"))


def _gathered(cells: int) -> Callable[[DataFrame], DataFrame]:
    """How to lay out a table of so many cells: a small one in one partition, which windows and sums need not shuffle."""
    return lambda now: now.coalesce(1) if cells <= FEW_CELLS else now


def _misfit(now: DataFrame, axes: list[str]) -> tuple[float, float]:
    """Largest distance between a share and its target on any axis, and all fitted tokens."""
    mass = F.col("tokens") * F.col("factor")
    sides = F.array(*[F.struct(F.lit(x).alias("axis"), F.col(x).alias("value"), F.col(f"t_{x}").alias("target"), mass.alias("mass")) for x in axes])
    by = now.select(F.explode(sides).alias("s")).groupBy("s.axis", "s.value").agg(F.sum("s.mass").alias("got"), F.max("s.target").alias("target")).where("got > 0")
    whole = Window.partitionBy("axis")
    shares = by.select("axis", "got", F.abs(F.col("got") / F.sum("got").over(whole) - F.col("target") / F.sum("target").over(whole)).alias("off"))
    off, total = shares.agg(F.max("off"), F.sum("got")).first()
    return off or 0.0, (total or 0.0) / len(axes)


def _sides(cells: DataFrame, targets: Mapping[str, DataFrame], slacks: Mapping[str, float]) -> DataFrame:
    """axis, value, has (share of all tokens), target (share, over values with tokens), slack: one row per value with tokens."""
    parts = []
    for axis, wanted in targets.items():
        sums = cells.groupBy(axis).agg(F.sum("tokens").cast("double").alias("s")).where("s > 0").join(wanted, axis, "left")
        every = Window.partitionBy(F.lit(axis))
        parts.append(sums.select(F.lit(axis).alias("axis"), F.col(axis).alias("value"), (F.col("s") / F.sum("s").over(every)).alias("has"),
                                 (F.coalesce("target", F.lit(0.0)) / F.sum("target").over(every)).alias("target"), F.lit(slacks[axis]).alias("slack")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return written(out, "sides")


def bounded(cells: DataFrame, targets: Mapping[str, DataFrame], keep: float, slacks: Mapping[str, float], tolerance: float = 1e-4, most_rounds: int = 60) -> DataFrame:
    """cells -> with factor, probability and target_<axis>: raking of the expected sample under probability <= 1.

    The sample's share of all tokens starts at `keep`, or where a value's own tokens fall short of its target by its axis' slack,
    and is halved while cells together miss a target by more than that, at most down to where no probability is cut.
    """
    raked = written(rake(cells, targets, tolerance, most_rounds), "raked")
    whole, largest, count = raked.agg(F.sum(F.when(F.col("tokens") > 0, F.col("tokens"))), F.max(F.when(F.col("tokens") > 0, F.col("factor"))), F.count("*")).first()
    if not whole:
        blank = [F.lit(None).cast("double").alias(f"target_{x}") for x in targets]
        return raked.select("*", F.least(F.lit(1.0), F.col("factor") * keep).alias("probability"), *blank)
    sides = _sides(cells, targets, slacks)
    share = min(1.0, keep, sides.where("target > slack").agg(F.min(F.col("has") / (F.col("target") - F.col("slack")))).first()[0] or 1.0)
    uncut = min(1.0, keep, 1 / largest)
    start = raked
    for axis in targets:
        start = start.join(sides.where(F.col("axis") == axis).select(F.col("value").alias(axis), F.col("target").alias(f"target_{axis}")), axis, "left")
    gathered = _gathered(count)
    start = gathered(written(start, "cells"))
    while True:
        share = max(share, uncut)
        now = start.withColumn("factor", F.col("factor") * share)
        before, rounds = float("inf"), 0
        while True:
            over, off = _missed(now, slacks)
            if off <= tolerance or abs(before - off) <= tolerance / 100 or rounds == most_rounds or share <= uncut:
                break
            for axis in targets:
                now = now.withColumn("mass", F.sum(F.col("tokens") * F.least(F.lit(1.0), "factor")).over(Window.partitionBy(axis)))
                step = F.col(f"target_{axis}") * (share * whole) / F.col("mass")
                now = now.withColumn("factor", F.when(F.col("mass") > 0, F.least(F.lit(1e6), F.col("factor") * step)).otherwise(F.col("factor"))).drop("mass")
            now, before, rounds = gathered(written(now, "cells")), off, rounds + 1
        if over <= tolerance or share <= uncut:
            break
        share /= 2
    if over > tolerance:
        warnings.warn(f"the targets cannot be met together, or not within {most_rounds} rounds: a share is off by {off:.4f}", stacklevel=2)
    return now.withColumn("probability", F.least(F.lit(1.0), "factor")).withColumn("factor", F.col("factor") / share)


def balance(fitted: DataFrame) -> DataFrame:
    """axis, value, tokens, target, expected: for cells of `bounded` each value's target share and the share to expect in the sample."""
    mass = (F.col("tokens") * F.col("probability")).alias("mass")
    axes = [c.removeprefix("target_") for c in fitted.columns if c.startswith("target_")]
    each = F.array(*[F.struct(F.lit(x).alias("axis"), F.col(x).alias("value"), F.col(f"target_{x}").alias("target"), "tokens", mass) for x in axes])
    by = fitted.select(F.explode(each).alias("s")).groupBy("s.axis", "s.value").agg(
        F.sum("s.tokens").alias("tokens"), F.max("s.target").alias("target"), F.sum("s.mass").alias("mass"))
    return by.withColumn("expected", F.try_divide("mass", F.sum("mass").over(Window.partitionBy("axis")))).drop("mass")


def _missed(now: DataFrame, slacks: Mapping[str, float]) -> tuple[float, float]:
    """The most by which an expected share misses its target beyond its slack, and without regard to the slack."""
    got = balance(now.withColumn("probability", F.least(F.lit(1.0), "factor"))).where("tokens > 0")
    off = F.abs(F.col("expected") - F.coalesce("target", F.lit(0.0)))
    slack = F.coalesce(*[F.when(F.col("axis") == axis, F.lit(x)) for axis, x in slacks.items()])
    over, most = got.agg(F.max(off - slack), F.max(off)).first()
    return over or 0.0, most or 0.0


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, topic: Column | None = None, power: float = 0.8,
        keep: float = 0.8, seed: int = 5, slack: float = 0.01) -> DataFrame:
    """doc_id, text_key, source, lang, topic, n_tokens, factor, probability, kept for every document.

    targets: axis -> value -> share; an axis left out is tempered by `power` and may miss a share by `slack`. keep: largest
    share of all tokens to expect in the sample; it is less where given targets ask for more than there is of a value.
    """
    spark = docs.sparkSession
    text_topic = topic if topic is not None else (F.col("topic") if "topic" in docs.columns else topic_of())
    value = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    marked = docs.select("doc_id", F.xxhash64("text").alias("text_key"), value(F.col("source")).alias("source"), value(F.col("lang")).alias("lang"), value(text_topic).alias("topic"), n_tokens().alias("n_tokens"))
    marked = written(marked, "marked")  # the texts are read once; what follows needs these columns only
    cells = written(marked.groupBy(*AXES).agg(F.sum("n_tokens").alias("tokens")), "cells")
    wanted, slacks = {}, {}
    for axis in AXES:
        given = (targets or {}).get(axis)
        slacks[axis] = slack if given is None else 1e-4
        if given is None:
            wanted[axis] = tempered(cells, axis, power)
        else:
            wanted[axis] = spark.createDataFrame([(NONE if k is None else str(k), float(v)) for k, v in given.items()], f"{axis} string, target double")
    odds = bounded(cells, wanted, keep, slacks).select(*AXES, "factor", "probability")
    draw = F.pmod(F.xxhash64("doc_id", "text_key", F.lit(seed)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    null = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return marked.join(odds, list(AXES)).select(
        "doc_id", "text_key", *[null(c) for c in AXES], "n_tokens", "factor", "probability", (draw < F.col("probability")).alias("kept"))


def sampled(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """The rows of docs that the mix keeps."""
    mark = unused_name(docs)
    chosen = F.struct("doc_id", "text_key").alias(mark)
    kept = settled(docs.sparkSession, "kept", lambda: mix(docs, targets, **options).where("kept").select(chosen).distinct())
    same = F.col("doc_id").eqNullSafe(F.col(f"{mark}.doc_id")) & (F.xxhash64("text") == F.col(f"{mark}.text_key"))
    return docs.join(kept, same, "left_semi").select(*(columns or docs.columns))
