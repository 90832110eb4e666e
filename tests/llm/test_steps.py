"""Steps shared by operators: tiles of the same items, fine bitmaps, shuffle files of written tables, rounds without a shuffle."""

import random
import time

from pyspark.sql import functions as F

from carsift.llm import line_dedup, mixing, scratch, tiles


def test_tiles_of_the_same_items_stay_once(spark):
    rows = [(1, 5), (1, 6), (2, 5), (2, 6), (3, 5), (3, 7), (4, 5), (4, 5), (4, 6), (6, 8), (7, 6), (7, 5), (7, 7)]
    got = {}
    for r in tiles.candidate_tiles(spark.createDataFrame(rows, "key long, id long")).collect():
        got.setdefault((r["key"], r["lead"]), []).append(r["id"])
    assert {k: sorted(v) for k, v in got.items()} == {(1, 5): [5, 6], (3, 5): [5, 7], (4, 5): [5, 5, 6], (7, 5): [5, 6, 7]}


def test_fine_bitmaps_tell_long_lines_apart(spark):
    rnd = random.Random(4)
    base = [rnd.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(900)]

    def edited(n):
        line = list(base)
        for i in range(n):
            line[20 + i * (860 // n)] = "#"
        return "".join(line)

    lines = ["".join(base), edited(8), edited(24)]
    sets = [{x[j : j + 10] for j in range(len(x) - 9)} for x in lines]
    alike = [len(sets[0] & s) / len(sets[0] | s) for s in sets]
    assert alike[1] > 0.8 > 0.65 > alike[2] > 0.5
    signs = line_dedup.bitmaps(spark.createDataFrame(list(enumerate(lines)), "k1 long, line string"), line_dedup.SHINGLE)
    a, b = (signs.select(*[signs[c].alias(f"{side}_{c}") for c in signs.columns]) for side in "ab")
    pairs = a.where("a_id = 0").join(b, F.col("a_id") < F.col("b_id"))
    coarse = pairs.where(tiles.may_link("a_n", "b_n", "a_bits", "b_bits", 4, 5))
    fine = pairs.where(tiles.may_link_finely("a_n", "b_n", "a_fine", "b_fine", 4, 5))
    assert {r["b_id"] for r in coarse.collect()} == {1, 2}
    assert {r["b_id"] for r in fine.collect()} == {1}


def test_written_tables_leave_no_shuffle_files(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in (disk.getAllBlocks().apply(i).name() for i in range(disk.getAllBlocks().size())) if f.startswith("shuffle_")}
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, setting = shuffled(), spark.conf.get(name)
    out = scratch.written(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count(), "counts")
    assert sorted(r["count"] for r in out.collect()) == [100] * 10
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.2)
    assert not shuffled() - before
    assert spark.conf.get(name) == setting


def test_rounds_of_few_cells_are_not_shuffled(spark, monkeypatch):
    plans = []

    def watched(df, name, *rest):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return scratch.written(df, name, *rest)

    monkeypatch.setattr(mixing, "written", watched)
    cells = spark.createDataFrame([(s, x, t, 10 * (i + 1)) for i, (s, x, t) in enumerate((s, x, t) for s in "ab" for x in "cd" for t in "ef")], "source string, lang string, topic string, tokens long")
    wanted = {axis: mixing.tempered(cells, axis, 0.5) for axis in mixing.AXES}
    got = mixing.bounded(cells, wanted, 0.8, dict.fromkeys(mixing.AXES, 0.01))
    assert got.count() == 8
    rounds = [p for _, p in [x for x in plans if x[0] == "cells"][1:] if "Window" in p]
    assert rounds and not any("Exchange" in p for p in rounds)
