"""Scoring is computed once per query, and only the parts that the query's columns need."""

import random

import pytest
from pyspark.sql import functions as F

from carsift.operators import ordered
from carsift.plans.catalog import QUERIES

c = F.col
DATA = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_unused_keyword_hits_are_not_computed(spark):
    assert "opp_hits" not in _plan(QUERIES["I4b_km_v2"](spark, DATA))
    assert "risk_hits" not in _plan(QUERIES["I7_keywords_v3"](spark, DATA))
    assert "opp_hits" not in _plan(QUERIES["I9_bonus_v3"](spark, DATA))


@pytest.mark.parametrize("name", ["I1_score_v3", "H35_breakdown_json", "E5_newest_near_duplicate"])
def test_hits_are_sorted_without_a_lambda(spark, name):
    assert "array_sort" not in _plan(QUERIES[name](spark, DATA))


def test_orphans_score_listings_once(spark):
    assert _plan(QUERIES["C14_orphan_notifications"](spark, DATA)).count("Generate inline") == 2


@pytest.mark.parametrize("name", ["E8_price_and_score_changes", "J4_change_alerts"])
def test_order_queries_shuffle_one_scoring(spark, name):
    df = QUERIES[name](spark, DATA)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("Generate inline(array(struct(total") == 1


def test_lag_by_key_of_null_keys_and_running_minimum(spark):
    rnd = random.Random(7)
    rows = [(i, rnd.choice([None, "a", "a", f"k{i % 40}"]), rnd.randint(0, 9)) for i in range(500)]
    last, low, want = {}, {}, {}
    for i, k, v in rows:
        if v >= 8:
            low.setdefault(k, i)
        want[i] = (last.get(k), low.get(k))
        last[k] = v
    df = spark.createDataFrame(rows, "i long, k string, v int")
    got = ordered.lag_by_key(df, ["k"], "i", F.floor(c("i") / 11), ["v"], least={"hit": F.when(c("v") >= 8, c("i"))})
    assert {r.i: (r.prev_v, r.hit) for r in got.collect()} == want


def test_lag_by_key_of_rows_without_order(spark):
    df = spark.createDataFrame([(None, "a", 1), (None, "a", 1), (None, "a", 1), (5, "a", 2), (30, "a", 3), (None, "b", 4)], "i long, k string, v int")
    got = ordered.lag_by_key(df, ["k"], "i", F.floor(c("i") / 11), ["v"]).collect()
    assert sorted((r.i or 0, r.k, r.prev_v or 0) for r in got) == [(0, "a", 0), (0, "a", 1), (0, "a", 1), (0, "b", 0), (5, "a", 1), (30, "a", 2)]


def test_order_pages_are_grouped_once(spark):
    plan = _plan(QUERIES["A6_object_finders"](spark, DATA))
    assert "collect_list" not in plan
