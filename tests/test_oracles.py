"""Every registered query with SQL agrees with DuckDB at the smallest scale (a spread of them here; tools/check_oracles.py runs all)."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))
FOLDER = "/root/testdata/sf0.001"
NAMES = ["I1_score_v3", "I15_score_v2", "I18_score_v1", "G2_new_listings", "C4_near_duplicates", "A23_upsert", "D6_market_prices",
         "E8_price_and_score_changes", "J4_change_alerts", "J6_error_windows", "A10_autoscout_pages", "H24_parse_title"]


@pytest.fixture(scope="module")
def con():
    from check_oracles import connect

    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    from check_oracles import compare

    import __spark_entry__ as entry

    assert compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name]).startswith("ok")


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 20
