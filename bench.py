"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "C5_target_vehicle", "C8_keyword_matches", "I1_score_v3", "I15_score_v2", "I17_light_score", "I18_score_v1", "E1_dedup_in_batch",
    "G2_new_listings", "C4_near_duplicates", "E8_price_and_score_changes", "D2_stats_by_source", "D6_market_prices", "F3_detail_queue",
    "A23_upsert", "I30_alert_decision", "A10_autoscout_pages", "H8_normalize_keywords", "D12_fetch_stats", "E7_zero_streaks",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from carsift.plans.catalog import QUERIES
    from carsift.session import local_session

    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/lineitem.parquet").count()
    times = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
