"""Queries: batch forms of the stream operators (survey section J). The same functions run on streams, see tests/test_streaming.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from carsift.operators import dedup, ordered
from carsift.plans import reference_sql as R
from carsift.plans.catalog_tables import EXIST_SQL, HIST, IDS, KEY, NEW_SQL, SHIST, STORED, UHIST, SQ, after, before, raw, stored  # noqa: F401
from carsift.plans.registry import query
from carsift.sources.listings import fetch_log_from_events
from carsift.streaming import health

c = F.col


@query("J2_first_seen", SQ("SELECT source, count(*) AS n FROM (SELECT source, row_number() OVER (PARTITION BY CASE WHEN source_listing_id IS NULL THEN 'url:' || url_canonique ELSE source || ':' || source_listing_id END ORDER BY arrival_seq) AS rn FROM ids) WHERE rn = 1 GROUP BY source", IDS))
def _(spark, folder):
    df = dedup.with_canonical_url(raw(spark, folder))
    key = F.when(c("source_listing_id").isNotNull(), F.concat_ws(":", "source", "source_listing_id")).otherwise(F.concat(F.lit("url:"), "url_canonique"))
    return dedup.first_per_key(df.select("source", "source_listing_id", "url_canonique", KEY), key, [c(KEY)]).groupBy("source").agg(F.count("*").alias("n"))


@query("J6_error_windows", f"WITH {R.EVENTS} SELECT source, epoch(w)::BIGINT AS window_s, count(*) AS errors, count(*) >= 5 AS open FROM (SELECT source, unnest(generate_series(time_bucket(INTERVAL 60 SECOND, ts) - INTERVAL 240 SECOND, time_bucket(INTERVAL 60 SECOND, ts), INTERVAL 60 SECOND)) AS w FROM fetches WHERE failed) GROUP BY ALL")
def _(spark, folder):
    return health.error_windows(fetch_log_from_events(spark, folder)).select("source", F.unix_seconds("window_start").alias("window_s"), "errors", "open")


@query("J11_pending_reprocessing", SQ("SELECT arrival_seq, score_total FROM stored WHERE NOT notified AND score_total >= 40 AND status = 'nouveau'", STORED))
def _(spark, folder):
    from carsift.operators.filters import pending_alerts

    return pending_alerts(stored(spark, folder)).filter(c("status") == "nouveau").select(KEY, "score_total")


_J4 = ("j4 AS (SELECT *, lag(arrival_seq) OVER w AS pseq, lag(prix) OVER w AS pp, lag(score_total) OVER w AS psc, min(CASE WHEN score_total >= 60 THEN arrival_seq END) OVER (PARTITION BY fingerprint) AS hit FROM stored WINDOW w AS (PARTITION BY fingerprint ORDER BY arrival_seq)), "
       "j4r AS (SELECT arrival_seq, CASE WHEN arrival_seq = hit THEN (CASE WHEN pseq IS NULL THEN 'new' ELSE 'score_threshold' END) WHEN arrival_seq > hit AND pp <> 0 AND prix <> 0 AND prix < pp * 0.95e0 THEN 'price_dropped' WHEN arrival_seq > hit AND score_total >= psc + 10 THEN 'score_increased' END AS reason FROM j4)")


@query("J4_change_alerts", SQ("SELECT * FROM j4r WHERE reason IS NOT NULL", STORED, _J4))
def _(spark, folder):
    """Batch form of the change stream: a listing counts as notified from its first row at or above the threshold."""
    df = stored(spark, folder).select(KEY, "fingerprint", "prix", "score_total")
    # the smallest hit up to a row says all that the smallest of the whole key would: rows before it have no reason
    lagged = ordered.lag_by_key(df, ["fingerprint"], KEY, F.floor(c(KEY) / F.lit(10**11)), [KEY, "prix", "score_total"],
                                least={"hit": F.when(c("score_total") >= 60, c(KEY))})
    later = c(KEY) > c("hit")
    reason = (
        F.when(c(KEY) == c("hit"), F.when(c("prev_arrival_seq").isNull(), "new").otherwise("score_threshold"))
        .when(later & (c("prev_prix") != 0) & (c("prix") != 0) & (c("prix") < c("prev_prix") * 0.95), "price_dropped")
        .when(later & (c("score_total") >= c("prev_score_total") + 10), "score_increased"))
    return lagged.withColumn("reason", reason).filter(c("reason").isNotNull()).select(KEY, "reason")
