"""Deduplication: in-batch first-wins, against history, by content, and cross-source near duplicates.

First-wins steps are `row_number() = 1` windows. Spark limits each group to one row per partition before the shuffle
(WindowGroupLimit), so a key that holds a third of all rows sends one row per map task, not the group. Rows without a key
get a private key instead of falling into one big NULL group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from carsift.functions.text import blank_if_null
from carsift.functions.urls import canonical_url

SEQ = "arrival_seq"


def first_per_key(df: DataFrame, key: Column, order: list[Column], k: int = 1) -> DataFrame:
    w = W.partitionBy("_key").orderBy(*order)
    ranked = df.withColumn("_key", key).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k)
    return ranked.drop("_key") if k > 1 else ranked.drop("_key", "_rn")


def listing_key() -> Column:
    """(source, listing id); rows without a listing id are their own key."""
    has_id = blank_if_null("source_listing_id") != ""
    return F.when(has_id, F.concat_ws(":", F.lit("id"), "source", "source_listing_id")).otherwise(
        F.concat_ws(":", F.lit("row"), F.col(SEQ).cast("string")))


def with_canonical_url(df: DataFrame) -> DataFrame:
    return df if "url_canonique" in df.columns else df.withColumn("url_canonique", canonical_url(F.col("url")))


def dedup_in_batch(df: DataFrame) -> DataFrame:
    """Two stages: listing id first, then canonical URL among the survivors only."""
    once = first_per_key(df, listing_key(), [F.col(SEQ)])
    return first_per_key(with_canonical_url(once), F.col("url_canonique"), [F.col(SEQ)])


def known_listing_keys(history: DataFrame) -> DataFrame:
    return history.filter(blank_if_null("source_listing_id") != "").select("source", "source_listing_id").distinct()


def known_urls(history: DataFrame) -> DataFrame:
    """Both URL columns in one list, so that the OR of the lookup becomes one equi anti join."""
    h = with_canonical_url(history)
    return h.select(F.col("url").alias("url_canonique")).union(h.select("url_canonique")).distinct()


def drop_known_ids(df: DataFrame, history: DataFrame) -> DataFrame:
    return df.join(known_listing_keys(history), ["source", "source_listing_id"], "left_anti")


def drop_known_urls(df: DataFrame, history: DataFrame) -> DataFrame:
    return with_canonical_url(df).join(known_urls(history), "url_canonique", "left_anti")


def new_listings(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Rows of the batch not seen before. A row dropped at the id stage never registers its URL."""
    once = first_per_key(batch, listing_key(), [F.col(SEQ)])
    survivors = drop_known_ids(once, history)
    return drop_known_urls(first_per_key(with_canonical_url(survivors), F.col("url_canonique"), [F.col(SEQ)]), history)


def new_by_url(batch: DataFrame, history: DataFrame) -> DataFrame:
    """Older rule: raw URL only, first wins."""
    fresh = batch.join(history.select("url").distinct(), "url", "left_anti")
    return first_per_key(fresh, F.col("url"), [F.col(SEQ)])


def dedup_by_hash(df: DataFrame, content_hash: Column) -> DataFrame:
    return first_per_key(df, content_hash, [F.col(SEQ)])


def near_duplicates(batch: DataFrame, history: DataFrame, created: str = "created_at", cols: list[str] | None = None) -> DataFrame:
    """Adds `near`: the newest history row with the same soft fingerprint (NULL if none, or if the soft fingerprint is blank).
    A batch row is never part of history, so a listing seen before finds its own stored row.

    One history row per soft fingerprint leaves each map task; the join sees one small row per key, and AQE splits hot keys of
    the batch side.
    """
    cols = cols or ["fingerprint", "prix", "score_total", "notified"]
    known = history.select("fingerprint_soft", SEQ, created, *cols).filter(blank_if_null("fingerprint_soft") != "")
    newest = first_per_key(known, F.col("fingerprint_soft"), [F.col(created).desc(), F.col(SEQ).desc()])
    return batch.join(newest.select("fingerprint_soft", F.struct(*cols).alias("near")), "fingerprint_soft", "left")


def seen_recently(history: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Preload horizon: all rows inside the time window, however many there are."""
    return history.filter(F.col("created_at") >= as_of - F.make_interval(hours=F.lit(hours)))
