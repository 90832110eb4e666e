"""The listing table: upsert, mutations, decoding of text columns, exports, scan log.

Parquet has no row updates. The table is therefore a log of row versions (append-only, one folder per batch, safe to
replay) and a current view; `compact` rewrites the view when the log grows. The same rules exist as DataFrame -> DataFrame
functions for callers with their own table format.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from carsift.operators.scoring import BREAKDOWN

c = F.col
KEY = "fingerprint"


def last_per_fingerprint(changes: DataFrame, seq: str = "arrival_seq") -> DataFrame:
    """Within a batch the last write wins."""
    from carsift.operators.dedup import first_per_key

    return first_per_key(changes, c(KEY), [c(seq).desc()])


def upsert(existing: DataFrame, changes: DataFrame, now: Column, keep_notified: bool = True, key: str = KEY) -> DataFrame:
    """Insert or update: all columns come from the change except key and created_at of a known row. With keep_notified a
    row once notified stays so; without it the incoming value counts. `changes` holds one row per key. Adds is_new."""
    cols = [n for n in existing.columns if n not in (key, "is_new")]
    old = existing.select(key, F.struct(*cols).alias("_o"))
    new = changes.select(key, F.struct(*cols).alias("_n"))
    j = old.join(new, key, "full_outer")
    was, comes = c("_o").isNotNull(), c("_n").isNotNull()
    out = {}
    for n in cols:
        if n == "created_at":
            out[n] = F.coalesce(c("_o.created_at"), c("_n.created_at"))
        elif n == "updated_at":
            out[n] = F.when(comes, now).otherwise(c("_o.updated_at"))
        elif n == "notified" and keep_notified:
            out[n] = F.coalesce(c("_o.notified"), F.lit(False)) | F.coalesce(c("_n.notified"), F.lit(False))
        else:
            out[n] = F.when(comes, c(f"_n.{n}")).otherwise(c(f"_o.{n}"))
    return j.select(key, *[v.alias(n) for n, v in out.items()], (comes & ~was).alias("is_new"))


def mark_notified(table: DataFrame, ids: DataFrame, channels: Column, now: Column, key: str = KEY) -> DataFrame:
    hit = table.join(ids.select(key).distinct().withColumn("_hit", F.lit(True)), key, "left")
    on = c("_hit").isNotNull()
    return hit.withColumns({
        "notified": F.when(on, True).otherwise(c("notified")), "notified_at": F.when(on, now).otherwise(c("notified_at")),
        "notify_channels": F.when(on, channels).otherwise(c("notify_channels")), "updated_at": F.when(on, now).otherwise(c("updated_at")),
    }).drop("_hit")


def update_status(table: DataFrame, changes: DataFrame, now: Column, key: str = KEY) -> DataFrame:
    """`changes`: key, new_status, new_reason (one row per key)."""
    j = table.join(changes.select(key, "new_status", "new_reason"), key, "left")
    on = c("new_status").isNotNull()
    return j.withColumns({
        "status": F.coalesce("new_status", "status"), "ignore_reason": F.when(on, F.coalesce("new_reason", F.lit(""))).otherwise(c("ignore_reason")),
        "updated_at": F.when(on, now).otherwise(c("updated_at"))}).drop("new_status", "new_reason")


def delete(table: DataFrame, ids: DataFrame, key: str = KEY) -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


BREAKDOWN_SCHEMA = T.StructType([T.StructField(n, T.StringType() if n.endswith("_detail") else T.IntegerType()) for n in BREAKDOWN])
JSON_LISTS = ["images_urls", "keywords_opportunite", "keywords_risque", "notify_channels"]
DATES = ["published_at", "scraped_at", "created_at", "updated_at", "notified_at"]


def encode(df: DataFrame) -> DataFrame:
    """Text form: lists and breakdown as JSON, notified as 0/1, dates as ISO text."""
    out = {n: F.to_json(n) for n in [*JSON_LISTS, "score_breakdown"] if n in df.columns}
    out |= {n: F.date_format(n, "yyyy-MM-dd'T'HH:mm:ss'Z'") for n in DATES if n in df.columns}
    if "notified" in df.columns:
        out["notified"] = F.coalesce(c("notified"), F.lit(False)).cast("int")
    return df.withColumns(out)


def decode(df: DataFrame) -> DataFrame:
    """Back from the text form: bad JSON reads as an empty list or an all-NULL breakdown, bad dates as NULL."""
    empty = F.array().cast("array<string>")
    out = {n: F.coalesce(F.from_json(n, "array<string>", {"mode": "PERMISSIVE"}), empty) for n in JSON_LISTS if n in df.columns}
    if "score_breakdown" in df.columns:
        out["score_breakdown"] = F.from_json("score_breakdown", BREAKDOWN_SCHEMA, {"mode": "PERMISSIVE"})
    out |= {n: F.try_to_timestamp(n) for n in DATES if n in df.columns}
    if "notified" in df.columns:
        out["notified"] = F.coalesce(c("notified"), F.lit(0)) != 0
    return df.withColumns(out)


# fixed values: columns of an export
EXPORT_COLUMNS = ["score_total", "marque", "modele", "prix", "kilometrage", "annee", "departement", "alert_level", "url", "created_at"]


def export_rows(df: DataFrame, min_score: int = 0, limit: int | None = None) -> DataFrame:
    """Best first; all rows unless the caller asks for the first `limit`."""
    rows = df.filter(c("score_total") >= min_score).orderBy(c("score_total").desc(), "arrival_seq")
    return rows if limit is None else rows.limit(limit)


def export_csv(df: DataFrame, path: str, min_score: int = 0, limit: int | None = None) -> None:
    export_rows(df, min_score, limit).select(*EXPORT_COLUMNS).write.mode("overwrite").csv(path, header=True)


def export_json(df: DataFrame, path: str, min_score: int = 0, limit: int | None = None) -> None:
    export_rows(df, min_score, limit).write.mode("overwrite").json(path)


def scan_history_rows(per_source: DataFrame, at: Column) -> DataFrame:
    """One finished row per source with its own counts (notified is accepted upstream but not stored)."""
    return per_source.select("source", at.alias("started_at"), at.alias("finished_at"), F.lit("completed").alias("status"),
                             c("index_count").alias("listings_found"), c("new_count").alias("listings_new"), c("error_count").alias("errors_count"))


def close_scans(started: DataFrame, ended: DataFrame) -> DataFrame:
    """Start events joined with end events on scan_id, with the duration in seconds."""
    secs = (F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1e6)
    status = F.coalesce("end_status", F.lit("running"))
    return started.join(ended, "scan_id", "left").withColumns({"status": status, "duration_seconds": secs})


class ListingLog:
    """Append-only versions of listings below `path`: one folder per run and batch. A run is one streaming query (or one
    series of manual appends), so a query that starts over with batch 0 adds to what earlier runs wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def runs(self) -> list[str]:
        """Names of the runs so far, in order; a name is its number and its id."""
        try:
            return [r["run"] for r in self.versions().select("run").distinct().orderBy("run").collect()]
        except AnalysisException:  # nothing written yet
            return []

    def run(self, run_id: str) -> str:
        """The run's name: the one it has, else the next number."""
        names = self.runs()
        known = [n for n in names if n.split("-", 1)[1] == run_id]
        return known[0] if known else f"r{int(names[-1][1:].split('-', 1)[0]) + 1 if names else 0:06d}-{run_id}"

    def folder(self, batch_id: int, run: str) -> str:
        return f"{self.path}/run={run}/batch_id={batch_id}"

    def append(self, changes: DataFrame, batch_id: int, run: str = "r000000-manual") -> None:
        """Rewriting the folder of a batch makes a replayed batch of the same run harmless."""
        changes.write.mode("overwrite").parquet(self.folder(batch_id, run))

    def versions(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path)

    def current(self) -> DataFrame:
        """Latest version per fingerprint; created_at of the first, notified if any version was. One partial aggregation,
        so a listing with very many versions does not gather in one task."""
        v = self.versions()
        keep = [n for n in v.columns if n not in (KEY, "run", "batch_id", "created_at", "notified")]
        latest = F.max_by(F.struct(*keep), F.struct("run", "batch_id", "arrival_seq"))
        g = v.groupBy(KEY).agg(latest.alias("_v"), F.min("created_at").alias("created_at"), F.bool_or("notified").alias("notified"))
        return g.select(KEY, "_v.*", "created_at", "notified")

    def compact(self, target: str) -> "ListingLog":
        """Writes the current view as the first run of a new, empty log; later runs add to it."""
        into = ListingLog(self.spark, target)
        if into.runs():
            raise ValueError(f"{target} already holds a log")
        into.append(self.current(), 0, "r000000-compacted")
        return into
