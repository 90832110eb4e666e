"""Listing streams: continuous scan, seen-dedup, upsert sink, change alerts, pending re-processing."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from carsift.operators.dedup import drop_known_ids, drop_known_urls, seen_recently, with_canonical_url
from carsift.operators.filters import pending_alerts
from carsift.sources.store import ListingLog, last_per_fingerprint

c = F.col
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scan_stream(spark: SparkSession, folder: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """New listing files in arrival order; the cadence is set on the sink (60 s in production, availableNow in tests)."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def cadence(seconds: int | None) -> dict:
    return {"processingTime": f"{seconds} seconds"} if seconds else {"availableNow": True}


class SeenProcessor(StatefulProcessor):
    """Lets the first row of a key through, and again once the key has not been seen for the horizon (processing time). Late
    rows are not special: a key without state is new."""

    def __init__(self, hours: int, columns: list[str]):
        self.hours, self.columns = hours, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at long", ttlDurationMs=self.hours * 3_600_000)

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.seen.update((1,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known, first = self.seen.exists(), None
        for part in rows:  # one batch at a time; only the earliest row is held
            head = part.sort_values("arrival_seq", kind="stable").iloc[[0]]
            if first is None or head["arrival_seq"].iloc[0] < first["arrival_seq"].iloc[0]:
                first = head
        self.seen.update((1,))
        if not known and first is not None:
            yield first[self.columns]

    def close(self) -> None:
        pass


def _first_sighting(stream: DataFrame, key: Column, hours: int, known: DataFrame | None) -> DataFrame:
    out = stream.schema
    before = None if known is None else known.select(key.alias("seen_key")).distinct().groupBy("seen_key")
    return stream.withColumn("seen_key", key).groupBy("seen_key").transformWithStateInPandas(
        SeenProcessor(hours, out.names), out, "Append", "ProcessingTime", initialState=before)


def drop_seen(stream: DataFrame, hours: int = 24, history: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """First sighting per listing id, then per canonical URL among the survivors, as the batch rule has it. State is one flag
    per key and leaves after `hours` without a sighting; what comes back later is for the sink's history joins. Rows without
    an id are judged by URL only. `history` (listings with created_at) fills the state of a query that starts with a new
    checkpoint: everything created in the last `hours` before `as_of` (now) counts as seen. Needs the RocksDB state store."""
    has_id = F.coalesce("source_listing_id", F.lit("")) != ""
    own = F.when(has_id, F.concat_ws(":", F.lit("id"), "source", "source_listing_id")).otherwise(F.concat_ws(":", F.lit("row"), c("arrival_seq").cast("string")))
    known = None
    if history is not None:
        known = with_canonical_url(seen_recently(history, F.current_timestamp() if as_of is None else as_of, hours))
    with_id = None if known is None else known.where(has_id)
    with_url = None if known is None else known.where(F.coalesce("url_canonique", F.lit("")) != "")
    once = _first_sighting(with_canonical_url(stream), own, hours, with_id)
    return _first_sighting(once, F.concat(F.lit("url:"), F.coalesce("url_canonique", F.lit(""))), hours, with_url)


History = DataFrame | Callable[[], DataFrame] | None


def upsert_sink(stream: DataFrame, log: ListingLog, checkpoint: str, every: int | None = None, history: History = None, on_batch=()) -> StreamingQuery:
    """Each micro-batch: drop what history knows, keep the last row per fingerprint, append it to the listing log under this
    query's run and the batch id. A replayed batch rewrites its own folder, so the result does not change; a query with a new
    checkpoint is a new run and leaves earlier ones alone. `history` as a function is read anew for every batch (a frame made
    once keeps the files it was made with). `on_batch`: further sinks."""
    runs: list[str] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        if not runs:  # Spark keeps the query's id in its checkpoint
            meta = log.spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()["value"]
            runs.append(log.run(json.loads(meta)["id"]))
        rows = batch
        known = history() if callable(history) else history
        if known is not None:
            rows = drop_known_urls(drop_known_ids(rows, known), known)
        rows = last_per_fingerprint(rows).withColumn("updated_at", F.current_timestamp())
        log.append(rows, batch_id, runs[0])
        if on_batch:
            written = log.spark.read.parquet(log.folder(batch_id, runs[0]))
            for sink in on_batch:
                sink(written, batch_id)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**cadence(every)).start()


class ChangeProcessor(StatefulProcessor):
    """Last price, score and notification flag per listing. Emits the rows that call for an alert: first time at or above
    the threshold, price below 95 % of the last one, or ten points more than the last score; an already notified listing is
    otherwise silent."""

    def __init__(self, min_score: int = 60, days: int = 90):
        self.min_score, self.days = min_score, days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "prix int, score int, notified boolean", ttlDurationMs=self.days * 86_400_000)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = self.last.get() if self.last.exists() else None
        out = []
        for pdf in sorted(pd.concat(list(rows)).itertuples(index=False), key=lambda r: r.arrival_seq):
            prix = None if pd.isna(pdf.prix) else int(pdf.prix)
            score = int(pdf.score_total)
            reason = None
            if state is None or not state[2]:
                if score >= self.min_score:
                    reason = "new" if state is None else "score_threshold"
            elif state[0] and prix and prix < state[0] * 0.95:
                reason = "price_dropped"
            elif score >= state[1] + 10:
                reason = "score_increased"
            if reason:
                out.append((key[0], int(pdf.arrival_seq), reason, prix, score))
            state = (prix, score, bool(reason) or bool(state and state[2]))
        if state is not None:
            self.last.update(state)
        if out:
            yield pd.DataFrame(out, columns=["fingerprint", "arrival_seq", "reason", "prix", "score_total"]).astype({"prix": "Int64"})

    def close(self) -> None:
        pass


def change_alerts(stream: DataFrame, min_score: int = 60, days: int = 90) -> DataFrame:
    """Stateful change detection per fingerprint; the state of a listing not seen for `days` expires (needs the RocksDB state
    store)."""
    return stream.select("fingerprint", "arrival_seq", "prix", "score_total").groupBy("fingerprint").transformWithStateInPandas(
        ChangeProcessor(min_score, days), "fingerprint string, arrival_seq long, reason string, prix int, score_total int", "Append", "ProcessingTime")


class CooldownProcessor(StatefulProcessor):
    """After an alert a key is quiet for a while; what comes in meanwhile waits in order. When the timer fires, or an alert comes
    in after the quiet time, the waiting ones go out, `batch_size` at a time, and the key is quiet again."""

    def __init__(self, minutes: int, batch_size: int, by_event: bool, columns: list[str], at: str):
        self.quiet_ms, self.batch_size, self.by_event, self.columns, self.at = minutes * 60_000, batch_size, by_event, columns, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "ms long")
        self.held = handle.getListState("held", "row string")

    def _release(self, waiting: list[str], now: int) -> Iterator[pd.DataFrame]:
        """Sends the first ones, keeps the rest and sets the timer for the end of the new quiet time."""
        sent, rest = waiting[: self.batch_size], waiting[self.batch_size :]
        self.until.update((now + self.quiet_ms,))
        self.handle.registerTimer(now + self.quiet_ms)
        if rest:
            self.held.put([(r,) for r in rest])
        else:
            self.held.clear()
        out = pd.DataFrame([json.loads(r) for r in sent], columns=self.columns)
        out[self.at] = pd.to_datetime(out[self.at], unit="us")
        yield out.assign(released_at=pd.to_datetime(now, unit="ms"))

    def _waiting(self) -> list[str]:
        return [r[0] for r in self.held.get()] if self.held.exists() else []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        fresh = []
        for part in rows:
            micros = part[self.at].astype("datetime64[us]").astype("int64")
            fresh += list(zip(micros // 1000, part.assign(**{self.at: micros}).to_dict("records")))
        for at, row in sorted(fresh, key=lambda r: r[0]):
            now = int(at) if self.by_event else int(timerValues.getCurrentProcessingTimeInMs())
            text = json.dumps(row, default=lambda x: x.item())
            if self.until.exists() and now < self.until.get()[0]:
                self.held.appendValue((text,))
            else:
                yield from self._release([*self._waiting(), text], now)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        due = int(expiredTimerInfo.getExpiryTimeInMs())
        waiting = self._waiting()
        if self.until.exists() and due < self.until.get()[0]:
            return  # a later alert has set the timer anew
        if waiting:
            yield from self._release(waiting, due)
        else:
            self.until.clear()

    def close(self) -> None:
        pass


def with_cooldown(alerts: DataFrame, minutes: int = 60, batch_size: int = 5, key: str = "fingerprint", at: str = "alerted_at", by_event: bool = False) -> DataFrame:
    """Alerts of a key at most every `minutes`, held ones released by timers, with `released_at`. Nothing is lost: held alerts are
    state and survive a restart. `by_event` takes the time from the watermarked column `at` instead of the clock."""
    fields = ", ".join(f"`{n}` {t}" for n, t in alerts.dtypes)
    stream = alerts.groupBy(key).transformWithStateInPandas(
        CooldownProcessor(minutes, batch_size, by_event, alerts.columns, at), f"{fields}, released_at timestamp", "Append", "EventTime" if by_event else "ProcessingTime")
    return stream


def pending(log: ListingLog, min_score: int = 40) -> DataFrame:
    """Un-notified listings at or above the score, for the five-minute re-processing job."""
    return pending_alerts(log.current(), min_score)
