"""Source health over the fetch log: error windows, circuit states, status table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

c = F.col
# fixed values: failures to open, base pause, longest pause, successes to close; error window and its threshold
FAILURES, PAUSE, LONGEST, SUCCESSES = 3, 120, 600, 2
WINDOW_SECONDS, WINDOW_ERRORS = 300, 5


def error_windows(log: DataFrame, slide: int = 60, threshold: int = WINDOW_ERRORS) -> DataFrame:
    """Errors per source in sliding windows of 300 s and whether the threshold was reached. Works on batch and stream
    (add a watermark there); partial counts are combined before the shuffle."""
    w = F.window("ts", f"{WINDOW_SECONDS} seconds", f"{slide} seconds")
    g = log.filter("failed").groupBy(w.alias("w"), "source").agg(F.count("*").alias("errors"))
    return g.select("source", c("w.start").alias("window_start"), "errors", (c("errors") >= threshold).alias("open"))


def step(state: tuple, ts: float, failed: bool, blocked: bool) -> tuple[tuple, str | None]:
    """One fetch outcome. state = (name, failures, successes, blocks, blocked_until). A fetch at or after the end of the
    pause probes the source (half-open). Returns the new state and the name entered, if it changed."""
    name, failures, successes, blocks, until = state
    before = name
    if name == "open" and until is not None and ts >= until:
        name, successes = "half_open", 0
    if failed:
        failures += 1
        blocks += 1 if blocked else 0
        if name == "half_open" or (name == "closed" and failures >= FAILURES):
            name, successes = "open", 0
            until = ts + min(PAUSE * 2 ** min(blocks, 4), LONGEST)
    else:
        successes += 1
        if name == "half_open" and successes >= SUCCESSES:
            name, failures, blocks = "closed", 0, 0
        elif name == "closed":
            failures = 0
    return (name, failures, successes, blocks, until), (name if name != before else None)


class CircuitProcessor(StatefulProcessor):
    """Closed / open / half-open per source; emits every state change."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("circuit", "name string, failures int, successes int, blocks int, until double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else ("closed", 0, 0, 0, None)
        out = []
        # one micro-batch of one source, bounded by the trigger, in time order across its Arrow batches
        for r in pd.concat(list(rows)).sort_values(["ts_s", "event_id"]).itertuples(index=False):
            state, entered = step(state, float(r.ts_s), bool(r.failed), r.status_code in (403, 429, 503))
            if entered:
                out.append((key[0], int(r.event_id), entered))
        self.state.update(state)
        if out:
            yield pd.DataFrame(out, columns=["source", "event_id", "state"])

    def close(self) -> None:
        pass


def circuit_changes(log: DataFrame) -> DataFrame:
    """State changes per source over a fetch-log stream whose batches arrive in time order."""
    rows = log.select("source", "event_id", (F.unix_micros(c("ts").cast("timestamp")) / F.lit(1e6)).alias("ts_s"), "failed", "status_code")
    return rows.groupBy("source").transformWithStateInPandas(CircuitProcessor(), "source string, event_id long, state string", "Append", "None")
