"""Streams equal their batch form, also when restarted from the checkpoint."""

import time

from pyspark.sql import functions as F

from carsift.sources.store import ListingLog
from carsift.streaming import health
from carsift.streaming.listings import change_alerts, drop_seen, scan_stream, upsert_sink, with_cooldown

SCHEMA = "fingerprint string, arrival_seq long, source string, source_listing_id string, url string, prix int, score_total int, scraped_at timestamp, created_at timestamp, notified boolean"


def _file(spark, folder, rows):
    df = spark.createDataFrame([(f"f{k}", seq, "a", k, f"u{k}", p, s, None, None, False) for seq, k, p, s in rows], SCHEMA)
    ts = (F.lit("2024-01-01").cast("timestamp").cast("long") + F.col("arrival_seq")).cast("timestamp")
    df.withColumns({"scraped_at": ts, "created_at": ts}).coalesce(1).write.mode("append").parquet(folder)


def _until(query, checkpoint, batches):
    """A stateful query on the clock runs empty batches without end, so it is stopped once its data batches are committed."""
    end = time.time() + 120
    while time.time() < end and query.isActive and not (checkpoint / "commits" / str(batches - 1)).exists():
        time.sleep(0.2)
    if query.exception():
        raise query.exception()
    query.stop()


def test_upsert_sink_with_restart(spark, tmp_path):
    folder, log = str(tmp_path / "in"), ListingLog(spark, str(tmp_path / "log"))
    for batch in ([(1, "x", 10, 50), (2, "x", 9, 55)], [(3, "y", 20, 70)]):
        _file(spark, folder, batch)
        stream = scan_stream(spark, folder, SCHEMA, 1)
        upsert_sink(stream, log, str(tmp_path / "ck")).awaitTermination(120)
    assert {(r.fingerprint, r.prix) for r in log.current().collect()} == {("fx", 9), ("fy", 20)}


def test_drop_seen(spark, tmp_path):
    folder = str(tmp_path / "in")
    _file(spark, folder, [(1, "x", 10, 50), (2, "x", 9, 55), (3, "y", 1, 1)])
    _file(spark, folder, [(4, "x", 8, 50), (5, "z", 9, 55)])
    out = drop_seen(scan_stream(spark, folder, SCHEMA, 1))
    q = out.writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    _until(q, tmp_path / "ck", 2)
    assert sorted(r.source_listing_id for r in spark.table("seen").collect()) == ["x", "y", "z"]


def test_fresh_checkpoint_and_compaction_keep_earlier_rows(spark, tmp_path):
    folder, log = str(tmp_path / "in"), ListingLog(spark, str(tmp_path / "log"))
    _file(spark, folder, [(1, "x", 10, 50)])
    upsert_sink(scan_stream(spark, folder, SCHEMA, 1), log, str(tmp_path / "ck1")).awaitTermination(120)
    small = log.compact(str(tmp_path / "compact"))
    again = str(tmp_path / "in2")
    _file(spark, again, [(2, "y", 20, 60), (3, "x", 9, 50)])
    for target, ck in ((log, "ck2"), (small, "ck3")):
        upsert_sink(scan_stream(spark, again, SCHEMA, 1), target, str(tmp_path / ck)).awaitTermination(120)
        assert {(r.fingerprint, r.prix) for r in target.current().collect()} == {("fx", 9), ("fy", 20)}
        assert target.versions().count() == 3


def test_history_is_read_anew_for_every_batch(spark, tmp_path):
    folder, log = str(tmp_path / "in"), ListingLog(spark, str(tmp_path / "log"))
    for rows in ([(1, "x", 10, 50)], [(2, "x", 9, 55), (3, "y", 20, 70)]):
        _file(spark, folder, rows)
    seed = spark.createDataFrame([], SCHEMA)
    known = lambda: log.versions().select(*seed.columns) if log.runs() else seed
    upsert_sink(scan_stream(spark, folder, SCHEMA, 1), log, str(tmp_path / "ck"), history=known).awaitTermination(180)
    assert {(r.fingerprint, r.prix) for r in log.versions().collect()} == {("fx", 10), ("fy", 20)}


def test_drop_seen_keeps_late_rows_and_checks_both_keys(spark, tmp_path):
    folder = str(tmp_path / "in")
    stamp = lambda day: f"2024-01-{day:02d} 00:00:00"
    rows = [(1, "a", "u1", stamp(9)), (2, "b", "u2", stamp(1)), (3, "c", "u1", stamp(9)), (4, "a", "u9", stamp(9))]
    for seq, lid, url, at in rows:
        one = spark.createDataFrame([(f"f{seq}", seq, "s", lid, url, 1, 1)], "fingerprint string, arrival_seq long, source string, source_listing_id string, url string, prix int, score_total int")
        one.withColumns({"scraped_at": F.lit(at).cast("timestamp"), "created_at": F.lit(at).cast("timestamp"), "notified": F.lit(False)}).coalesce(1).write.mode("append").parquet(folder)
    q = drop_seen(scan_stream(spark, folder, SCHEMA, 1)).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    _until(q, tmp_path / "ck", 4)
    assert sorted(r.arrival_seq for r in spark.table("late").collect()) == [1, 2]


def test_change_alerts(spark, tmp_path):
    folder = str(tmp_path / "in")
    for rows in ([(1, "x", 2000, 60), (2, "y", 2000, 50)], [(3, "x", 1900, 65), (4, "y", 2000, 61)], [(5, "x", 1800, 65), (6, "y", 2000, 71)]):
        _file(spark, folder, rows)
    out = change_alerts(scan_stream(spark, folder, SCHEMA, 1))
    q = out.writeStream.format("memory").queryName("chg").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    _until(q, tmp_path / "ck", 3)
    got = sorted((r.arrival_seq, r.reason) for r in spark.table("chg").collect())
    assert got == [(1, "new"), (4, "score_threshold"), (5, "price_dropped"), (6, "score_increased")]


def test_circuit_steps():
    state, seen = ("closed", 0, 0, 0, None), []
    # three blocks open for 120 * 2^3 capped at 600 s; a probe after the pause, two successes close
    for ts, failed in [(0, True), (1, True), (2, True), (100, False), (602, False), (603, False), (700, True)]:
        state, entered = health.step(state, ts, failed, failed)
        seen.append(entered)
    assert seen == [None, None, "open", None, "half_open", "closed", None]


def test_circuit_stream_equals_the_sequential_rule(spark, tmp_path):
    import random

    rnd = random.Random(2)
    rows = [(i, i * 20, "a" if rnd.random() < 0.7 else "b", rnd.random() < 0.6) for i in range(240)]
    want, states = [], {}
    for i, ts, src, failed in rows:
        states[src], entered = health.step(states.get(src, ("closed", 0, 0, 0, None)), float(ts), failed, failed)
        if entered:
            want.append((src, i, entered))
    folder = str(tmp_path / "in")
    for k in range(3):
        part = spark.createDataFrame(rows[k * 80:(k + 1) * 80], "event_id long, s long, source string, failed boolean")
        part.select("event_id", F.timestamp_seconds("s").alias("ts"), "source", "failed", F.when(F.col("failed"), 403).otherwise(200).alias("status_code")).coalesce(1).write.mode("append").parquet(folder)
    schema = "event_id long, ts timestamp, source string, failed boolean, status_code int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = health.circuit_changes(stream).writeStream.format("memory").queryName("circ").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(want) == sorted((r.source, r.event_id, r.state) for r in spark.table("circ").collect()) and want


def test_history_fills_the_seen_state(spark, tmp_path):
    folder = str(tmp_path / "in")
    _file(spark, folder, [(1, "x", 10, 50), (2, "y", 9, 55), (3, "z", 1, 1), (4, "old", 1, 1)])
    history = spark.createDataFrame([("a", "x", "ux", 1), ("a", "w", "uy", 2), ("a", None, None, 3), ("a", "old", "uold", 90)], "source string, source_listing_id string, url string, hours long")
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    history = history.withColumn("created_at", as_of - F.make_interval(hours=F.col("hours").cast("int"))).withColumn("arrival_seq", F.lit(0))
    for run in range(2):  # the second time with another fresh checkpoint
        out = drop_seen(scan_stream(spark, folder, SCHEMA, 1), history=history, as_of=as_of)
        q = out.writeStream.format("memory").queryName(f"filled{run}").option("checkpointLocation", str(tmp_path / f"ck{run}")).trigger(availableNow=True).start()
        _until(q, tmp_path / f"ck{run}", 1)
        assert sorted(r.source_listing_id for r in spark.table(f"filled{run}").collect()) == ["old", "z"]


def test_cooldown_holds_and_releases(spark, tmp_path):
    folder, schema = str(tmp_path / "in"), "fingerprint string, arrival_seq long, alerted_at timestamp"
    sent = []

    def run(rows):
        frame = spark.createDataFrame([(k, seq, m) for seq, k, m in rows], "fingerprint string, arrival_seq long, m long")
        start = F.lit("2024-01-01 00:00:00").cast("timestamp")
        frame.select("fingerprint", "arrival_seq", (start + F.make_interval(mins=F.col("m").cast("int"))).alias("alerted_at")).coalesce(1).write.mode("append").parquet(folder)
        alerts = scan_stream(spark, folder, schema, 1).withWatermark("alerted_at", "0 seconds")
        out = with_cooldown(alerts, minutes=60, batch_size=2, by_event=True)
        q = out.writeStream.foreachBatch(lambda b, i: sent.extend((r.fingerprint, r.arrival_seq, (r.released_at.day - 1) * 1440 + r.released_at.hour * 60 + r.released_at.minute) for r in b.collect())
                                         ).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got, sent[:] = sorted(sent), []
        return got

    assert run([(1, "x", 0), (2, "y", 30)]) == [("x", 1, 0), ("y", 2, 30)]
    assert run([(3, "x", 59), (4, "x", 59), (5, "x", 59)]) == []       # held, and kept over the restart
    assert run([(6, "y", 61)]) == [("x", 3, 60), ("x", 4, 60)]            # released by the timer, two at a time
    assert run([(7, "z", 121)]) == [("x", 5, 120), ("y", 6, 90), ("z", 7, 121)]
    assert run([(8, "x", 179), (9, "z", 182)]) == [("x", 8, 180), ("z", 9, 182)]
    assert run([(10, "x", 241)]) == [("x", 10, 241)]
