"""Streams with state: silent sources, sessions, sliding windows, scores against
a store that changes; several micro-batches each, late rows and replays."""
import datetime as dt
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from relmon.operators import profile as P
from relmon.sinks.store import upsert_baselines
from relmon.streaming import streams as ST
from relmon.streaming.silence import merge_stretches, rocksdb_state, silent_sources

T0 = dt.datetime(2024, 1, 1)
SCHEMA = "src string, ts timestamp_ntz"


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def put(spark, rows, path):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_stretches_merge_in_any_order():
    rnd = random.Random(1)
    for _ in range(200):
        times = sorted(rnd.sample(range(400), rnd.randrange(1, 25)))
        whole = merge_stretches([], times, 10)
        parts, left = [], times[:]
        rnd.shuffle(left)
        while left:
            n = rnd.randrange(1, 6)
            parts = merge_stretches(parts, sorted(left[:n]), 10)
            left = left[n:]
        assert [p[:2] for p in parts] == [w[:2] for w in whole]
        assert all(b[0] - a[1] > 10 for a, b in zip(whole, whole[1:]))
    assert merge_stretches([(0, 5, 2)], [9], 10) == [(0, 9, 0)]         # alive again: its reports start anew
    assert merge_stretches([(0, 5, 2)], [3], 10) == [(0, 5, 2)]


def silent(spark, path, base, reminders=1, delay="5 minutes"):
    with rocksdb_state(spark):
        out = ST.run_available(silent_sources(ST.file_stream(spark, path, SCHEMA), "ts", ["src"], 20, delay, reminders), base)
    return sorted((r.src, r.silent_since, r.alert_timestamp, r.reminder) for r in out.collect())


def test_a_source_that_stops_is_reported_once(spark, tmpdir_path):
    path, base = tmpdir_path + "/in", tmpdir_path + "/run"
    put(spark, [("a", at(m)) for m in range(0, 30, 5)] + [("b", at(3)), (None, at(4)), ("b", None)], path)
    # b's silence has passed the threshold (20) by the watermark of 25 - 5 minutes? not yet
    assert silent(spark, path, base) == []
    # a row between, within the watermark's delay, lets the silence begin later; a goes on
    put(spark, [("b", at(22)), ("a", at(31))], path)
    assert silent(spark, path, base) == []
    put(spark, [("a", at(m)) for m in range(40, 71, 10)], path)
    first = [("b", at(22), at(42), 0), ("b", at(22), at(62), 1)]
    assert silent(spark, path, base) == first
    # back again, then silent again: a new alert; nothing new, no new alert
    put(spark, [("b", at(71)), *[("a", at(m)) for m in range(80, 121, 10)]], path)
    want = first + [("b", at(71), at(91), 0), ("b", at(71), at(111), 1)]
    assert silent(spark, path, base) == want
    assert silent(spark, path, base) == want
    # all of it in one micro-batch gives the same alerts
    assert silent(spark, path, tmpdir_path + "/once") == want


def test_clock_time_reports_when_nothing_arrives_at_all(spark, tmpdir_path):
    """By the clock no watermark is needed; such a query runs until it is stopped."""
    path, out = tmpdir_path + "/in", tmpdir_path + "/out"
    put(spark, [("a", at(0)), ("b", at(1)), ("c", dt.datetime(2150, 1, 1)), ("d", dt.datetime(2999, 1, 1))], path)
    with rocksdb_state(spark):
        q = silent_sources(ST.file_stream(spark, path, SCHEMA), "ts", ["src"], 20, time_mode="ProcessingTime").writeStream \
            .format("parquet").option("path", out).option("checkpointLocation", tmpdir_path + "/ck").trigger(processingTime="1 second").start()
    got, end = [], time.time() + 40
    try:
        while len(got) < 2 and time.time() < end:
            time.sleep(2)
            if os.path.isdir(out + "/_spark_metadata") and os.listdir(out + "/_spark_metadata"):
                got = sorted((r.src, r.silent_since, r.reminder) for r in
                             spark.read.schema("src string, silent_since timestamp_ntz, alert_timestamp timestamp_ntz, reminder int").parquet(out).collect())
    finally:
        q.stop()
    assert got == [("a", at(0), 0), ("b", at(1), 0)]


def test_sessions_and_sliding_windows_with_late_rows(spark, tmpdir_path):
    path, b1, b2 = tmpdir_path + "/in", tmpdir_path + "/s", tmpdir_path + "/w"
    put(spark, [("a", at(0)), ("a", at(20)), ("b", at(100))], path)

    def run():
        s = ST.sessions(ST.file_stream(spark, path, SCHEMA), "ts", ["src"], "15 minutes", "30 minutes")
        w = ST.sliding_counts(ST.file_stream(spark, path, SCHEMA), "ts", ["src"], "60 minutes", "30 minutes", "30 minutes")
        return (sorted(tuple(r) for r in ST.run_available(s, b1).collect()),
                sorted((r.src, r.window_start, r.row_count) for r in ST.run_available(w, b2).collect()))
    s, w = run()
    assert s == [("a", at(0), at(0), 1), ("a", at(20), at(20), 1)]
    assert w == [("a", at(-30), 2), ("a", at(0), 2)]
    # 80 is late but within the delay, 10 is too late
    put(spark, [("b", at(80)), ("a", at(10)), ("b", at(90)), ("b", at(200))], path)
    s, w = run()
    assert s == [("a", at(0), at(0), 1), ("a", at(20), at(20), 1), ("b", at(80), at(100), 3)]
    assert [x for x in w if x[0] == "b"] == [("b", at(30), 1), ("b", at(60), 3), ("b", at(90), 2)]


def test_scores_use_the_baseline_stored_at_their_batch(spark, tmpdir_path):
    path, store, base = tmpdir_path + "/in", tmpdir_path + "/store", tmpdir_path + "/run"
    keys = ["metric_name", "source_database", "table_name"]

    def baseline(mean, when):
        s = spark.createDataFrame([("m", mean - 1.0), ("m", mean + 1.0)], "metric_name string, value double")
        upsert_baselines(spark, P.baselines(s, ["metric_name"], as_of=when, source_database="d", table_name="t"), store)

    def run():
        c = ST.hourly_counts(ST.file_stream(spark, path, SCHEMA), "ts", ["src"], "0 minutes")
        c = c.select("bucket", "row_count", F.col("src").alias("metric_name"), F.lit("d").alias("source_database"), F.lit("t").alias("table_name"))
        out = ST.score_against_store(c, store, base, keys)
        return sorted((r.metric_name, r.bucket, float(r.mean_value or 0), r.is_anomaly) for r in out.collect())
    baseline(2.0, "2024-01-01")
    put(spark, [("m", at(m)) for m in (0, 1, 70)] + [("other", at(2))], path)
    assert run() == [("m", at(0), 2.0, False), ("other", at(0), 0.0, False)]
    baseline(50.0, "2024-01-02")
    put(spark, [("m", at(200))], path)
    want = [("m", at(0), 2.0, False), ("m", at(60), 50.0, True), ("other", at(0), 0.0, False)]
    assert run() == want
    assert run() == want


@pytest.mark.parametrize("again", [1, 2])
def test_run_available_adds_nothing_without_new_data(spark, tmpdir_path, again):
    path, base = tmpdir_path + "/in", tmpdir_path + "/run"
    put(spark, [("a", at(0)), ("a", at(500))], path)
    for _ in range(again + 1):
        out = ST.run_available(ST.hourly_counts(ST.file_stream(spark, path, SCHEMA), "ts", ["src"]), base)
        assert [(r.src, r.bucket, r.row_count) for r in out.collect()] == [("a", at(0), 1)]
