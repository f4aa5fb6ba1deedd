import datetime as dt
import os

from pyspark.sql import functions as F

from relmon.operators.alerts import _alert_row
from relmon.sinks import store
from relmon.streaming import streams

AS_OF = dt.datetime(2024, 1, 31)


def _bl(spark, mean, ts, metrics=("a", "b")):
    rows = [(m, "db", "t", mean, 1.0, 5, ts) for m in metrics]
    return spark.createDataFrame(rows, "metric_name string, source_database string, table_name string, "
                                       "mean_value double, std_deviation double, sample_size int, "
                                       "calculation_timestamp timestamp_ntz").select(
        "metric_name", "source_database", "table_name", F.col("mean_value").cast("decimal(15,4)").alias("mean_value"),
        F.col("std_deviation").cast("decimal(15,4)").alias("std_deviation"), "sample_size", "calculation_timestamp")


def test_baseline_upsert_versions(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "baselines")
    store.upsert_baselines(spark, _bl(spark, 1.0, AS_OF - dt.timedelta(days=1)), p)
    store.upsert_baselines(spark, _bl(spark, 2.0, AS_OF, metrics=("a",)), p)
    cur = {r.metric_name: float(r.mean_value) for r in store.read_latest(spark, p).collect()}
    assert cur == {"a": 2.0, "b": 1.0}
    assert store.prune_versions(spark, p, keep=1) == 1
    assert store.read_latest(spark, p).count() == 2


def test_alert_append_idempotent_and_retention(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "alerts")
    rows = [("VOLUME_ANOMALY", AS_OF - dt.timedelta(days=d)) for d in (0, 1, 100)]
    df = spark.createDataFrame(rows, "t string, ts timestamp_ntz").select(
        *_alert_row(F.col("t"), "CRITICAL", "d", "tbl", F.col("ts")))
    store.append_alerts(spark, df, p)
    store.append_alerts(spark, df, p)          # replay: nothing new
    assert spark.read.parquet(p).count() == 3
    dropped = store.drop_expired_alerts(spark, p, AS_OF, days=90)
    assert len(dropped) == 1 and spark.read.parquet(p).count() == 2


def test_stream_hourly_matches_batch(spark, tmpdir_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=7 * i)) for i in range(200)]
    src = os.path.join(tmpdir_path, "src")
    spark.createDataFrame(rows, "id long, ts timestamp_ntz").coalesce(1).write.parquet(src)
    schema = spark.read.parquet(src).schema
    s = streams.file_stream(spark, src, schema)
    out = streams.run_to_table(streams.hourly_counts(s, "ts"), "t")
    got = {r.bucket: r.row_count for r in out.collect()}
    last = max(r[1] for r in rows)
    expect = {}
    for _, t in rows:
        h = t.replace(minute=0, second=0)
        expect[h] = expect.get(h, 0) + 1
    closed = {h: n for h, n in expect.items() if h + dt.timedelta(hours=1) <= last - dt.timedelta(hours=1)}
    assert got == closed
