import datetime as dt

import pytest
from pyspark.sql import functions as F

from relmon.operators import detect as D
from relmon.operators import profile as P

AS_OF = dt.datetime(2024, 1, 31, 12, 0, 0)


def _rows(spark, times):
    return spark.createDataFrame([(i, t) for i, t in enumerate(times)], "id long, created_at timestamp_ntz")


def _baseline(spark, mean=20.0, sd=5.0, n=100):
    return spark.createDataFrame(
        [("hourly_ingestion_rate", "cdc_history_db", "dim_orders_history", mean, sd, n)],
        "metric_name string, source_database string, table_name string, mean_value double, "
        "std_deviation double, sample_size int").select(
        "metric_name", "source_database", "table_name", F.col("mean_value").cast("decimal(15,4)").alias("mean_value"),
        F.col("std_deviation").cast("decimal(15,4)").alias("std_deviation"), "sample_size")


def test_volume_drop(spark):
    df = _rows(spark, [AS_OF - dt.timedelta(minutes=5), AS_OF - dt.timedelta(minutes=1)])
    r = D.volume_check(df, "created_at", _baseline(spark), AS_OF, "hourly_ingestion_rate", "dim_orders_history").first()
    assert r.current_count == 2
    assert float(r.z_score) == pytest.approx(3.6)
    assert float(r.signed_z) == pytest.approx(-3.6)
    assert r.is_anomaly and r.status == "evaluated" and r.severity_band == "critical"
    assert float(r.threshold_value) == pytest.approx(35.0)
    assert float(r.drop_pct) == pytest.approx(90.0)
    assert r.description == "Volume anomaly detected: 2 records (Z-Score: 3.60)"


def test_volume_skips(spark):
    empty = _rows(spark, [AS_OF - dt.timedelta(hours=5)])
    r = D.volume_check(empty, "created_at", _baseline(spark), AS_OF, "hourly_ingestion_rate",
                       "dim_orders_history").first()
    assert r.status == "skipped_no_data" and not r.is_anomaly
    nob = D.volume_check(_rows(spark, [AS_OF]), "created_at", _baseline(spark).limit(0), AS_OF,
                         "hourly_ingestion_rate", "dim_orders_history").first()
    assert nob.status == "skipped_no_baseline" and not nob.is_anomaly


@pytest.mark.parametrize("minutes,stale", [(45, True), (10, False), (30, False)])
def test_freshness(spark, minutes, stale):
    df = _rows(spark, [AS_OF - dt.timedelta(minutes=minutes)])
    r = D.freshness_check(df, "created_at", AS_OF, "dim_orders_history").first()
    assert float(r.minutes_since_last) == pytest.approx(minutes)
    assert r.is_stale is stale
    if minutes == 45:
        assert float(r.staleness_factor) == pytest.approx(1.5) and r.impact_level == "HIGH"


def test_freshness_empty(spark):
    df = _rows(spark, [AS_OF]).limit(0)
    r = D.freshness_check(df, "created_at", AS_OF, "t").first()
    assert r.status == "skipped_no_data" and r.is_stale is False


def test_previous_in_sequence_matches_lag(spark):
    # brute force: per key, sort by time and take the previous row
    base = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        rows.append((i % 3, base + dt.timedelta(minutes=(i * 37) % 5000), i))
    df = spark.createDataFrame(rows, "k int, ts timestamp_ntz, id int")
    got = {r.id: r.prev_ts for r in D.previous_in_sequence(df, ["k"], "ts", ["id"]).collect()}
    expect = {}
    for k in range(3):
        seq = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1], r[2]))
        prev = None
        for r in seq:
            expect[r[2]] = prev
            prev = r[1]
    assert got == expect


def test_rolling_excludes_current_bucket(spark):
    base = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([("m", base + dt.timedelta(hours=h), float(v)) for h, v in
                               enumerate([10, 12, 11, 13, 100])], "metric_name string, bucket timestamp_ntz, value double")
    r = P.rolling_baselines(s, ["metric_name"], "hour", window=24).orderBy("bucket").collect()
    assert r[0].trailing_n == 0 and r[0].trailing_mean is None
    assert r[4].trailing_n == 4 and float(r[4].trailing_mean) == pytest.approx(11.5)
    assert r[4].is_anomaly


def test_outlier_rejection(spark):
    vals = [10.0] * 6 + [11.0] * 6 + [500.0]
    s = spark.createDataFrame([("m", float(i), v) for i, v in enumerate(vals)], "metric_name string, b double, value double")
    r = P.outlier_rejected_baselines(s.withColumnRenamed("b", "bucket"), ["metric_name"]).first()
    assert r.rejected == 1 and r.sample_size == 12 and float(r.mean_value) == pytest.approx(10.5)
    assert r.baseline_status == "ok"


def test_fill_gaps(spark):
    base = dt.datetime(2024, 1, 1)
    s = spark.createDataFrame([("a", "m", base, 3.0), ("a", "m", base + dt.timedelta(hours=3), 5.0)],
                              "src string, metric_name string, bucket timestamp_ntz, value double")
    g = P.fill_gaps(s, ["src"], "hour").orderBy("bucket").collect()
    assert [r.value for r in g] == [3.0, 0.0, 0.0, 5.0]


def test_previous_in_sequence_splits_a_hot_key_at_one_time(spark):
    from pyspark.sql import functions as F
    t = dt.datetime(2024, 1, 1)
    rows = [("hot", t, i) for i in range(4000)] + [("cold", t + dt.timedelta(minutes=i), i) for i in range(50)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, id int")
    out = D.previous_in_sequence(df, ["k"], "ts", ["id"], partitions=8)
    got = out.groupBy("k").agg(F.count("*").alias("n"), F.count("prev_ts").alias("p"),
                               F.max(F.expr("timestampdiff(MINUTE, prev_ts, ts)")).alias("g")).collect()
    assert {r.k: (r.n, r.p, r.g) for r in got} == {"hot": (4000, 3999, 0), "cold": (50, 49, 1)}
    spread = D._in_time_ranges(df, ["k"], "ts", ["id"], 8).filter("k = 'hot'").groupBy("_part").count().collect()
    assert len(spread) >= 6 and max(r["count"] for r in spread) < 1500


def test_interarrival_reads_its_table_once_without_join(spark, tmpdir_path):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i % 3, base + dt.timedelta(minutes=i * i % 977)) for i in range(300)], "k int, ts timestamp_ntz")
    df.write.parquet(tmpdir_path + "/t")
    q = D.interarrival_freshness(spark.read.parquet(tmpdir_path + "/t"), ["k"], "ts", "2024-01-02 00:00:00")
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan
