"""Ordinary inputs outside the test tables: several generations and files,
outages, large numbers, failed jobs, several micro-batches."""
import datetime as dt
import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from relmon.functions import stats as S
from relmon.operators import contract as C
from relmon.operators import detect as D
from relmon.operators import profile as P
from relmon.plans.monitor import MonitoredSource, run, source_series
from relmon.session import ensure_checkpoint_dir
from relmon.sinks import store
from relmon.sources import logs
from relmon.specs import Contract, FieldRule, MetricSpec, SourceSpec, load_registry
from relmon.streaming import streams

T0 = dt.datetime(2024, 1, 10)
BASE = ("metric_name string, source_database string, table_name string, mean_value decimal(15,4), "
        "std_deviation decimal(15,4), sample_size int, calculation_timestamp timestamp_ntz")


def baseline(spark, *rows):
    return spark.createDataFrame([("m", "db", "t", *r) for r in rows],
                                 "metric_name string, source_database string, table_name string, mean_value double, "
                                 "std_deviation double, sample_size int, calculation_timestamp timestamp_ntz")


def test_unset_checkpoint_dir_is_an_error_off_local_mode(monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "yarn"}.get(key, default)

    class Session:
        conf = Conf()

        @property
        def sparkContext(self):
            raise RuntimeError("remote")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_stream_reads_every_file_of_a_directory_table(spark, tmpdir_path):
    rows = [(i, T0 + dt.timedelta(minutes=i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz").repartition(4)
    df.write.parquet(tmpdir_path + "/t.parquet")
    s = streams.file_stream(spark, tmpdir_path + "/t.parquet", df.schema, max_files_per_trigger=1)
    assert streams.run_to_table(s, "dir").count() == 40


def test_stream_feeds_the_stores_over_batches_with_duplicates(spark, tmpdir_path):
    src, alerts, base = (tmpdir_path + x for x in ("/src", "/alerts", "/base"))
    schema = "alert_type string, source_table string, alert_timestamp timestamp_ntz"
    for rows in ([("A", "t", T0), ("B", "t", T0)], [("A", "t", T0), ("C", "t", T0 - dt.timedelta(days=30))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)

    def to_alerts(b):
        from relmon.operators import alerts as A
        return b.select(*A._alert_row(F.col("alert_type"), "CRITICAL", "x", F.col("source_table"), F.col("alert_timestamp")))

    def to_baselines(b):
        return b.groupBy(F.col("alert_type").alias("metric_name")).agg(F.max("alert_timestamp").alias("calculation_timestamp")).select(
            "metric_name", F.lit("db").alias("source_database"), F.lit("t").alias("table_name"),
            F.lit(1).cast("decimal(15,4)").alias("mean_value"), F.lit(0).cast("decimal(15,4)").alias("std_deviation"),
            F.lit(1).alias("sample_size"), "calculation_timestamp")
    s = streams.file_stream(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=1)
    assert streams.run_to_stores(s, base, alerts, to_baselines, to_alerts) == 2
    assert sorted(r.alert_type for r in spark.read.parquet(alerts).collect()) == ["A", "B", "C"]
    assert sorted(r.metric_name for r in store.read_latest(spark, base).collect()) == ["A", "B", "C"]
    n = len(store._attempts(spark, base))
    store.upsert_baselines(spark, baseline(spark, (9.0, 9.0, 9, T0)), base, batch_id=0)     # a replayed batch
    assert len(store._attempts(spark, base)) == n


def test_missing_log_directory_is_empty_and_other_errors_surface(spark, tmpdir_path):
    assert logs.load_json_logs(spark, tmpdir_path + "/none").count() == 0
    with pytest.raises(Exception):
        logs.load_json_logs(spark, "nosuchscheme://x/y").count()


def test_each_metric_has_its_own_window(spark):
    rows = [(T0 - dt.timedelta(days=d, hours=1), 2.0) for d in range(40)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, v double")
    src = MonitoredSource(SourceSpec("t", time_column="ts"), [
        MetricSpec("week", "volume", "day", window_days=7), MetricSpec("month", "sum", "day", window_days=30, value_column="v")], df=df)
    s = source_series(src, spark, T0)["day"]
    assert {r.metric_name: r["count"] for r in s.groupBy("metric_name").count().collect()} == {"week": 7, "month": 30}


def test_key_without_baseline_is_kept_and_few_samples_skip(spark):
    s = spark.createDataFrame([("a", T0, 5.0), ("b", T0, 7.0), ("c", T0, 9.0)], "metric_name string, bucket timestamp_ntz, value double")
    b = spark.createDataFrame([("a", 1.0, 1.0, 20, "ok"), ("c", 1.0, 1.0, 2, "insufficient")],
                              "metric_name string, mean_value double, std_deviation double, sample_size int, baseline_status string")
    got = {r.metric_name: (r.status, r.is_anomaly) for r in D.score_buckets(s, baseline=b).collect()}
    assert got == {"a": ("evaluated", True), "b": ("skipped_no_baseline", False), "c": ("skipped_few_samples", False)}


def test_seasonal_baseline_scores_buckets(spark):
    rows = [(T0 + dt.timedelta(hours=h), float(10 + h % 24)) for h in range(24 * 14)]
    s = spark.createDataFrame(rows, "bucket timestamp_ntz, value double").withColumn("metric_name", F.lit("m"))
    b = P.seasonal_baselines(s, keys=["metric_name"], season="weekpart_hour")
    keys = [c for c in b.columns if c not in ("mean_value", "std_deviation", "sample_size")]
    assert "metric_name" in keys and len(keys) >= 2


def test_latest_generation_counts_not_the_largest_sample(spark):
    df = spark.createDataFrame([(T0 - dt.timedelta(minutes=5),)] * 3, "ts timestamp_ntz")
    b = baseline(spark, (1000.0, 1.0, 100, T0 - dt.timedelta(days=9)), (3.0, 1.0, 5, T0))
    r = D.volume_check(df, "ts", b, T0, "m", "t").first()
    assert float(r.baseline_mean) == 3.0 and not r.is_anomaly


def test_dead_feed_is_skipped_or_zero(spark):
    rows = [("m", T0 - dt.timedelta(hours=h), 10.0 + h % 2) for h in range(16, 40)]
    s = spark.createDataFrame(rows, "metric_name string, bucket timestamp_ntz, value double")
    r = D.deviation_table(s, as_of=T0, grain="hour").first()
    assert r.status == "skipped_no_data" and not r.is_anomaly
    r = D.deviation_table(s, as_of=T0, grain="hour", missing_is_zero=True).first()
    assert r.status == "evaluated" and r.is_anomaly


def test_large_means_and_scores_do_not_end_the_job(spark):
    rows = [("big", T0 + dt.timedelta(hours=i), 2e11 + i) for i in range(5)]
    rows += [("flat", T0 + dt.timedelta(hours=i), 100.0) for i in range(5)]
    s = spark.createDataFrame(rows, "metric_name string, bucket timestamp_ntz, value double")
    assert P.baselines(s).count() == 2
    b = spark.createDataFrame([("flat", 0.0, 0.0001, 9)], "metric_name string, mean_value double, std_deviation double, sample_size int")
    got = D.score_buckets(s.filter("metric_name = 'flat'"), baseline=b).collect()
    assert all(r.is_anomaly and r.z_score is not None or r.is_anomaly for r in got) and len(got) == 5
    z = spark.range(1).select(S.as_z(F.lit(1e9)).alias("z"), S.as_stat(F.lit(1e12)).alias("m")).first()
    assert z.z is None and z.m is None


def test_typed_doubles_of_any_size(spark):
    con = Contract("c", (FieldRule("x", "float", True, False, {"max_value": 10.0, "precision": 2}),))
    vals = [1.25, 1e19, 1e20, 1e21, float("nan"), float("inf"), -1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "id int, x double")
    got = {}
    for r in C.violation_rows(C.validate_typed(df, replace(con, detect_new_fields=False)), ["id"]).collect():
        got[r.id] = r.error_kinds
    assert 0 not in got and 6 not in got
    assert all("max_value" in got[i] for i in (1, 2, 3, 5))
    assert "max_value" not in got.get(4, "")


def test_lenient_mode_with_text_that_is_no_number(spark):
    con = Contract("c", (FieldRule("n", "integer"),), coerce_types=True)
    df = spark.createDataFrame([(1, '{"n":"12"}'), (2, '{"n":"CUST-1"}')], "id int, raw string").select(
        "id", F.parse_json("raw").alias("record"))
    got = {r.id: r.is_valid for r in C.validate_variant(df, con).collect()}
    assert got == {1: True, 2: False}


def test_numbers_of_many_digits_are_integers_and_microseconds_stay(spark):
    con = Contract("c", (FieldRule("n", "integer"),))
    df = spark.createDataFrame([(1, '{"n":12345678901234567890}'), (2, '{"n":1.5}')], "id int, raw string").select(
        "id", F.parse_json("raw").alias("record"))
    assert {r.id: r.is_valid for r in C.validate_variant(df, con).collect()} == {1: True, 2: False}
    t = spark.createDataFrame([(dt.datetime(2024, 1, 1, 2, 3, 4, 5),), (dt.datetime(2024, 1, 1, 2, 3, 4),)], "t timestamp_ntz")
    got = [r[0] for r in logs.table_records(t, ["t"]).select(F.expr("variant_get(record, '$.t', 'string')")).collect()]
    assert got == ["2024-01-01T02:03:04.000005", "2024-01-01T02:03:04"]


def test_filter_after_validation_reaches_the_scan(spark, tmpdir_path):
    con = Contract("c", (FieldRule("x", "float", constraints={"max_value": 5.0}),), detect_new_fields=False)
    spark.createDataFrame([(i, float(i)) for i in range(20)], "day int, x double").write.parquet(tmpdir_path + "/v")
    q = C.validate_typed(spark.read.parquet(tmpdir_path + "/v"), con).filter("day = 3").filter("is_valid")
    assert "EqualTo(day,3)" in q._jdf.queryExecution().executedPlan().toString()
    assert [r.day for r in q.collect()] == [3]


def test_building_a_validation_runs_no_job(spark):
    con = Contract("c", (FieldRule("x", "float"),), detect_new_fields=False)
    df = spark.range(100).select(F.col("id").cast("double").alias("x")).groupBy("x").count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan-only", "x")
    C.validate_typed(df, con)
    assert list(tracker.getJobIdsForGroup("plan-only")) == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_upsert_goes_on_after_a_failed_version(spark, tmpdir_path):
    path = tmpdir_path + "/b"
    store.upsert_baselines(spark, baseline(spark, (1.0, 1.0, 5, T0)), path)
    os.makedirs(path + "/v=00000002")                                        # no _SUCCESS
    store.upsert_baselines(spark, baseline(spark, (2.0, 1.0, 5, T0 + dt.timedelta(days=1))), path)
    assert [float(r.mean_value) for r in store.read_latest(spark, path).collect()] == [2.0]


def test_alert_without_time_is_stored_once_and_outlives_retention(spark, tmpdir_path):
    from relmon.operators import alerts as A
    path = tmpdir_path + "/a"
    df = spark.createDataFrame([("X", None), ("Y", T0 - dt.timedelta(days=400))], "t string, ts timestamp_ntz").select(
        *A._alert_row(F.col("t"), "CRITICAL", "d", "tab", F.col("ts")))
    store.append_alerts(spark, df, path)
    store.append_alerts(spark, df, path)
    assert spark.read.parquet(path).count() == 2
    assert len(store.drop_expired_alerts(spark, path, T0, days=90)) == 1
    assert [r.alert_type for r in spark.read.parquet(path).collect()] == ["X"]


REGISTRY = """
databases:
  shop:
    format: parquet
    path: {path}
    tables:
      - name: sales
        time_column: ts
        metrics:
          - {{name: daily_revenue, type: volume, value_column: amount, window_days: 30, threshold: 2.5, severity: WARNING}}
          - {{name: rows_an_hour, type: volume, window_hours: 12}}
          - {{name: lag, type: freshness, threshold: 120, severity: MEDIUM}}
"""


def test_run_from_a_registry_with_contract_and_stored_baseline(spark, tmpdir_path):
    rows = [(i, T0 - dt.timedelta(hours=i), 10.0 + i % 3) for i in range(2, 24 * 20)]
    rows.append((1, T0 - dt.timedelta(hours=23, minutes=30), 11.0))          # every whole day has the same revenue
    df = spark.createDataFrame(rows, "id int, ts timestamp_ntz, amount double")
    df.write.parquet(tmpdir_path + "/sales.parquet")
    with open(tmpdir_path + "/reg.yaml", "w") as f:
        f.write(REGISTRY.format(path=tmpdir_path))
    sources, metrics = load_registry(tmpdir_path + "/reg.yaml")
    by = {m.name: m for m in metrics["sales"]}
    assert by["daily_revenue"].kind == "sum" and by["daily_revenue"].value_column == "amount"
    assert by["rows_an_hour"].window_hours == 12 and by["lag"].threshold == 120
    con = Contract("k", (FieldRule("n", "integer", True),))
    recs = spark.createDataFrame([(i, '{"n":"x"}') for i in range(60)], "record_id int, raw string").select(
        "record_id", F.parse_json("raw").alias("record"))
    later = T0 + dt.timedelta(days=300)
    out = run(spark, [MonitoredSource(sources["sales"], metrics["sales"], as_of=T0)], later, contract=con, records=recs,
              contract_table="recs")
    checks = {r.check_key: r for r in out["checks"].collect()}
    assert checks["rows_an_hour"].status == "skipped_no_data"               # nothing in the last hour
    assert checks["daily_revenue"].status == "evaluated"
    assert not checks["table"].is_anomaly                                   # two hours late, limit 120 minutes
    alerts = out["alerts"].collect()
    assert [(r.alert_type, r.alert_timestamp) for r in alerts] == [("CONTRACT_VIOLATION", later)]
    s = out["summary"].first()
    assert s.contract_alerts == 1 and not s.gate_passed
    assert out["scorecard"].first().contract_violations == 1
    base = P.baselines(spark.createDataFrame([("daily_revenue", T0, 1.0), ("daily_revenue", T0, 1.1)],
                                             "metric_name string, bucket timestamp_ntz, value double"),
                       as_of=T0, source_database="shop", table_name="sales")
    out = run(spark, [MonitoredSource(sources["sales"], metrics["sales"], as_of=T0)], later, baseline_store=base)
    got = out["alerts"].collect()
    assert [(r.alert_type, r.alert_severity, r.field_name) for r in got] == [("VOLUME_ANOMALY", "WARNING", "daily_revenue")]
    assert '"baseline_mean":1.05' in got[0].details
