import datetime as dt

import pytest
from pyspark.sql import functions as F

from relmon.operators import alerts as A
from relmon.operators import scorecard as H
from relmon.operators.alerts import ALERT_COLUMNS, _alert_row

AS_OF = dt.datetime(2024, 1, 31)


def _alerts(spark, spec):
    rows = []
    for i, (atype, sev) in enumerate(spec):
        rows.append((i, atype, sev, AS_OF - dt.timedelta(hours=1, minutes=i)))
    if not rows:
        rows = [(0, "X", "X", AS_OF - dt.timedelta(days=10))]
    df = spark.createDataFrame(rows, "i int, t string, s string, ts timestamp_ntz")
    return df.select(*_alert_row(F.col("t"), F.col("s"), "d", "tbl", F.col("ts")))


def _baselines(spark, n):
    rows = [(f"m{i}", "db", "t", 1.0, 1.0, 10, AS_OF) for i in range(n)]
    return spark.createDataFrame(rows, "metric_name string, source_database string, table_name string, "
                                       "mean_value double, std_deviation double, sample_size int, "
                                       "calculation_timestamp timestamp_ntz")


@pytest.mark.parametrize("nb,spec,platform,batch,cdc,contract,overall", [
    (2, [], 100.0, 100.0, 100.0, 100.0, "HEALTHY"),
    (2, [("VOLUME_ANOMALY", "CRITICAL")], 75.0, 75.0, 100.0, 100.0, "HEALTHY"),
    (3, [("VOLUME_ANOMALY", "CRITICAL"), ("STALE_DATA_FLOW", "CRITICAL")], 66.7, 75.0, 80.0, 100.0, "ATTENTION"),
    (20, [("CONTRACT_VIOLATION", "CRITICAL")] * 12, 66.0, 100.0, 100.0, 0.0, "CRITICAL"),
    (0, [], 50.0, 100.0, 100.0, 100.0, "CRITICAL"),
    (8, [("CONTRACT_VIOLATION", "CRITICAL")] * 3, 81.2, 100.0, 100.0, 85.0, "HEALTHY"),
])
def test_scorecard_table(spark, nb, spec, platform, batch, cdc, contract, overall):
    r = H.scorecard(_alerts(spark, spec), _baselines(spark, nb), AS_OF).first()
    assert (r.platform_score, r.batch_score, r.cdc_score, r.contract_score) == (platform, batch, cdc, contract)
    assert r.overall_status == overall
    assert r.gate_passed is (platform >= 75)


def test_dedup_and_new_alerts(spark):
    a = _alerts(spark, [("VOLUME_ANOMALY", "CRITICAL")] * 3 + [("STALE_DATA_FLOW", "WARNING")])
    d = A.dedup_daily(a).collect()
    assert sorted((r.alert_type, r.duplicates) for r in d) == [("STALE_DATA_FLOW", 1), ("VOLUME_ANOMALY", 3)]
    # null-safe insert-if-absent: replaying the same batch adds nothing
    assert A.new_alerts(a, a).count() == 0
    assert A.new_alerts(a, a.limit(0)).count() == 4


def test_cooldown_not_chained(spark):
    ts = [AS_OF + dt.timedelta(minutes=m) for m in (0, 30, 59, 70, 200)]
    df = spark.createDataFrame([("T", "tbl", t, i) for i, t in enumerate(ts)],
                               "alert_type string, source_table string, alert_timestamp timestamp_ntz, i int")
    kept = sorted(r.i for r in A.cooldown(df, 60, order_cols=["i"]).collect())
    # gaps to the previous alert: -, 30, 29, 11, 130 -> keep first and last only
    assert kept == [0, 4]


def test_trend(spark):
    rows = [(dt.date(2024, 1, d), float(s)) for d, s in zip(range(1, 10), [80, 80, 80, 80, 80, 80, 80, 90, 60])]
    h = spark.createDataFrame(rows, "score_date date, platform_score double")
    t = {r.score_date.day: r.trend for r in H.health_trend(h).collect()}
    assert t[1] is None and t[2] == "stable" and t[8] == "improving" and t[9] == "declining"
