"""Health scorecards from the alert and baseline stores.

All scores are column arithmetic over small aggregates: the alert store is
reduced with conditional aggregates in ONE pass (per period for the
history), the baseline store with one global aggregate, and the two are
attached to the per-period rows as a scalar subquery (no join).
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmon.functions import stats as S
from relmon.operators.alerts import CONTRACT_VIOLATION, STALE_DATA_FLOW, VOLUME_ANOMALY
from relmon.operators.profile import _lit_ts, to_datetime

# Recommendation texts, one per component scoring below 75.
REC_PLATFORM = "High Priority: Address critical platform reliability issues"
REC_BATCH = "Investigate: Review batch processing volume anomalies"
REC_CDC = "Optimize: Investigate CDC data flow staleness"
REC_CONTRACT = "Enforce: Review and update data contracts"
REC_MAINTAIN = "Maintain: Continue current monitoring practices"


def recent(alerts: DataFrame, as_of, hours: float = 24.0, ts_col: str = "alert_timestamp") -> DataFrame:
    hi = to_datetime(as_of)
    lo = hi - _dt.timedelta(hours=hours)
    ts = F.col(ts_col)
    return alerts.filter((ts >= F.lit(lo).cast("timestamp_ntz")) & (ts <= F.lit(hi).cast("timestamp_ntz")))


def alert_stats(alerts: DataFrame, as_of, hours: float = 24.0) -> DataFrame:
    """Recent alerts by (type, severity): count, latest, the per-type total
    across severities, ordered by count."""
    g = recent(alerts, as_of, hours).groupBy("alert_type", "alert_severity").agg(
        F.count(F.lit(1)).alias("alert_count"), F.max("alert_timestamp").alias("latest_alert"))
    g = g.withColumn("type_total", F.sum("alert_count").over(Window.partitionBy("alert_type")))
    return g.orderBy(F.desc("alert_count"), "alert_type", "alert_severity")


def alert_totals(alerts: DataFrame) -> DataFrame:
    return alerts.agg(F.count(F.lit(1)).alias("total_alerts"), F.min("alert_timestamp").alias("earliest_alert"),
                      F.max("alert_timestamp").alias("latest_alert"))


def severity_distribution(alerts: DataFrame) -> DataFrame:
    g = alerts.groupBy("alert_severity").agg(F.count(F.lit(1)).alias("alert_count"))
    return g.withColumn("share", F.col("alert_count") / F.sum("alert_count").over(Window.partitionBy()))


def detection_status(alerts: DataFrame, as_of, hours: float = 24.0) -> DataFrame:
    return recent(alerts, as_of, hours).groupBy("alert_type").agg(
        F.count(F.lit(1)).alias("alert_count"), F.max("alert_timestamp").alias("latest_alert"))


def profiling_status(baselines: DataFrame) -> DataFrame:
    return baselines.groupBy("metric_name").agg(F.count(F.lit(1)).alias("baseline_count"),
                                                F.max("calculation_timestamp").alias("last_calculated"))


def baseline_inventory(baselines: DataFrame) -> DataFrame:
    return baselines.agg(F.count(F.lit(1)).alias("total_baselines"),
                         F.max("calculation_timestamp").alias("last_updated"))


def _n(cond: Column) -> Column:
    """Conditional count that is 0 (not NULL) over an empty input."""
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def _alert_counts(alerts: DataFrame, by: Sequence[Column] = ()) -> DataFrame:
    t = F.col("alert_type")
    return alerts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("alerts_24h"),
        _n(F.col("alert_severity") == "CRITICAL").alias("critical_24h"),
        _n(t == VOLUME_ANOMALY).alias("volume_anomalies"),
        _n(t == STALE_DATA_FLOW).alias("stale_alerts"),
        _n(t == CONTRACT_VIOLATION).alias("contract_violations"),
        F.max("alert_timestamp").alias("latest_alert_24h"),
        *[F.max(F.when(t == kind, F.col("alert_timestamp"))).alias(f"latest_{name}_alert")
          for name, kind in (("volume", VOLUME_ANOMALY), ("stale", STALE_DATA_FLOW), ("contract", CONTRACT_VIOLATION))])


def scores(df: DataFrame) -> DataFrame:
    """Score columns from (alerts_24h, critical_24h, volume_anomalies,
    stale_alerts, contract_violations, total_baselines).

    Fixed values: the scores, penalties and limits of the bands below.
    ``gate_passed`` looks at the platform score, ``anomaly_gate_passed`` at any
    anomaly or violation."""
    b = F.col("total_baselines")
    crit = F.col("critical_24h").cast("double")
    base = F.when(b > 0, F.greatest(F.lit(0.0), F.lit(100.0) - crit / F.greatest(b, F.lit(1)) * 50.0)) \
        .otherwise(F.lit(50.0))
    tot = F.col("alerts_24h")
    pen = F.least(F.lit(20.0), (tot - 10).cast("double") * 2.0)
    platform = S.round_half_even(F.when(tot > 10, F.greatest(F.lit(0.0), base - pen)).otherwise(base), 1)
    nv, ns, nc = F.col("volume_anomalies"), F.col("stale_alerts"), F.col("contract_violations")
    batch = (F.when(nv == 0, 100.0).when(nv <= 2, 75.0)
             .otherwise(F.greatest(F.lit(0.0), (100 - nv * 20).cast("double"))))
    batch_status = F.when(nv == 0, "Healthy").when(nv <= 2, "Minor Anomaly").otherwise("Anomaly")
    cdc = (F.when(ns == 0, 100.0).when(ns <= 1, 80.0)
           .otherwise(F.greatest(F.lit(0.0), (100 - ns * 25).cast("double"))))
    cdc_status = F.when(ns == 0, "Healthy").when(ns <= 1, "Minor Staleness").otherwise("Stale")
    contract = (F.when(nc == 0, 100.0).when(nc <= 3, 85.0)
                .otherwise(F.greatest(F.lit(0.0), (100 - nc * 15).cast("double"))))
    contract_status = F.when(nc == 0, "Compliant").when(nc <= 3, "Minor Violation").otherwise("Violated")
    out = (df.withColumn("platform_score", platform)
             .withColumn("batch_score", S.round_half_even(batch, 1))
             .withColumn("cdc_score", S.round_half_even(cdc, 1))
             .withColumn("contract_score", S.round_half_even(contract, 1))
             .withColumn("batch_status", batch_status)
             .withColumn("cdc_status", cdc_status)
             .withColumn("contract_status", contract_status))
    p, bs, cs, ks = (F.col("platform_score"), F.col("batch_score"), F.col("cdc_score"), F.col("contract_score"))
    low = F.least(p, bs, cs, ks)
    out = (out.withColumn("platform_status", F.when(p >= 90, "Excellent").when(p >= 75, "Good")
                          .when(p >= 60, "Fair").otherwise("Poor"))
              .withColumn("batch_band", F.when(bs >= 90, "Healthy").when(bs >= 70, "Minor Anomaly").otherwise("Anomaly"))
              .withColumn("cdc_band", F.when(cs >= 90, "Healthy").when(cs >= 75, "Minor Staleness").otherwise("Stale"))
              .withColumn("contract_band", F.when(ks >= 90, "Compliant").when(ks >= 80, "Minor Violation")
                          .otherwise("Violated"))
              .withColumn("overall_status", F.when(low < 60, "CRITICAL").when(low < 75, "ATTENTION")
                          .otherwise("HEALTHY")))
    recs = F.array_compact(F.array(F.when(p < 75, F.lit(REC_PLATFORM)), F.when(bs < 75, F.lit(REC_BATCH)),
                                   F.when(cs < 75, F.lit(REC_CDC)), F.when(ks < 75, F.lit(REC_CONTRACT))))
    out = out.withColumn("recommendations", F.when(F.size(recs) == 0, F.array(F.lit(REC_MAINTAIN))).otherwise(recs))
    return out.withColumn("gate_passed", p >= 75).withColumn("anomaly_gate_passed", (nv + ns + nc) == 0)


def scorecard(alerts: DataFrame, baselines: DataFrame, as_of, hours: float = 24.0) -> DataFrame:
    """The portfolio health report as one row."""
    a = _alert_counts(recent(alerts, as_of, hours))
    t = alerts.agg(F.struct(F.count(F.lit(1)).alias("total_alerts"),
                            F.max("alert_timestamp").alias("latest_alert")).alias("_t"))
    b = baselines.agg(F.struct(F.count(F.lit(1)).alias("total_baselines"),
                               F.max("calculation_timestamp").alias("last_updated")).alias("_b"))
    # alerts of the period by type, "TYPE=count" in the order of the names
    types = recent(alerts, as_of, hours).groupBy("alert_type").agg(F.count(F.lit(1)).alias("n"))
    types = types.agg(F.array_sort(F.collect_list(F.concat_ws("=", "alert_type", "n"))).alias("types"))
    # one-row aggregates attached as scalar subqueries: no join
    j = (a.withColumn("_t", t.scalar()).withColumn("_b", b.scalar()).withColumn("alert_types", types.scalar())
          .select("*", "_t.*", "_b.*").drop("_t", "_b"))
    return scores(j.withColumn("generated_at", _lit_ts(as_of)))


def scorecard_history(alerts: DataFrame, baselines: DataFrame, period: str = "day") -> DataFrame:
    """Scores per calendar day of the alert store (days without alerts have
    no row).  The baseline count is a scalar subquery."""
    a = _alert_counts(alerts, [F.to_date("alert_timestamp").alias("score_date")])
    b = baselines.agg(F.count(F.lit(1)).alias("total_baselines"))
    j = a.withColumn("total_baselines", b.scalar())
    return scores(j)


def health_trend(history: DataFrame, window_days: int = 7, keys: Sequence[str] = (),
                 score_col: str = "platform_score", tolerance: float = 1.0) -> DataFrame:
    """Score against the mean of the previous ``window_days`` days:
    improving / declining / stable (within ``tolerance`` points).  The
    window runs over the per-day history (one row per day and key)."""
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(
        F.datediff(F.col("score_date"), F.lit(_dt.date(1970, 1, 1)))).rangeBetween(-int(window_days), -1)
    prev = F.avg(F.col(score_col)).over(w)
    diff = F.col(score_col) - F.col("prior_mean")
    return (history.withColumn("prior_mean", S.as_stat(prev))
                   .withColumn("trend", F.when(F.col("prior_mean").isNull(), F.lit(None))
                               .when(diff > tolerance, F.lit("improving"))
                               .when(diff < -tolerance, F.lit("declining")).otherwise(F.lit("stable"))))
