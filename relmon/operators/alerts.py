"""Alerts: one uniform row shape for every finding, de-duplication,
cool-down and retention.

Every finding (volume, freshness, contract) becomes a row of the alerts
schema below.  De-duplication is a ``groupBy(key)`` with ``min_by`` (map-side
partial aggregation: a key that holds a third of all alerts is reduced in
every map task before the shuffle), never a window over a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmon.functions import stats as S
from relmon.operators.detect import previous_in_sequence
from relmon.operators.profile import _lit_ts, to_datetime

# Alert types emitted by the checks.
VOLUME_ANOMALY = "VOLUME_ANOMALY"
STALE_DATA_FLOW = "STALE_DATA_FLOW"
CONTRACT_VIOLATION = "CONTRACT_VIOLATION"

ALERT_SCHEMA = (
    "alert_type string, alert_severity string, description string, source_table string, contract_name string, "
    "field_name string, expected_type string, actual_type string, metric_value decimal(15,4), "
    "threshold_value decimal(15,4), z_score decimal(10,4), details string, alert_timestamp timestamp_ntz, "
    "resolved boolean, resolved_timestamp timestamp_ntz")
ALERT_COLUMNS = [f.strip().split(" ")[0] for f in ALERT_SCHEMA.split(", ")]
# identity of an alert in the store (NULL parts compare equal)
ALERT_KEY = ("alert_type", "source_table", "contract_name", "field_name", "alert_timestamp")


def _alert_row(alert_type, severity, description, source_table, alert_ts, contract_name=None, field_name=None,
               expected_type=None, actual_type=None, metric_value=None, threshold_value=None, z_score=None,
               details=None) -> list[Column]:
    def c(x, t):
        if x is None:
            return F.lit(None).cast(t)
        return (x if isinstance(x, Column) else F.lit(x)).cast(t)
    return [c(alert_type, "string").alias("alert_type"), c(severity, "string").alias("alert_severity"),
            c(description, "string").alias("description"), c(source_table, "string").alias("source_table"),
            c(contract_name, "string").alias("contract_name"), c(field_name, "string").alias("field_name"),
            c(expected_type, "string").alias("expected_type"), c(actual_type, "string").alias("actual_type"),
            c(metric_value, "decimal(15,4)").alias("metric_value"),
            c(threshold_value, "decimal(15,4)").alias("threshold_value"),
            c(z_score, "decimal(10,4)").alias("z_score"), c(details, "string").alias("details"),
            c(alert_ts, "timestamp_ntz").alias("alert_timestamp"),
            F.lit(False).alias("resolved"), F.lit(None).cast("timestamp_ntz").alias("resolved_timestamp")]


def volume_alerts(checks: DataFrame, as_of, severity: str = "CRITICAL") -> DataFrame:
    """VOLUME_ANOMALY rows for the anomalous volume checks."""
    d = F.to_json(F.struct(F.col("current_count"), F.col("baseline_mean").cast("double").alias("baseline_mean"),
                           F.col("baseline_std").cast("double").alias("baseline_std_dev"), F.col("sample_size"),
                           F.col("z_score").cast("double").alias("z_score"),
                           F.date_format("latest_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("latest_timestamp")))
    return checks.filter(F.col("is_anomaly")).select(*_alert_row(
        VOLUME_ANOMALY, severity, F.col("description"), F.col("source_table"), _lit_ts(as_of),
        metric_value=F.col("current_count"), threshold_value=F.col("threshold_value"), z_score=F.col("z_score"),
        details=d))


def freshness_alerts(checks: DataFrame, as_of, severity: str = "CRITICAL") -> DataFrame:
    """STALE_DATA_FLOW rows for the stale freshness checks."""
    d = F.to_json(F.struct(F.date_format("latest_timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("latest_timestamp"),
                           F.date_format("as_of", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("current_timestamp"),
                           F.col("minutes_since_last").cast("double").alias("minutes_since_last"),
                           F.col("threshold_minutes").cast("double").alias("threshold_minutes")))
    return checks.filter(F.col("is_stale")).select(*_alert_row(
        STALE_DATA_FLOW, severity, F.col("description"), F.col("source_table"), _lit_ts(as_of),
        metric_value=F.col("minutes_since_last"), threshold_value=F.col("threshold_minutes"), details=d))


def contract_alerts(violation_rows: DataFrame, contract_name: str, source_table: str, as_of,
                    severity: str = "CRITICAL") -> DataFrame:
    """CONTRACT_VIOLATION rows, one per violation row."""
    desc = F.coalesce(F.element_at("errors", 1), F.col("violation_type"))
    d = F.to_json(F.struct("violation_type", "errors"))
    return violation_rows.select(*_alert_row(
        CONTRACT_VIOLATION, severity, desc, source_table, _lit_ts(as_of), contract_name=contract_name,
        field_name=F.col("field_name"), expected_type=F.col("expected_type"), actual_type=F.col("actual_type"),
        details=d))


def union_alerts(*frames: DataFrame) -> DataFrame:
    out = None
    for f in frames:
        f = f.select(*ALERT_COLUMNS)
        out = f if out is None else out.unionByName(f)
    return out


def dedup(alerts: DataFrame, key: Sequence[str] = ALERT_KEY, order: Sequence[str] = ("alert_timestamp",),
          count_col: str | None = "duplicates") -> DataFrame:
    """First alert per key (NULL key parts are equal, as in groupBy).  The
    kept row is the minimum of ``order``; ``duplicates`` counts the group."""
    rest = [c for c in alerts.columns if c not in key]
    ordk = F.struct(*[F.col(c) for c in order])
    aggs = [F.min_by(F.struct(*[F.col(c) for c in rest]), ordk).alias("_a")]
    if count_col:
        aggs.append(F.count(F.lit(1)).alias(count_col))
    g = alerts.groupBy(*key).agg(*aggs)
    return g.select(*key, *[F.col("_a." + c).alias(c) for c in rest], *([count_col] if count_col else []))


def day_key(type_col: str = "alert_type", table_col: str = "source_table", ts_col: str = "alert_timestamp") -> Column:
    """The documented ``type_table_date`` identity of an alert."""
    return F.concat_ws("_", F.lower(F.col(type_col)), F.col(table_col), F.to_date(F.col(ts_col)).cast("string"))


def dedup_daily(alerts: DataFrame, order: Sequence[str] = ("alert_timestamp",)) -> DataFrame:
    """One alert per (type, table, day)."""
    a = alerts.withColumn("dedup_key", day_key()).withColumn("alert_day", F.to_date("alert_timestamp"))
    return dedup(a, key=("dedup_key", "alert_type", "source_table", "alert_day"), order=order)


def new_alerts(batch: DataFrame, store: DataFrame, key: Sequence[str] = ALERT_KEY) -> DataFrame:
    """Alerts of ``batch`` not yet in ``store`` (insert-if-absent), null-safe
    on every key part.  The batch is de-duplicated first."""
    b = dedup(batch, key, count_col=None)
    s = store.select(*[F.col(k).alias(f"_s_{k}") for k in key]).distinct()
    cond = None
    for k in key:
        c = F.col(k).eqNullSafe(F.col(f"_s_{k}"))
        cond = c if cond is None else cond & c
    return b.join(s, cond, "left_anti")


def cooldown(alerts: DataFrame, minutes: float, key: Sequence[str] = ("alert_type", "source_table"),
             ts_col: str = "alert_timestamp", order_cols: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """Drop an alert when the previous alert of the same key (kept or not:
    the rule is not chained) is less than ``minutes`` earlier.  Uses the
    skew-safe ``previous_in_sequence``, so a noisy key is not sorted in one
    task, also when all of its alerts carry one timestamp."""
    p = previous_in_sequence(alerts, list(key), ts_col, list(order_cols), partitions=partitions)
    gap = S.minutes_between("prev_ts", ts_col)
    return (p.withColumn("gap_minutes", S.as_stat(gap))
             .filter(F.col("prev_ts").isNull() | (gap >= float(minutes))))


def retention(alerts: DataFrame, as_of, days: int = 90, ts_col: str = "alert_timestamp") -> DataFrame:
    """Rows kept by a retention of ``days`` (a filter at rewrite time)."""
    import datetime as _dt
    lo = to_datetime(as_of) - _dt.timedelta(days=int(days))
    return alerts.filter(F.col(ts_col) >= F.lit(lo).cast("timestamp_ntz"))


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(~F.coalesce(F.col("resolved"), F.lit(False)))
