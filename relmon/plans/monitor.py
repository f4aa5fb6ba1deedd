"""One monitoring run.

    sources + metric specs --(one scan per source and grain)--> metric series
        -> baselines (stored form)                       profiling run
        -> checks: last complete bucket before as-of      volume / business metrics,
                   vs the window or the stored baseline   per-metric thresholds
        -> freshness per table                            staleness
    [records + contract] -> violations                    contract run
    checks + violations -> alerts (de-duplicated) -> scorecard

Nothing is collected: every output is a DataFrame the caller writes (for
instance with :mod:`relmon.sinks.store`) or inspects.  With ``materialize``
the aggregated series, the freshness aggregates and the violations are written
once into the shared checkpoint folder while the run is being built; without
it the whole run is one lazy DAG.  Metric thresholds and severities are applied
with a CASE over the (driver-side, config-sized) metric specs, not a join.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relmon.functions import stats as S
from relmon.operators import alerts as A
from relmon.operators import contract as C
from relmon.operators import detect as D
from relmon.operators import profile as P
from relmon.operators import scorecard as H
from relmon.operators.contract import _render
from relmon.session import ensure_checkpoint_dir
from relmon.sources.logs import sample_records
from relmon.specs import DEFAULT_STALENESS_MINUTES, Contract, MetricSpec, SourceSpec


@dataclass
class MonitoredSource:
    source: SourceSpec
    metrics: Sequence[MetricSpec]
    freshness_minutes: float | None = DEFAULT_STALENESS_MINUTES
    df: DataFrame | None = None          # an already loaded frame instead of source.read()
    as_of: object = None                 # per-source evaluation time (default: the run's)


def _lower_bound(m: MetricSpec, as_of) -> _dt.datetime:
    """Start of a metric's own window; of two windows the longer counts."""
    hi = P.to_datetime(as_of)
    bounds = []
    if m.window_days:
        bounds.append(_dt.datetime(hi.year, hi.month, hi.day) - _dt.timedelta(days=int(m.window_days)))
    if m.window_hours:
        bounds.append(hi - _dt.timedelta(hours=float(m.window_hours)))
    if not bounds:
        bounds.append(hi - _dt.timedelta(hours=24) if m.grain == "hour"
                      else _dt.datetime(hi.year, hi.month, hi.day) - _dt.timedelta(days=30))
    return min(bounds)


def _agg_for(m: MetricSpec, inside: Column) -> Column:
    """NULL for a bucket without rows inside the metric's window."""
    if m.kind == "volume":
        n = F.count(F.when(inside, 1))
        return F.when(n > 0, n)
    if m.kind == "sum":
        return F.sum(F.when(inside, F.col(m.value_column)))
    if m.kind == "avg":
        return F.avg(F.when(inside, F.col(m.value_column)))
    raise ValueError(m.kind)


def _per_metric(metrics: Sequence[MetricSpec], value, default) -> Column:
    c = F.lit(default)
    for m in metrics:
        c = F.when(F.col("metric_name") == m.name, F.lit(value(m))).otherwise(c)
    return c


def source_series(src: MonitoredSource, spark: SparkSession, as_of) -> dict[str, DataFrame]:
    """Series per grain; all metrics of one grain come from ONE scan, bounded
    by the widest window, and each metric counts its own window only."""
    df = src.df if src.df is not None else src.source.read(spark)
    out = {}
    ts = F.col(src.source.time_column)
    for grain in ("hour", "day"):
        ms = [m for m in src.metrics if m.kind != "freshness" and m.grain == grain]
        if not ms:
            continue
        low = {m.name: _lower_bound(m, as_of) for m in ms}
        at = lambda t: F.lit(t).cast("timestamp_ntz")
        scan = df.filter(ts >= at(min(low.values()))).filter(ts < at(P.to_datetime(as_of)))
        series = P.metric_series(scan, src.source.time_column, grain=grain, as_of=as_of, upper_bound=False,
                                 metrics={m.name: _agg_for(m, ts >= at(low[m.name])) for m in ms})
        out[grain] = series.filter(F.col("value").isNotNull())
    return out


def _against_store(dev: DataFrame, store: DataFrame, table_name: str, threshold: Column) -> DataFrame:
    """Score the current buckets against the latest stored baselines."""
    base = D.latest_baseline(store.filter(F.col("table_name") == table_name), ["metric_name", "table_name"]).select(
        "metric_name", "mean_value", "std_deviation", "sample_size")
    j = dev.select("metric_name", "current_bucket", "current_value").join(base, "metric_name", "left")
    z = S.signed_z("current_value", "mean_value", "std_deviation")
    status = (F.when(F.col("current_value").isNull(), "skipped_no_data")
              .when(F.col("mean_value").isNull(), "skipped_no_baseline").otherwise("evaluated"))
    return j.select("metric_name", "current_bucket", "current_value", "mean_value", "std_deviation", "sample_size",
                    S.as_stat(S.expected_low("mean_value", "std_deviation", threshold)).alias("expected_low"),
                    S.as_stat(S.threshold_value("mean_value", "std_deviation", threshold)).alias("expected_high"),
                    S.as_z(z).alias("signed_z"), F.coalesce(S.is_anomaly(z, threshold), F.lit(False)).alias("is_anomaly"),
                    S.severity_band(z).alias("severity_band"), status.alias("status"))


def _volume_alerts(dev: DataFrame, as_of) -> DataFrame:
    """Alert rows of the anomalous metrics, with details."""
    num = lambda c: F.col(c).cast("double")
    details = F.to_json(F.struct(
        F.col("metric_name"), num("current_value").alias("current_value"), num("mean_value").alias("baseline_mean"),
        num("std_deviation").alias("baseline_std_dev"), F.col("sample_size"), F.abs(num("signed_z")).alias("z_score"),
        F.col("current_bucket").cast("timestamp_ntz").cast("string").alias("bucket")))
    text = _render(D.MSG_VOLUME, count=F.concat(F.col("metric_name"), F.lit(" = "), S.fixed("current_value", 2)),
                   z=F.coalesce(S.fixed(F.abs(F.col("signed_z")), 2), F.lit("beyond range")))
    return dev.filter("is_anomaly").select(*A._alert_row(
        A.VOLUME_ANOMALY, F.col("severity"), text, F.col("source_table"), P._lit_ts(as_of),
        field_name=F.col("metric_name"), metric_value=F.col("current_value"), threshold_value=F.col("expected_high"),
        z_score=F.abs(F.col("signed_z")), details=details))


def run(spark: SparkSession, sources: Sequence[MonitoredSource], as_of, contract: Contract | None = None,
        records: DataFrame | None = None, record_id_cols: Sequence[str] = ("record_id",),
        contract_table: str | None = None, baseline_store: DataFrame | None = None,
        materialize: bool = True) -> dict[str, DataFrame]:
    """Outputs: baselines, checks, alerts, scorecard, summary (with the gate)
    and, with a contract, violations and contract_summary.

    Alerts carry the run's ``as_of``, also those of a source evaluated at an
    earlier one, and are de-duplicated by the store's key before they are
    scored.  ``baseline_store`` scores the current buckets against the latest
    stored baselines instead of the window's own.  Each source is read once
    per grain and once for freshness; with ``materialize`` the results of
    those reads are small checkpoints in ``spark.checkpoint.dir``, so a lost
    executor costs a re-read of them, not of the source."""
    if materialize:
        ensure_checkpoint_dir(spark)
    keep = (lambda d: d.checkpoint(eager=True)) if materialize else (lambda d: d)
    baselines, checks, alerts = [], [], []
    for src in sources:
        name, db = src.source.name, src.source.database
        src_as_of = src.as_of if src.as_of is not None else as_of
        for grain, series in source_series(src, spark, src_as_of).items():
            series = keep(series)
            baselines.append(P.baselines(series, as_of=src_as_of, source_database=db, table_name=name))
            thr = _per_metric(src.metrics, lambda m: float(m.threshold), 3.0)
            dev = D.deviation_table(series, keys=["metric_name"], threshold=thr, as_of=src_as_of, grain=grain)
            if baseline_store is not None:
                dev = _against_store(dev, baseline_store, name, thr)
            dev = (dev.withColumn("severity", _per_metric(src.metrics, lambda m: m.severity, "CRITICAL"))
                      .withColumn("source_table", F.lit(name)))
            alerts.append(_volume_alerts(dev, as_of))
            checks.append(dev.select(
                F.lit("volume").alias("check_type"), "source_table", F.col("metric_name").alias("check_key"),
                F.col("current_value").cast("double").alias("metric_value"),
                S.threshold_value("mean_value", "std_deviation", thr).alias("threshold_value"),
                F.abs(F.col("signed_z").cast("double")).alias("z_score"), "is_anomaly", "status"))
        fresh = [m for m in src.metrics if m.kind == "freshness"]
        minutes = float(fresh[0].threshold) if fresh else src.freshness_minutes
        if minutes is not None:
            df = src.df if src.df is not None else src.source.read(spark)
            f = keep(D.freshness_check(df, src.source.time_column, src_as_of, table_name=name, threshold_minutes=minutes))
            alerts.append(A.freshness_alerts(f, as_of, severity=fresh[0].severity if fresh else "CRITICAL"))
            checks.append(D.detection_checks(freshness=f))
    out: dict[str, DataFrame] = {"baselines": _union(baselines), "checks": _union(checks)}
    if contract is not None and records is not None:
        if contract.sample_size_for_run:
            records = sample_records(records, contract.sampling_method, contract.sample_size_for_run,
                                     order_cols=list(record_id_cols))
        val = C.validate_variant(records, contract, keys_col="record_keys" if "record_keys" in records.columns
                                 else None)
        # validated once: the invalid records are kept, of the others only the number is asked for
        broken = keep(val.filter(~F.col("is_valid")).select(*record_id_cols, "violations"))
        rows = C.violation_rows(broken, list(record_id_cols))
        out["violations"] = rows
        out["contract_summary"] = C.summary_of_broken(broken, records)
        alerts.append(A.contract_alerts(rows, contract.name, contract_table or contract.target_table or "records",
                                        as_of, severity=contract.severity))
    out["alerts"] = A.dedup(A.union_alerts(*alerts), order=("alert_timestamp", "description", "details"), count_col=None)
    out["scorecard"] = H.scorecard(out["alerts"], out["baselines"], as_of)
    # the gate of the run: passed when no check is anomalous and no alert was raised
    out["summary"] = D.detection_summary(out["checks"]).withColumn(
        "contract_alerts", out["alerts"].filter(F.col("alert_type") == A.CONTRACT_VIOLATION).agg(F.count(F.lit(1))).scalar()) \
        .withColumn("gate_passed", (F.col("total_anomalies") == 0) & (F.col("contract_alerts") == 0))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
