"""Detection: current metrics against baselines, freshness, bucket scoring.

Plans, in Spark terms:

* current volume / freshness: one filtered scan of the pruned columns, one
  (optionally grouped) aggregate with map-side partial aggregation.
* current metric joined with the latest baseline: the baseline side is one
  row per metric key.  No static broadcast hint: AQE measures the
  materialised baseline at run time and switches to a broadcast-hash join when
  it is under the broadcast threshold, else keeps the shuffle join.
* bucket scoring against its own series: a window partitioned by metric key
  over the *aggregated* series (never raw rows), so no join at all.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmon.functions import stats as S
from relmon.operators import moments as M
from relmon.operators.contract import _render
from relmon.operators.profile import _lit_ts, to_datetime
from relmon.operators.sequence import in_time_ranges as _in_time_ranges
from relmon.operators.sequence import stage
from relmon.specs import DEFAULT_STALENESS_MINUTES, DEFAULT_Z_THRESHOLD

BASELINE_KEY = ("metric_name", "source_database", "table_name")

# Alert descriptions ({count}/{z}/{minutes} come from the row).
MSG_VOLUME = "Volume anomaly detected: {count} records (Z-Score: {z})"
MSG_STALE = "Data flow stale: {minutes} minutes since last record"


def latest_baseline(store: DataFrame, keys: Sequence[str] = BASELINE_KEY) -> DataFrame:
    """Latest row per key by ``calculation_timestamp`` for all keys at once
    (``max_by`` over a struct; partial aggregation keeps the shuffle to one
    row per key and map task)."""
    cols = [c for c in store.columns if c not in keys]
    agg = store.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.col("calculation_timestamp")).alias("_b"))
    return agg.select(*keys, *[F.col("_b." + c).alias(c) for c in cols])


def current_volume(df: DataFrame, time_col: str, as_of, window_hours: float = 1.0,
                   by: Sequence[str] = ()) -> DataFrame:
    """Rows and latest timestamp in the rolling window ``[as_of - w, as_of]``
    (not clock aligned).  Without ``by`` this is one row even when empty."""
    hi = to_datetime(as_of)
    lo = hi - _dt.timedelta(hours=float(window_hours))
    ts = F.col(time_col)
    cur = df.filter((ts >= F.lit(lo).cast("timestamp_ntz")) & (ts <= F.lit(hi).cast("timestamp_ntz")))
    return cur.groupBy(*by).agg(F.count(F.lit(1)).alias("current_count"), F.max(ts).alias("latest_timestamp"))


def volume_check(df: DataFrame, time_col: str, baseline: DataFrame, as_of, metric_name: str,
                 table_name: str, by: Sequence[str] = (), window_hours: float = 1.0,
                 threshold: float = DEFAULT_Z_THRESHOLD, zero_is_anomaly: bool = False) -> DataFrame:
    """Volume anomaly: current count vs the latest baseline of
    (metric_name, table_name [, by...]).  ``source_database`` is deliberately
    not part of the match.

    Status per key: ``evaluated``; ``skipped_no_baseline`` (no baseline row);
    ``skipped_no_data`` (zero rows in the window: an outage is reported as
    skipped, not as a volume anomaly, unless ``zero_is_anomaly``).
    """
    cur = current_volume(df, time_col, as_of, window_hours, by)
    base = baseline.filter((F.col("metric_name") == metric_name) & (F.col("table_name") == table_name))
    if by and "calculation_timestamp" in base.columns:
        # several generations may be stored: the latest of each key
        base = latest_baseline(base, ["metric_name", "table_name", *by])
    base = base.select(*by, F.col("mean_value").alias("baseline_mean"), F.col("std_deviation").alias("baseline_std"),
                       "sample_size", *[c for c in ("calculation_timestamp",) if c in base.columns and not by])
    if by:
        j = cur.join(base, list(by), "full")
    else:
        # table-level check: the global aggregate is exactly one row; the
        # baseline, reduced to one row, is attached as a scalar subquery
        # (no join of any kind)
        newest = F.col("calculation_timestamp") if "calculation_timestamp" in base.columns else F.col("sample_size")
        one = base.agg(F.max_by(F.struct("baseline_mean", "baseline_std", "sample_size"), newest).alias("_b"))
        j = cur.withColumn("_b", one.scalar()).select("*", "_b.*").drop("_b")
    cnt = F.coalesce(F.col("current_count"), F.lit(0))
    z = S.signed_z(cnt, "baseline_mean", "baseline_std")
    has_base = F.col("baseline_mean").isNotNull()
    has_data = cnt > 0
    evaluated = has_base & (has_data | F.lit(bool(zero_is_anomaly)))
    out = j.select(
        *by,
        F.lit(table_name).alias("source_table"),
        F.lit(metric_name).alias("metric_name"),
        cnt.alias("current_count"),
        "latest_timestamp",
        "baseline_mean", "baseline_std", "sample_size",
        F.when(evaluated, S.as_z(F.abs(z))).alias("z_score"),
        F.when(evaluated, S.as_z(z)).alias("signed_z"),
        S.as_stat(S.threshold_value("baseline_mean", "baseline_std", threshold)).alias("threshold_value"),
        S.as_stat(S.expected_low("baseline_mean", "baseline_std", threshold)).alias("expected_low"),
        S.as_stat(S.threshold_value("baseline_mean", "baseline_std", threshold)).alias("expected_high"),
        F.when(evaluated, S.as_stat(S.drop_pct(cnt, "baseline_mean"))).alias("drop_pct"),
        (evaluated & F.coalesce(S.is_anomaly(z, threshold), F.lit(False))).alias("is_anomaly"),
        F.when(evaluated, S.severity_band(z)).alias("severity_band"),
        F.when(~has_base, F.lit("skipped_no_baseline"))
         .when(~evaluated, F.lit("skipped_no_data")).otherwise(F.lit("evaluated")).alias("status"),
    )
    return out.withColumn(
        "description",
        F.when(F.col("status") == "evaluated",
               _render(MSG_VOLUME, count=F.col("current_count").cast("string"), z=S.fixed("z_score", 2))))


def freshness_check(df: DataFrame, time_col: str, as_of, table_name: str, by: Sequence[str] = (),
                    threshold_minutes: float = DEFAULT_STALENESS_MINUTES) -> DataFrame:
    """Minutes since the latest record per key (naive timestamps are UTC);
    stale when strictly greater than the threshold.  No timestamp at all ->
    ``skipped_no_data`` and not stale."""
    latest = df.groupBy(*by).agg(F.max(time_col).alias("latest_timestamp"))
    asof = _lit_ts(as_of)
    mins = S.minutes_between("latest_timestamp", asof)
    out = latest.select(
        *by,
        F.lit(table_name).alias("source_table"),
        "latest_timestamp",
        asof.alias("as_of"),
        S.as_stat(mins).alias("minutes_since_last"),
        S.as_stat(F.lit(float(threshold_minutes))).alias("threshold_minutes"),
        F.coalesce(mins > float(threshold_minutes), F.lit(False)).alias("is_stale"),
        S.as_stat(S.staleness_factor(mins, threshold_minutes)).alias("staleness_factor"),
        S.impact_level(S.staleness_factor(mins, threshold_minutes)).alias("impact_level"),
        F.when(F.col("latest_timestamp").isNull(), F.lit("skipped_no_data"))
         .otherwise(F.lit("evaluated")).alias("status"),
    )
    return out.withColumn(
        "description",
        F.when(F.col("status") == "evaluated",
               _render(MSG_STALE, minutes=S.fixed("minutes_since_last", 1))))


def score_buckets(series: DataFrame, keys: Sequence[str] = ("metric_name",), baseline: DataFrame | None = None,
                  threshold: float = DEFAULT_Z_THRESHOLD, inclusive: bool = False) -> DataFrame:
    """z of every bucket (which historical hours/days were anomalous).

    Without ``baseline`` each key is scored against the mean / sample sd of
    its own series (window over the aggregated series, one shuffle, no join).
    With ``baseline`` (one row per key, e.g. a seasonal baseline whose keys
    the series carries) the series is left-joined to it.  ``status`` is
    ``evaluated``, ``skipped_no_baseline`` for a key without one, or
    ``skipped_few_samples`` when the baseline is marked insufficient; skipped
    buckets have no z and are no anomalies."""
    if baseline is None:
        w = Window.partitionBy(*keys)
        s = (series.withColumn("mean_value", S.as_stat(F.avg("value").over(w)))
                   .withColumn("std_deviation", S.as_stat(F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0))))
                   .withColumn("sample_size", F.count(F.lit(1)).over(w).cast("int")))
    else:
        marked = "baseline_status" in baseline.columns
        s = series.join(baseline.select(*keys, "mean_value", "std_deviation", "sample_size",
                                        *(["baseline_status"] if marked else [])), list(keys), "left")
    few = F.coalesce(F.col("baseline_status") == "insufficient", F.lit(False)) if "baseline_status" in s.columns \
        else F.lit(False)
    s = s.withColumn("status", F.when(F.col("mean_value").isNull(), "skipped_no_baseline")
                     .when(few, "skipped_few_samples").otherwise("evaluated"))
    z = F.when(F.col("status") == "evaluated", S.signed_z("value", "mean_value", "std_deviation"))
    return (s.withColumn("signed_z", S.as_z(z))
             .withColumn("z_score", S.as_z(F.abs(z)))
             .withColumn("is_anomaly", F.coalesce(S.is_anomaly(z, threshold, inclusive), F.lit(False)))
             .withColumn("severity_band", S.severity_band(z)))


def breach_counts(scored: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How many scored buckets breach, per key (several metrics at once)."""
    return scored.groupBy(*keys).agg(F.count(F.lit(1)).alias("buckets"),
                                     F.sum(F.col("is_anomaly").cast("int")).cast("long").alias("breaches"))


def expected_bucket(as_of, grain: str) -> _dt.datetime:
    """Start of the last complete bucket before ``as_of``."""
    t = to_datetime(as_of)
    if grain == "hour":
        return t.replace(minute=0, second=0, microsecond=0) - _dt.timedelta(hours=1)
    return _dt.datetime(t.year, t.month, t.day) - _dt.timedelta(days=1)


def deviation_table(series: DataFrame, keys: Sequence[str] = ("metric_name",),
                    threshold: float | Column = DEFAULT_Z_THRESHOLD, as_of=None, grain: str = "day",
                    missing_is_zero: bool = False) -> DataFrame:
    """Per metric: the current bucket's value against the baseline of all
    earlier buckets (mean +- k sd, z), in one aggregation.

    With ``as_of`` the current bucket is the last complete one before it: a
    feed that delivered nothing then has status ``skipped_no_data`` (or counts
    as zero with ``missing_is_zero``), it isn't scored on an old bucket.
    Without ``as_of`` the newest bucket of each key is meant, whenever it was.
    ``status`` is also ``skipped_no_baseline`` where no earlier bucket exists."""
    if as_of is None:
        w = Window.partitionBy(*keys)
        s = series.withColumn("_cur", F.col("bucket") == F.max("bucket").over(w))
        current = F.max("bucket")
    else:
        at = F.lit(expected_bucket(as_of, grain)).cast("timestamp_ntz")
        at = at.cast("date") if grain == "day" else at
        s = series.filter(F.col("bucket") <= at).withColumn("_cur", F.col("bucket") == at)
        current = at
    hist = F.when(~F.col("_cur"), F.col("value"))
    found = F.max(F.when(F.col("_cur"), F.col("value")))
    if missing_is_zero:
        found = F.coalesce(found, F.lit(0.0))
    agg = s.groupBy(*keys).agg(
        current.alias("current_bucket"),
        found.alias("current_value"),
        S.as_stat(F.avg(hist)).alias("mean_value"),
        S.as_stat(F.coalesce(F.stddev_samp(hist), F.when(F.count(hist) > 0, F.lit(0.0)))).alias("std_deviation"),
        F.count(hist).cast("int").alias("sample_size"))
    status = (F.when(F.col("current_value").isNull(), "skipped_no_data")
              .when(F.col("sample_size") == 0, "skipped_no_baseline").otherwise("evaluated"))
    z = S.signed_z("current_value", "mean_value", "std_deviation")
    return agg.select(
        *keys, "current_bucket", S.as_stat("current_value").alias("current_value"),
        "mean_value", "std_deviation", "sample_size",
        S.as_stat(S.expected_low("mean_value", "std_deviation", threshold)).alias("expected_low"),
        S.as_stat(S.threshold_value("mean_value", "std_deviation", threshold)).alias("expected_high"),
        S.as_z(z).alias("signed_z"),
        F.coalesce(S.is_anomaly(z, threshold), F.lit(False)).alias("is_anomaly"),
        S.severity_band(z).alias("severity_band"), status.alias("status"))


def z_trajectory(series: DataFrame, ref_start, ref_end, keys: Sequence[str] = ("metric_name",),
                 threshold: float = DEFAULT_Z_THRESHOLD) -> DataFrame:
    """z of every bucket against a FIXED baseline taken from the reference
    period ``[ref_start, ref_end)`` (a gradual decline shows as a growing |z|)."""
    lo, hi = to_datetime(ref_start), to_datetime(ref_end)
    b = F.col("bucket").cast("timestamp_ntz")
    in_ref = (b >= F.lit(lo).cast("timestamp_ntz")) & (b < F.lit(hi).cast("timestamp_ntz"))
    ref_v = F.when(in_ref, F.col("value"))
    w = Window.partitionBy(*keys)
    s = (series.withColumn("mean_value", S.as_stat(F.avg(ref_v).over(w)))
               .withColumn("std_deviation", S.as_stat(F.coalesce(F.stddev_samp(ref_v).over(w), F.lit(0.0)))))
    z = S.signed_z("value", "mean_value", "std_deviation")
    return (s.withColumn("signed_z", S.as_z(z))
             .withColumn("is_anomaly", F.coalesce(S.is_anomaly(z, threshold), F.lit(False)))
             .withColumn("severity_band", S.severity_band(z)))


def previous_in_sequence(df: DataFrame, keys: Sequence[str], time_col: str, order_cols: Sequence[str] = (),
                         partitions: int | None = None) -> DataFrame:
    """Adds ``prev_ts``: the time of the previous row of the same key in
    (time, order_cols) order.

    Skew-safe: a plain ``lag`` over ``partitionBy(key)`` would sort a hot key
    in one task.  Rows are range-partitioned by (key, time) - one shuffle whose
    splits follow the data - and looked at in windows of (partition, key),
    where nothing more is moved.  The first row of a (partition, key) takes the
    last time of the key's partition before it, from a table with one row for
    each; partitions are numbered in time order within a key.
    """
    d = stage(_in_time_ranges(df, keys, time_col, order_cols, partitions))
    w_in = Window.partitionBy("_part", *keys).orderBy(time_col, *order_cols, "_tie")
    d = d.withColumn("_prev_in", F.lag(time_col).over(w_in))
    edges = d.groupBy("_part", *keys).agg(F.max(time_col).alias("_last"))
    w_s = Window.partitionBy(*keys).orderBy("_part")
    edges = edges.select(F.col("_part").alias("_e_part"), *[F.col(k).alias(f"_e_{k}") for k in keys],
                         F.lag("_last").over(w_s).alias("_prev_part"))
    same = F.col("_part") == F.col("_e_part")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_e_{k}"))
    out = d.join(edges, same, "left")
    return (out.withColumn("prev_ts", F.coalesce(F.col("_prev_in"), F.col("_prev_part")))
               .select(*df.columns, "prev_ts"))


def interarrival_gaps(df: DataFrame, keys: Sequence[str], time_col: str, partitions: int | None = None) -> DataFrame:
    """Inter-arrival gap (minutes) of every row after the first of its key."""
    p = previous_in_sequence(df.select(*keys, time_col), keys, time_col, partitions=partitions)
    return (p.filter(F.col("prev_ts").isNotNull())
             .withColumn("gap_minutes", S.minutes_between("prev_ts", time_col)))


def interarrival_freshness(df: DataFrame, keys: Sequence[str], time_col: str, as_of,
                           threshold: float = DEFAULT_Z_THRESHOLD, partitions: int | None = None) -> DataFrame:
    """Freshness as a z-score: the current silence (as_of - last record)
    against the distribution of past inter-arrival gaps of the same key.

    One read of the (key, time) columns and no join: rows are range-partitioned
    by (key, time); each (partition, key) is reduced to its first and last time
    and the mergeable state (count, mean, M2) and maximum of its gaps; a ``lag``
    over that small table adds the gaps between partitions."""
    d = _in_time_ranges(df.select(*keys, time_col).filter(F.col(time_col).isNotNull()), keys, time_col, (), partitions)
    w_in = Window.partitionBy("_part", *keys).orderBy(time_col)
    gap = S.minutes_between(F.lag(time_col).over(w_in), time_col)
    d = d.withColumn("_gap", gap)
    part = d.groupBy("_part", *keys).agg(
        F.min(time_col).alias("first"), F.max(time_col).alias("last"), M.state_of(F.col("_gap")).alias("s"), F.max("_gap").alias("m"))
    # ranges of a key follow each other in time
    before = F.lag("last").over(Window.partitionBy(*keys).orderBy("first", "last"))
    part = part.withColumn("_edge", S.minutes_between(before, "first"))
    one = F.struct(F.lit(1).cast("bigint").alias("n"), F.col("_edge").alias("mean"), F.lit(0.0).alias("m2"))
    part = part.withColumn("s", F.when(F.col("_edge").isNull(), F.col("s")).otherwise(M.merged(F.col("s"), one)))
    # a key's ranges, at most as many as there are partitions, merged in time order
    g = part.groupBy(*keys).agg(F.max("last").alias("latest_timestamp"), M.merge_states("s", "first").alias("s"),
                                F.max(F.greatest(F.col("m"), F.col("_edge"))).alias("m"))
    s = F.col("s")
    j = g.select(*keys, "latest_timestamp", s["n"].cast("long").alias("n_gaps"), S.as_stat(M.mean_of(s)).alias("mean_gap_minutes"),
                 S.as_stat(M.stddev_of(s)).alias("std_gap_minutes"), S.as_stat("m").alias("max_gap_minutes"))
    cur = S.minutes_between("latest_timestamp", _lit_ts(as_of))
    z = S.signed_z(cur, "mean_gap_minutes", "std_gap_minutes")
    return j.select(*keys, "latest_timestamp", "n_gaps", "mean_gap_minutes", "std_gap_minutes", "max_gap_minutes",
                    S.as_stat(cur).alias("current_gap_minutes"),
                    S.as_z(z).alias("z_score"),
                    F.coalesce(S.is_anomaly(z, threshold), F.lit(False)).alias("is_anomaly"))


def detection_checks(volume: DataFrame | None = None, freshness: DataFrame | None = None) -> DataFrame:
    """Uniform one-row-per-check view of volume and freshness results."""
    parts = []
    if volume is not None:
        parts.append(volume.select(
            F.lit("volume").alias("check_type"), "source_table", F.col("metric_name").alias("check_key"),
            F.col("current_count").cast("double").alias("metric_value"),
            F.col("threshold_value").cast("double").alias("threshold_value"),
            F.col("z_score").cast("double").alias("z_score"), "is_anomaly", "status"))
    if freshness is not None:
        key = [c for c in freshness.columns if c not in _FRESH_COLS]
        parts.append(freshness.select(
            F.lit("freshness").alias("check_type"), "source_table",
            (F.concat_ws("|", *[F.col(k).cast("string") for k in key]) if key else F.lit("table")).alias("check_key"),
            F.col("minutes_since_last").cast("double").alias("metric_value"),
            F.col("threshold_minutes").cast("double").alias("threshold_value"),
            F.lit(None).cast("double").alias("z_score"),
            F.col("is_stale").alias("is_anomaly"), "status"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_FRESH_COLS = {"source_table", "latest_timestamp", "as_of", "minutes_since_last", "threshold_minutes", "is_stale",
               "staleness_factor", "impact_level", "status", "description"}


def detection_summary(checks: DataFrame) -> DataFrame:
    """Flags and totals of one detection run (one row)."""
    return checks.agg(
        F.sum(F.when((F.col("check_type") == "volume") & F.col("is_anomaly"), 1).otherwise(0)).cast("int")
         .alias("volume_anomalies"),
        F.sum(F.when((F.col("check_type") == "freshness") & F.col("is_anomaly"), 1).otherwise(0)).cast("int")
         .alias("freshness_anomalies"),
        F.sum(F.col("is_anomaly").cast("int")).cast("int").alias("total_anomalies"),
        F.sum(F.when(F.col("status") == "evaluated", 1).otherwise(0)).cast("int").alias("checks_evaluated"),
        F.sum(F.when(F.col("status") != "evaluated", 1).otherwise(0)).cast("int").alias("checks_skipped"))
