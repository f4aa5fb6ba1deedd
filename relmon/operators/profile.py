"""Profiling: metric time series and statistical baselines.

Shape of every series here (long format, one row per key and bucket)::

    <key columns...>, metric_name STRING, bucket TIMESTAMP_NTZ|DATE, value DOUBLE

A series is built with ONE scan of the source: the time filter is pushed to
the parquet reader, then a single ``groupBy(keys, bucket)`` computes every
requested metric at once (map-side partial aggregation, so a hot key never
reaches one reducer un-aggregated) and ``unpivot`` turns the wide row into the
long form.  Everything after that works on the aggregated series, whose size
is (#keys x #buckets), independent of the raw row count.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmon.functions import stats as S
from relmon.specs import DEFAULT_MIN_SAMPLES, DEFAULT_Z_THRESHOLD

def _epoch_ntz() -> Column:
    return F.lit(_dt.datetime(1970, 1, 1)).cast("timestamp_ntz")


def to_datetime(x) -> _dt.datetime:
    """Driver-side as-of value (str / date / datetime) as a naive datetime."""
    if isinstance(x, _dt.datetime):
        return x.replace(tzinfo=None) if x.tzinfo is None else x.astimezone(_dt.timezone.utc).replace(tzinfo=None)
    if isinstance(x, _dt.date):
        return _dt.datetime(x.year, x.month, x.day)
    if isinstance(x, str):
        return _dt.datetime.fromisoformat(x.strip().replace("Z", ""))
    raise TypeError(f"unsupported time literal {x!r}")


def _lit_ts(x) -> Column:
    if isinstance(x, Column):
        return x
    return F.lit(to_datetime(x)).cast("timestamp_ntz")


def time_window(df: DataFrame, time_col: str, as_of=None, lookback_hours: float | None = None,
                lookback_days: int | None = None, upper_bound: bool = True) -> DataFrame:
    """Lookback filter ``ts >= as_of - lookback`` plus an explicit upper bound
    ``ts < as_of``.  Day lookbacks are counted from the as-of *date*
    (``CURRENT_DATE - n days``), so with ``upper_bound=False`` the day of
    ``as_of`` itself is included.  Bounds are computed on the driver and
    compared as literals, so they reach the parquet scan as PushedFilters."""
    if as_of is None:
        return df
    hi = to_datetime(as_of)
    ts = F.col(time_col)
    conds = []
    if lookback_hours is not None:
        conds.append(ts >= F.lit(hi - _dt.timedelta(hours=float(lookback_hours))).cast("timestamp_ntz"))
    if lookback_days is not None:
        lo = _dt.datetime(hi.year, hi.month, hi.day) - _dt.timedelta(days=int(lookback_days))
        conds.append(ts >= F.lit(lo).cast("timestamp_ntz"))
    if upper_bound:
        conds.append(ts < F.lit(hi).cast("timestamp_ntz"))
    for c in conds:
        df = df.filter(c)
    return df


def metric_series(df: DataFrame, time_col: str, grain: str = "hour", by: Sequence[str] = (),
                  metrics: dict[str, Column] | None = None, as_of=None,
                  lookback_hours: float | None = None, lookback_days: int | None = None,
                  upper_bound: bool = True, exclude_current: bool = True) -> DataFrame:
    """Time-bucketed metrics of one source in long format.

    ``metrics`` maps metric name -> aggregate Column (default: row count as
    ``row_count``).  All metrics share one scan and one aggregation.
    Empty buckets are absent (no gap filling; see :func:`fill_gaps`).
    ``exclude_current`` drops the (partial) bucket that contains ``as_of``.
    """
    metrics = metrics or {"row_count": F.count(F.lit(1))}
    src = time_window(df, time_col, as_of, lookback_hours, lookback_days, upper_bound)
    b = S.bucket(time_col, grain)
    wide = (src.groupBy(*by, b.alias("bucket"))
               .agg(*[agg.cast("double").alias(name) for name, agg in metrics.items()]))
    if exclude_current and as_of is not None:
        cur = S.bucket(_lit_ts(as_of), grain)
        wide = wide.filter(F.col("bucket") < cur)
    long = wide.unpivot(ids=[*by, "bucket"], values=list(metrics), variableColumnName="metric_name",
                        valueColumnName="value")
    return long.select(*by, "metric_name", "bucket", "value")


def fill_gaps(series: DataFrame, keys: Sequence[str], grain: str = "hour", start=None, stop=None) -> DataFrame:
    """Add zero-valued buckets for the empty ones (R4 opt-in).

    The bucket grid is generated per key from that key's first to last bucket
    (or the explicit ``start``/``stop``) with ``sequence`` + ``explode``;
    it is (#keys x #buckets) rows, the same order as the series itself.
    """
    step = F.expr("INTERVAL 1 HOUR") if grain == "hour" else F.expr("INTERVAL 1 DAY")
    k = [*keys, "metric_name"]
    rng = series.groupBy(*k).agg(F.min("bucket").alias("_lo"), F.max("bucket").alias("_hi"))
    if start is not None:
        rng = rng.withColumn("_lo", S.bucket(_lit_ts(start), grain))
    if stop is not None:
        rng = rng.withColumn("_hi", S.bucket(_lit_ts(stop), grain))
    grid = rng.select(*k, F.explode(F.sequence("_lo", "_hi", step)).alias("bucket"))
    return (grid.join(series, [*k, "bucket"], "left")
                .select(*k, "bucket", F.coalesce("value", F.lit(0.0)).alias("value")))


def baselines(series: DataFrame, keys: Sequence[str] = ("metric_name",), as_of=None,
              source_database: str | None = None, table_name: str | None = None,
              min_samples: int | None = None) -> DataFrame:
    """Mean and *sample* standard deviation (n-1; n=1 gives 0.0) per key.

    Output follows the baselines table: mean_value / std_deviation as
    DECIMAL(15,4), sample_size INT, calculation_timestamp.  Keys with no
    bucket produce no row (callers treat that as "no baseline").
    With ``min_samples`` a ``baseline_status`` column marks keys with too few
    buckets as ``insufficient`` instead of ``ok``.
    """
    agg = series.groupBy(*keys).agg(
        S.as_stat(F.avg("value")).alias("mean_value"),
        S.as_stat(F.coalesce(F.stddev_samp("value"), F.lit(0.0))).alias("std_deviation"),
        F.count(F.lit(1)).cast("int").alias("sample_size"))
    if source_database is not None and "source_database" not in keys:
        agg = agg.withColumn("source_database", F.lit(source_database))
    if table_name is not None and "table_name" not in keys:
        agg = agg.withColumn("table_name", F.lit(table_name))
    if as_of is not None:
        agg = agg.withColumn("calculation_timestamp", _lit_ts(as_of))
    if min_samples is not None:
        agg = agg.withColumn("baseline_status",
                             F.when(F.col("sample_size") < min_samples, F.lit("insufficient"))
                              .otherwise(F.lit("ok")))
    return agg


def with_season(series: DataFrame, season: str = "weekpart_hour") -> tuple[DataFrame, list[str]]:
    """The series with its seasonal key columns, and their names:
    ``weekpart_hour`` (weekday/weekend x hour of day), ``weekpart``, ``hour``
    (hour of day) or ``dow`` (day of week)."""
    s = series
    extra = []
    if season in ("weekpart_hour", "weekpart"):
        s = s.withColumn("day_class", F.when(F.dayofweek("bucket").isin(1, 7), F.lit("weekend"))
                         .otherwise(F.lit("weekday")))
        extra.append("day_class")
    if season in ("weekpart_hour", "hour"):
        s = s.withColumn("hour_of_day", F.hour("bucket"))
        extra.append("hour_of_day")
    if season == "dow":
        s = s.withColumn("day_of_week", F.dayofweek("bucket"))
        extra.append("day_of_week")
    return s, extra


def seasonal_baselines(series: DataFrame, keys: Sequence[str] = ("metric_name",),
                       season: str = "weekpart_hour", min_samples: int | None = None) -> DataFrame:
    """Baselines per key and season (see :func:`with_season`)."""
    s, extra = with_season(series, season)
    return baselines(s, [*keys, *extra], min_samples=min_samples)


def bucket_index(grain: str) -> Column:
    """Integer position of a bucket (hours or days since the epoch) so that
    value-range window frames can be expressed with ``rangeBetween``."""
    if grain == "hour":
        return F.timestamp_diff("HOUR", _epoch_ntz(), F.col("bucket"))
    return F.datediff(F.col("bucket"), F.lit(_dt.date(1970, 1, 1)))


def rolling_baselines(series: DataFrame, keys: Sequence[str] = ("metric_name",), grain: str = "hour",
                      window: int = 24, threshold: float = DEFAULT_Z_THRESHOLD) -> DataFrame:
    """Trailing baseline of each bucket: mean / sample sd of the buckets in
    ``[bucket - window, bucket - 1]`` (value range, so missing buckets simply
    do not count), then the bucket's z against it.  The window runs over the
    aggregated series partitioned by metric key, never over raw rows."""
    w = Window.partitionBy(*keys).orderBy(bucket_index(grain)).rangeBetween(-int(window), -1)
    out = (series
           .withColumn("trailing_n", F.count("value").over(w).cast("int"))
           .withColumn("trailing_mean", S.as_stat(F.avg("value").over(w)))
           .withColumn("trailing_std", S.as_stat(F.coalesce(F.stddev_samp("value").over(w),
                                                            F.when(F.count("value").over(w) > 0, F.lit(0.0))))))
    z = S.signed_z("value", "trailing_mean", "trailing_std")
    return (out.withColumn("z_score", S.as_z(z))
               .withColumn("is_anomaly", F.coalesce(S.is_anomaly(z, threshold), F.lit(False))))


def outlier_rejected_baselines(series: DataFrame, keys: Sequence[str] = ("metric_name",),
                               threshold: float = DEFAULT_Z_THRESHOLD,
                               min_samples: int = DEFAULT_MIN_SAMPLES) -> DataFrame:
    """Two-pass baseline: score every bucket against the plain baseline, drop
    buckets with abs z > threshold, re-aggregate.  Keys left with fewer than
    ``min_samples`` buckets are marked ``insufficient``.

    Both passes run on one hash partitioning by key: the first pass is a
    window aggregate, the second a groupBy on the same keys, so the series is
    shuffled once."""
    w = Window.partitionBy(*keys)
    mean1 = S.as_stat(F.avg("value").over(w))
    sd1 = S.as_stat(F.coalesce(F.stddev_samp("value").over(w), F.lit(0.0)))
    scored = series.withColumn("_z", S.abs_z("value", mean1, sd1))
    out = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("int").alias("raw_sample_size"),
        F.sum(F.when(F.col("_z") > threshold, 1).otherwise(0)).cast("int").alias("rejected"),
        S.as_stat(F.avg(F.when(F.col("_z") <= threshold, F.col("value")))).alias("mean_value"),
        S.as_stat(F.coalesce(F.stddev_samp(F.when(F.col("_z") <= threshold, F.col("value"))),
                             F.lit(0.0))).alias("std_deviation"),
        F.count(F.when(F.col("_z") <= threshold, F.lit(1))).cast("int").alias("sample_size"))
    return out.withColumn("baseline_status", F.when(F.col("sample_size") < min_samples, F.lit("insufficient"))
                          .otherwise(F.lit("ok")))


def smoothed_baselines(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("metric_name",),
                       alpha: float = 0.1) -> DataFrame:
    """Exponential smoothing of the baseline mean, one step:
    ``alpha * new + (1 - alpha) * old``.  A key without an old baseline takes
    the new one as is.  Both inputs are one row per key."""
    o = old.select(*keys, F.col("mean_value").alias("old_mean"), F.col("std_deviation").alias("old_std"))
    n = new.select(*keys, F.col("mean_value").alias("new_mean"), F.col("std_deviation").alias("new_std"),
                   "sample_size")
    j = n.join(o, list(keys), "left")
    sm = F.when(F.col("old_mean").isNull(), F.col("new_mean").cast("double")).otherwise(
        F.lit(alpha) * F.col("new_mean").cast("double") + F.lit(1.0 - alpha) * F.col("old_mean").cast("double"))
    return j.withColumn("smoothed_mean", S.as_stat(sm))


def smoothed_split(series: DataFrame, cut, keys: Sequence[str] = ("metric_name",), alpha: float = 0.1) -> DataFrame:
    """:func:`smoothed_baselines` of the buckets before ``cut`` (old) and from
    ``cut`` on (new), by conditional aggregates over one read of the series.
    Keys without a new bucket have no row."""
    at = F.lit(to_datetime(cut)).cast("timestamp_ntz")
    is_new = F.col("bucket").cast("timestamp_ntz") >= at

    def stats(tag: str, cond: Column) -> list[Column]:
        v = F.when(cond, F.col("value"))
        return [S.as_stat(F.avg(v)).alias(f"{tag}_mean"),
                S.as_stat(F.when(F.count(v) > 0, F.coalesce(F.stddev_samp(v), F.lit(0.0)))).alias(f"{tag}_std")]
    g = series.groupBy(*keys).agg(*stats("new", is_new), *stats("old", ~is_new),
                                  F.count(F.when(is_new, 1)).cast("int").alias("sample_size"))
    sm = F.when(F.col("old_mean").isNull(), F.col("new_mean").cast("double")).otherwise(
        F.lit(alpha) * F.col("new_mean").cast("double") + F.lit(1.0 - alpha) * F.col("old_mean").cast("double"))
    return g.filter(F.col("sample_size") > 0).select(*keys, "new_mean", "new_std", "sample_size", "old_mean", "old_std",
                                                     S.as_stat(sm).alias("smoothed_mean"))
