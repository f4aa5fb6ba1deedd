"""Robust baselines: medians, clipping to a fixed point, mergeable quantile sketches.

``robust_baselines`` and ``clipped_baselines`` work on the aggregated series
(#keys x #buckets rows).  Quantiles of raw values come from KLL sketches: one
of bounded size per key and day, mergeable, so that any window of stored days
answers any quantile without a look at the values; the error is one of rank and
known beforehand (``rank_error``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmon.functions import stats as S
from relmon.operators.sequence import stage

# Fixed value: scales the median absolute deviation of a normal distribution to its standard deviation.
MAD_SCALE = 1.4826
SKETCH_K = 400
MAX_ROUNDS = 100


def robust_baselines(series: DataFrame, keys: Sequence[str] = ("metric_name",)) -> DataFrame:
    """Median, median absolute deviation (and that scaled to a standard deviation)
    and sample size of each key.  Exact; two aggregates over the series."""
    known = series.filter(F.col("value").isNotNull())
    med = known.groupBy(*keys).agg(F.percentile("value", F.lit(0.5)).alias("_med"))
    j = known.join(med, list(keys))
    mad = F.percentile(F.abs(F.col("value") - F.col("_med")), F.lit(0.5))
    g = j.groupBy(*keys).agg(F.first("_med").alias("_med"), mad.alias("_mad"), F.count(F.lit(1)).cast("int").alias("sample_size"))
    return g.select(*keys, S.as_stat("_med").alias("median_value"), S.as_stat("_mad").alias("mad_value"),
                    S.as_stat(F.col("_mad") * MAD_SCALE).alias("robust_std"), "sample_size")


def clipped_baselines(series: DataFrame, keys: Sequence[str] = ("metric_name",), threshold: float = 3.0,
                      max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Mean and sample deviation after dropping, again and again, the buckets more
    than ``threshold`` deviations off, until no key drops another one: keys...,
    mean_value, std_deviation, sample_size, rejected, rounds.

    A round is one aggregate of the series against one row of bounds per key.  What
    was dropped stays dropped, so every round but the last drops a bucket and the
    loop ends; a key is settled (its ``rounds`` stop) as soon as it drops nothing.
    A key that is not after ``max_rounds`` keeps its last bounds."""
    s = stage(series.filter(F.col("value").isNotNull()).select(*keys, F.col("value").cast("double").alias("value")), "clip")
    ks = list(keys)

    def summary(df: DataFrame) -> DataFrame:
        return df.groupBy(*ks).agg(F.avg("value").alias("m"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("sd"),
                                   F.count(F.lit(1)).alias("n"))
    inf = F.lit(float("inf"))
    cur = stage(summary(s).withColumn("raw", F.col("n")).withColumn("rounds", F.lit(0)).withColumn("lo", -inf).withColumn("hi", inf), "clip-bounds")
    for _ in range(max_rounds):
        lo = F.greatest(F.col("lo"), F.col("m") - threshold * F.col("sd"))
        hi = F.least(F.col("hi"), F.col("m") + threshold * F.col("sd"))
        b = cur.select(*ks, "raw", "rounds", F.col("n").alias("_n"), lo.alias("lo"), hi.alias("hi"))
        inside = s.join(b.select(*ks, "lo", "hi"), ks).filter(F.col("value").between(F.col("lo"), F.col("hi")))
        nxt = summary(inside).join(b, ks)
        nxt = nxt.withColumn("rounds", F.col("rounds") + (F.col("n") < F.col("_n")).cast("int"))
        cur = stage(nxt, "clip-bounds")
        if not cur.filter(F.col("n") < F.col("_n")).limit(1).count():
            break
    return cur.select(*ks, S.as_stat("m").alias("mean_value"), S.as_stat("sd").alias("std_deviation"),
                      F.col("n").cast("int").alias("sample_size"), (F.col("raw") - F.col("n")).cast("int").alias("rejected"),
                      F.col("rounds").cast("int").alias("rounds"))


def rank_error(k: int = SKETCH_K) -> float:
    """Error of the rank of one quantile, as a share of the values, that a KLL
    sketch of size ``k`` keeps to with 99 % probability (published fit)."""
    return 2.296 / k ** 0.9021


def day_sketches(df: DataFrame, time_col: str, value_col: str, keys: Sequence[str], k: int = SKETCH_K) -> DataFrame:
    """keys..., state_day, sketch, n: one sketch of the known values per key and day,
    combined on the map side (a hot key is a sketch a task, a few KB)."""
    v = F.col(value_col).cast("double")
    return df.filter(v.isNotNull()).groupBy(*keys, F.to_date(time_col).alias("state_day")).agg(
        F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"))


def merged_quantiles(sketches: DataFrame, probabilities: Sequence[float], keys: Sequence[str]) -> DataFrame:
    """keys..., n, probability, quantile from all sketches of a key."""
    g = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("_s"), F.sum("n").alias("n"))
    each = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias("q")) for p in probabilities])
    return g.select(*keys, "n", F.explode(each).alias("e")).select(*keys, "n", F.col("e.p").alias("probability"), F.col("e.q").alias("quantile"))


def within_rank_error(value_share_below: Column, value_share_upto: Column, probability: Column, error: float) -> Column:
    """Whether a value whose exact ranks are given is a quantile up to ``error``."""
    return (value_share_below <= probability + error) & (value_share_upto >= probability - error)
