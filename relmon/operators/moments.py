"""Mergeable baseline states.

A state is (n, mean, M2) of the values of one key in one day (or other bucket),
M2 being the sum of squared deviations from the mean.  States of several days
merge into the state of all their values without looking at a value again
(Chan, Golub and LeVeque's rule, which doesn't subtract large sums of
squares from each other), so a baseline over a sliding window is kept up by
profiling the new day only: the days that fall out are left out of the merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmon.functions import stats as S
from relmon.operators.profile import to_datetime

STATE = "struct<n:bigint,mean:double,m2:double>"


def state_of(value: Column) -> Column:
    """Aggregate: the state of the known values of a group."""
    n = F.count(value)
    v = value.cast("double")
    return F.struct(n.alias("n"), F.coalesce(F.avg(v), F.lit(0.0)).alias("mean"),
                    F.coalesce(F.var_pop(v) * n, F.lit(0.0)).alias("m2"))


def merged(a: Column, b: Column) -> Column:
    """The state of both groups of values."""
    n = a["n"] + b["n"]
    d = b["mean"] - a["mean"]
    share = b["n"].cast("double") / n
    both = F.struct(n.alias("n"), (a["mean"] + d * share).alias("mean"), (a["m2"] + b["m2"] + d * d * a["n"] * share).alias("m2"))
    return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)


def merge_states(state: str, order: str) -> Column:
    """Aggregate: the merged state of a group of states, in a fixed order (equal
    results for any partitioning).  The group is a window of days of one
    key, at most as many rows as the window is long."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(state).alias("s"))))
    none = F.lit(None).cast(STATE)
    zero = F.coalesce(none, F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2")))
    return F.aggregate(rows, zero, lambda acc, x: merged(acc, x["s"]))


def mean_of(state: Column) -> Column:
    return F.when(state["n"] > 0, state["mean"])


def stddev_of(state: Column) -> Column:
    """Sample standard deviation; 0 for one value, null for none."""
    return F.when(state["n"] > 1, F.sqrt(F.greatest(state["m2"], F.lit(0.0)) / (state["n"] - 1))).when(state["n"] == 1, F.lit(0.0))


def day_states(series: DataFrame, keys: Sequence[str] = ("metric_name",)) -> DataFrame:
    """keys, state_day, state: one row per key and day of a series."""
    return series.groupBy(*keys, F.to_date("bucket").alias("state_day")).agg(state_of(F.col("value")).alias("state"))


def window_baselines(states: DataFrame, as_of, window_days: int, keys: Sequence[str] = ("metric_name",)) -> DataFrame:
    """Baselines of the ``window_days`` days before the day of ``as_of`` from
    stored states (one row per key and day)."""
    hi = to_datetime(as_of).date()
    day = F.col("state_day")
    lo = F.date_sub(F.lit(hi), int(window_days))
    g = states.filter((day >= lo) & (day < F.lit(hi))).groupBy(*keys).agg(
        merge_states("state", "state_day").alias("_s"), F.count(F.lit(1)).cast("int").alias("days"))
    s = F.col("_s")
    return g.select(*keys, S.as_stat(mean_of(s)).alias("mean_value"), S.as_stat(stddev_of(s)).alias("std_deviation"),
                    s["n"].cast("int").alias("sample_size"), "days", F.lit(to_datetime(as_of)).cast("timestamp_ntz").alias("calculation_timestamp"))
