"""Chained cool-down with exponential back-off for repeated alerts.

An alert of a key is let through, then the key is silent for a wait; the first
alert at or after its end is let through again and the next wait is longer, up
to a highest level.  Whoever has been quiet for ``reset_minutes`` starts at the
shortest wait again.  Which alerts pass is a chain: each depends on the one that
passed before it.

The chain isn't walked.  A node is (alert time, level); its successor depends on
the node alone and is found for all nodes at once by a forward as-of join of
(time + wait of the level) with the alert times.  The nodes on the chain
of a key's first alert are then marked by pointer jumping: the marked set and
the pointers are both doubled in length each round, so a chain of n alerts
takes log2(n) rounds of equi-joins on (key, time, level), keys that no group of
alerts can make hot; a noisy key is spread like any other rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmon.operators.sequence import asof_join, stage


def _wait(level: Column, base_minutes: float, factor: float) -> Column:
    """Length of the wait of a level, in whole microseconds."""
    return F.round(F.lit(base_minutes * 6.0e7) * F.pow(F.lit(float(factor)), level)).cast("long")


def _plus(ts: Column, micros: Column) -> Column:
    return F.timestamp_add("MICROSECOND", micros, ts)


def next_allowed(points: DataFrame, keys: Sequence[str], ts_col: str, base_minutes: float, factor: float, max_level: int,
                 reset_minutes: float, partitions: int | None = None) -> DataFrame:
    """keys, t, level, next_t, next_level of every node that has a successor."""
    nodes = points.select(*keys, F.col(ts_col).alias("t"), F.explode(F.sequence(F.lit(0), F.lit(int(max_level)))).alias("level"))
    nodes = nodes.withColumn("free", _plus(F.col("t"), _wait(F.col("level"), base_minutes, factor)))
    to = asof_join(nodes, points.select(*keys, F.col(ts_col).alias("next_t")), keys, "free", "next_t", [],
                   direction="forward", partitions=partitions)
    quiet = F.timestamp_diff("MICROSECOND", F.col("t"), F.col("next_t")) >= F.lit(int(round(reset_minutes * 6.0e7))).cast("long")
    return to.filter(F.col("next_t").isNotNull()).select(
        *keys, "t", "level", "next_t",
        F.when(quiet, 0).otherwise(F.least(F.col("level") + 1, F.lit(int(max_level)))).alias("next_level"))


def chain(first: DataFrame, jumps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All nodes (keys, t, level) reachable from ``first`` along ``jumps``, by
    doubling.  Stops when no marked node can jump any further."""
    marked = stage(first.select(*keys, "t", "level"), "chain")
    node = [*keys, "t", "level"]
    # the round's length is in the marked set: every round marks what lies a power of two further
    while True:
        step = stage(marked.join(jumps, node).select(*keys, F.col("next_t").alias("t"), F.col("next_level").alias("level")), "chain")
        if not step.limit(1).count():
            return marked
        marked = marked.unionByName(step)
        on = jumps.select(*keys, F.col("t").alias("next_t"), F.col("level").alias("next_level"),
                          F.col("next_t").alias("_t2"), F.col("next_level").alias("_l2"))
        jumps = stage(jumps.join(on, [*keys, "next_t", "next_level"])
                           .select(*node, F.col("_t2").alias("next_t"), F.col("_l2").alias("next_level")), "jumps")


def backoff(alerts: DataFrame, base_minutes: float, factor: float = 2.0, max_level: int = 4, reset_minutes: float | None = None,
            key: Sequence[str] = ("alert_type", "source_table"), ts_col: str = "alert_timestamp",
            order_cols: Sequence[str] = (), partitions: int | None = None) -> DataFrame:
    """The alerts that pass, with ``backoff_level`` and ``wait_minutes`` (the
    silence that follows each).

    Waits are base_minutes * factor^level, the level rising by one with each
    alert that passes up to ``max_level``; after ``reset_minutes`` since the last
    one that passed (default: twice the longest wait) it is zero again.  Of alerts
    of a key at one time only the first by ``order_cols`` (then by the other
    columns) can pass.  An alert without a time has no place in the chain and
    passes.  Null key parts are equal to each other."""
    longest = base_minutes * factor ** max_level
    reset = 2 * longest if reset_minutes is None else reset_minutes
    if base_minutes <= 0 or factor < 1 or max_level < 0 or reset < 0:
        raise ValueError("waits must be positive and must not shrink")
    ks = [f"_k{i}" for i in range(len(key))]
    # null-safe: a null key part is replaced by a flag and an empty value (joins match known keys only)
    rows = alerts
    parts = [F.struct(F.col(k).isNull().alias("n"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("v")) for k in key]
    rest = [c for c in alerts.columns if c != ts_col]
    order = F.struct(*[F.col(c) for c in (*order_cols, *[c for c in rest if c not in order_cols])])
    timed = rows.filter(F.col(ts_col).isNotNull())
    # alerts of one key and time are one point, reduced on the map side
    points = stage(timed.groupBy(*[p.alias(k) for p, k in zip(parts, ks)], F.col(ts_col).alias("_t"))
                        .agg(F.min(order).alias("_row")), "alert-points")
    narrow = points.select(*ks, "_t")
    jumps = stage(next_allowed(narrow, ks, "_t", base_minutes, factor, max_level, reset, partitions), "jumps")
    first = narrow.groupBy(*ks).agg(F.min("_t").alias("t")).withColumn("level", F.lit(0))
    kept = chain(first, jumps, ks).withColumnRenamed("t", "_t")
    level = F.col("level").cast("int")
    cols = [F.col("_t").alias(c) if c == ts_col else F.col(f"_row.{c}").alias(c) for c in alerts.columns]
    out = points.join(kept, [*ks, "_t"]).select(
        *cols, level.alias("backoff_level"), (F.lit(float(base_minutes)) * F.pow(F.lit(float(factor)), level)).alias("wait_minutes"))
    untimed = rows.filter(F.col(ts_col).isNull()).select(
        *alerts.columns, F.lit(0).alias("backoff_level"), F.lit(float(base_minutes)).alias("wait_minutes"))
    return out.unionByName(untimed)
