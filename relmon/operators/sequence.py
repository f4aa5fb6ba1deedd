"""Rows of a key in time order, without one task per key.

``in_time_ranges`` cuts all rows into ranges of (key, time) whose ends follow
the data, so a hot key lies in as many ranges as it needs.  What depends on the
order is computed within (range, key); what crosses from one range to the next is
carried over a table with one row for each (range, key).  On it are built:

* ``asof_join``: for each left row the last right row of its key not after it
  (or the first not before it);
* ``smoothed_series``: exponential smoothing of a whole series as an
  associative scan of affine maps.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relmon.functions import stats as S
from relmon.session import scratch_path


def in_time_ranges(df: DataFrame, keys: Sequence[str], time_col: str, order_cols: Sequence[str],
                   partitions: int | None) -> DataFrame:
    """Rows range-partitioned and sorted by (keys, time, order_cols), with the
    partition's number.  The ranges come from a sample of the data, so a key
    that holds most rows is cut into as many ranges as it needs, also where
    many of its rows have one time: a hash of the row is the last sort key."""
    order = [F.col(c) for c in (*keys, time_col, *order_cols)]
    d = df.withColumn("_tie", F.xxhash64(*df.columns))
    order = [*order, F.col("_tie")]
    d = d.repartitionByRange(partitions, *order) if partitions else d.repartitionByRange(*order)
    return d.withColumn("_part", F.spark_partition_id()).sortWithinPartitions("_part", *order)


def stage(df: DataFrame, name: str = "sequence") -> DataFrame:
    """The ranges are drawn from a sample, so the numbered partitions are
    written once (in the shared folder) for all that is computed on them."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- as-of join

def _all_known(cols: Sequence[Column]) -> Column:
    out = F.lit(True)
    for c in cols:
        out = out & c.isNotNull()
    return out


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
              cols: Sequence[str], direction: str = "backward", allow_exact: bool = True,
              tolerance_minutes: float | None = None, order_cols: Sequence[str] = (),
              partitions: int | None = None) -> DataFrame:
    """Every left row with ``right_time`` and ``cols`` of the right row of its key
    that is valid at its time: the last one not after it (``backward``) or the
    first one not before it (``forward``).  A left row without one has nulls.

    ``allow_exact=False`` asks for a strictly earlier (later) row;
    ``tolerance_minutes`` drops matches further away.  Of right rows with one key
    and time the greatest by ``order_cols`` (then by all ``cols``) counts.  Rows
    with a null key or time match nothing; left rows of that kind are kept.

    Plan: both sides in one sequence, range-partitioned by (key, time) and
    written once; within a (range, key) the last right value is carried along,
    the value from ranges before comes from a table with one row for each
    (range, key).  No window covers a key, no row meets more than one match.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(direction)
    got = [right_time, *cols]
    clash = set(got) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    back = direction == "backward"
    # at one time, right rows come first in the walking direction if they may match
    first, second = (0, 1) if allow_exact == back else (1, 0)

    lk = _all_known([F.col(c) for c in (*keys, left_time)])
    side = [*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]]
    r = right.filter(_all_known([F.col(c) for c in (*keys, right_time)]))
    r = (r.groupBy(*side, F.col(right_time).alias("_t"))
          .agg(F.max_by(F.struct(*[F.col(c) for c in got]), F.struct(*[F.col(c) for c in (*order_cols, *cols)] or [F.lit(1)])).alias("_r")))
    lrows = left.filter(lk).select(*side, F.col(left_time).alias("_t"), F.struct(*[F.col(f"`{c}`") for c in left.columns]).alias("_l"))
    both = lrows.withColumn("_side", F.lit(second)).unionByName(r.withColumn("_side", F.lit(first)), allowMissingColumns=True)
    ks = [f"_k{i}" for i in range(len(keys))]
    seq = stage(in_time_ranges(both, ks, "_t", ["_side"], partitions), "asof")

    def walk(*by: str) -> list[Column]:
        return [F.col(c).asc() if back else F.col(c).desc() for c in by]
    # walked backwards for ``forward``: a frame that grows from its start costs one step a row
    w = Window.partitionBy("_part", *ks).orderBy(*walk("_t", "_side", "_tie")).rowsBetween(Window.unboundedPreceding, 0)
    seen = seq.withColumn("_in", F.last("_r", ignorenulls=True).over(w)).filter(F.col("_l").isNotNull())
    edge = (F.max_by if back else F.min_by)(F.col("_r"), F.when(F.col("_r").isNotNull(), F.col("_t")))
    parts = seq.groupBy("_part", *ks).agg(edge.alias("_edge"))
    wp = Window.partitionBy(*ks).orderBy(*walk("_part")).rowsBetween(Window.unboundedPreceding, -1)
    carry = parts.select("_part", *ks, F.last("_edge", ignorenulls=True).over(wp).alias("_carry")).filter(F.col("_carry").isNotNull())
    m = seen.join(carry, ["_part", *ks], "left").withColumn("_m", F.coalesce("_in", "_carry"))
    if tolerance_minutes is not None:
        far = F.abs(S.minutes_between(F.col(f"_m.{right_time}"), F.col("_t"))) > float(tolerance_minutes)
        m = m.withColumn("_m", F.when(~far, F.col("_m")))
    out = m.select("_l.*", *[F.col(f"_m.{c}").alias(c) for c in got])
    alone = left.filter(~lk).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in got])
    return out.unionByName(alone)


# ---------------------------------------------------------------- exponential smoothing of a series

def _block_rows(alpha: float) -> int:
    """Rows of a block: (1 - alpha) to their number stays far from underflow."""
    return max(1, min(256, int(200 / -math.log10(1.0 - alpha))))


def smoothed_series(series: DataFrame, keys: Sequence[str] = ("metric_name",), time_col: str = "bucket", value_col: str = "value",
                    alpha: float = 0.1, partitions: int | None = None) -> DataFrame:
    """The series with ``smoothed_value``: s = alpha * x + (1 - alpha) * s_before
    along each key in time order, the first row's being its value.  Rows without
    a value or time are left out.

    A step is an affine map of the state before it, and such maps compose, so
    the scan is cut anywhere: blocks of at most 256 rows within a (range, key)
    become one map each, those of a key are scanned by doubling (lag 1, 2, 4 ...)
    over the table of blocks, and each row applies its block's entry state.
    The result is the same for any partitioning (to rounding of doubles)."""
    if not 0.0 < alpha <= 1.0:
        raise ValueError("alpha must be above 0 and at most 1")
    src = series.filter(F.col(value_col).isNotNull() & F.col(time_col).isNotNull())
    if alpha == 1.0:
        return src.withColumn("smoothed_value", F.col(value_col).cast("double"))
    keep, rows = 1.0 - alpha, _block_rows(alpha)
    d = stage(in_time_ranges(src, keys, time_col, (), partitions), "smoothed")
    order = [time_col, "_tie"]
    w = Window.partitionBy("_part", *keys).orderBy(*order)
    d = d.withColumn("_i", F.row_number().over(w) - 1)
    d = d.withColumn("_block", F.floor(F.col("_i") / rows).cast("int")).withColumn("_i", (F.col("_i") % rows).cast("int"))
    wb = Window.partitionBy("_part", *keys, "_block").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col(value_col).cast("double")
    # sum of alpha * x_j * keep^(i-j) over the block so far
    local = F.pow(F.lit(keep), F.col("_i")) * F.sum(F.lit(alpha) * x * F.pow(F.lit(keep), -F.col("_i"))).over(wb)
    d = d.withColumn("_local", local)
    at = ["_part", "_block"]
    blocks = d.groupBy(*at, *keys).agg(F.pow(F.lit(keep), F.count(F.lit(1))).alias("_a"), F.max_by("_local", "_i").alias("_b"),
                                       F.min_by(x, "_i").alias("_x"))
    blocks = stage(blocks, "smoothed-blocks")
    most = blocks.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    wk = Window.partitionBy(*keys).orderBy(*at)
    blocks = blocks.withColumn("_x", F.first("_x").over(wk))
    step = 1
    while step < most:
        a, b = F.lag("_a", step).over(wk), F.lag("_b", step).over(wk)
        blocks = blocks.select(*at, *keys, "_x", F.coalesce(F.col("_a") * a, F.col("_a")).alias("_a"),
                               F.coalesce(F.col("_a") * b + F.col("_b"), F.col("_b")).alias("_b"))
        step *= 2
    done = F.col("_a") * F.col("_x") + F.col("_b")      # the state behind a block
    entry = blocks.select(*at, *keys, F.coalesce(F.lag(done, 1).over(wk), F.col("_x")).alias("_entry"))
    out = d.alias("d").join(entry.alias("e"), [F.col(f"d.{c}").eqNullSafe(F.col(f"e.{c}")) for c in (*at, *keys)])
    s = F.col("_local") + F.pow(F.lit(keep), F.col("_i") + 1) * F.col("_entry")
    return out.select(*[F.col(f"d.{c}") for c in series.columns], s.alias("smoothed_value"))
