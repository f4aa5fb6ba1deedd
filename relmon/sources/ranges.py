"""Parallel reads of a database table in parts of equal size.

A JDBC read is cut by predicates, one part each.  Equal steps between the
smallest and the largest key leave parts empty where keys are missing and
overfull where they crowd; here the bounds are quantiles of the key column (one
aggregate, a sketch of bounded size a task, and one that counts on both sides of
each), so every part has about the same number of rows unless a single key value
holds more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relmon.specs import SourceSpec

ACCURACY = 100_000      # a bound is off by at most rows / ACCURACY ranks


def quantile_bounds(df: DataFrame, column: str, parts: int) -> list:
    """At most ``parts`` - 1 increasing values that cut the known values evenly: the
    rows of a quantile's value go to the side that leaves the cut nearer to its rank."""
    if parts < 2:
        return []
    probs = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(column, probs, ACCURACY)).first()[0] or []
    if not found:
        return []
    key, kind = F.col(column), df.select(column).schema[0].dataType
    sides = [F.struct(F.count(F.when(key < at, 1)).alias("below"), F.count(F.when(key <= at, 1)).alias("upto"),
                      F.min(F.when(key > at, key)).alias("next")) for at in (F.lit(v).cast(kind) for v in found)]
    n, *around = df.agg(F.count(column), *sides).first()
    # a cut behind the value that another quantile makes anyhow isn't made twice
    late = [x["next"] is not None and x["next"] not in found and x["upto"] - p * n < p * n - x["below"] for p, x in zip(probs, around)]
    return sorted({x["next"] if after else v for v, x, after in zip(found, around, late)})


def _literal(v) -> str:
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(v)
    return "'" + str(v).replace("'", "''") + "'"


def range_predicates(df: DataFrame, column: str, parts: int) -> list[str]:
    """SQL conditions that meet every row exactly once: half-open ranges between
    the bounds; rows without a value go with the first.  Fewer than ``parts`` where
    one value would span several."""
    bounds = quantile_bounds(df, column, parts)
    if not bounds:
        return ["1 = 1"]
    out = [f"{column} < {_literal(bounds[0])} OR {column} IS NULL"]
    out += [f"{column} >= {_literal(lo)} AND {column} < {_literal(hi)}" for lo, hi in zip(bounds, bounds[1:])]
    return [*out, f"{column} >= {_literal(bounds[-1])}"]


def part_counts(df: DataFrame, predicates: list[str]) -> DataFrame:
    """part, rows of each predicate; one aggregate over one read."""
    rows = df.agg(*[F.count(F.when(F.expr(p), 1)).alias(f"_p{i}") for i, p in enumerate(predicates)])
    each: list[Column] = [F.struct(F.lit(i).alias("part"), F.col(f"_p{i}").alias("rows")) for i in range(len(predicates))]
    return rows.select(F.inline(F.array(*each)))


def read_in_parts(spark: SparkSession, spec: SourceSpec, column: str, parts: int) -> DataFrame:
    """A JDBC source read by ``parts`` tasks at most.  The bounds come from two reads
    of the key column alone; for other formats this is a plain read, which Spark cuts itself."""
    if spec.fmt != "jdbc":
        return spec.read(spark)
    options = dict(spec.options)
    url, table = options.pop("url"), options.pop("dbtable")
    return spark.read.jdbc(url, table, predicates=range_predicates(spec.read(spark).select(column), column, parts), properties=options)
