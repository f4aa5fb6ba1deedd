"""Which fields of which types JSON records have, at any depth, and how that changes.

``path_types`` reduces records to one row per path and type with counts.  Records
are opened level by level by the variant generator: a level's scalars are counted
on the map side, its objects and arrays are opened further, until none
is left.  Array elements share the path ``[*]``; a key that is no plain word is quoted.  The counts of any parts of a log
add up (``merge_types``), so those of a day are stored and never recounted;
``type_drift`` compares two of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relmon.operators.sequence import stage


# Keys that stand behind a dot; others are quoted, so that no two places share a path.
PLAIN_KEY = "^[A-Za-z_][A-Za-z0-9_]*$"


def type_name(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, DECIMAL, DOUBLE, BOOLEAN, VOID ... of a variant."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)


def path_types(records: DataFrame, record_col: str = "record", max_depth: int = 64) -> DataFrame:
    """path, type, occurrences, records (documents with that path and type).

    The record itself has the path ``$``.  A null record (text that did not
    parse) is not counted.  What lies deeper than ``max_depth`` is counted as its
    OBJECT or ARRAY only."""
    spark = records.sparkSession
    cur = records.filter(F.col(record_col).isNotNull()).select(
        F.monotonically_increasing_id().alias("rid"), F.lit("$").alias("path"), F.col(record_col).alias("v"))
    out = None
    for depth in range(max_depth + 1):
        typed = cur.select("rid", "path", "v", type_name(F.col("v")).alias("type"))
        # nested values only are written on; scalars end in the counts
        level = stage(typed.select("rid", "path", "type", F.when(F.col("type").isin("OBJECT", "ARRAY"), F.to_json("v")).alias("json")), "json-level")
        once = level.groupBy("path", "type", "rid").agg(F.count(F.lit(1)).alias("c"))
        counts = once.groupBy("path", "type").agg(F.sum("c").alias("occurrences"), F.count(F.lit(1)).alias("records"))
        out = counts if out is None else out.unionByName(counts)
        nested = level.filter(F.col("json").isNotNull())
        if depth == max_depth or not nested.limit(1).count():
            break
        opened = nested.select("rid", "path", "type", F.parse_json("json").alias("v")).lateralJoin(
            spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("_key"), F.col("value").alias("_value")))
        step = (F.when(F.col("type") == "ARRAY", F.lit("[*]")).when(F.col("_key").rlike(PLAIN_KEY), F.concat(F.lit("."), F.col("_key")))
                .otherwise(F.concat(F.lit("['"), F.replace(F.col("_key"), F.lit("'"), F.lit("\\'")), F.lit("']"))))
        cur = opened.select("rid", F.concat("path", step).alias("path"), F.col("_value").alias("v"))
    return out


def merge_types(*parts: DataFrame) -> DataFrame:
    """The counts of several disjoint sets of records together."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("path", "type").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def type_drift(old: DataFrame, new: DataFrame, min_change: float = 0.0) -> DataFrame:
    """path, type, old_share, new_share (of the records), change: ``NEW_FIELD``,
    ``LOST_FIELD``, ``NEW_TYPE``, ``LOST_TYPE`` or ``SHARE``; rows whose share
    changed by more than ``min_change`` only."""
    def shares(df: DataFrame, tag: str) -> DataFrame:
        total = df.filter("path = '$'").agg(F.sum("records")).scalar()
        paths = df.groupBy("path").agg(F.sum("records").alias(f"_{tag}_path"))
        return df.join(paths, "path").select("path", "type", (F.col("records") / total).alias(f"{tag}_share"), f"_{tag}_path")
    j = shares(old, "old").join(shares(new, "new").withColumnRenamed("path", "p2").withColumnRenamed("type", "t2"),
                                (F.col("path") == F.col("p2")) & (F.col("type") == F.col("t2")), "full")
    path, typ = F.coalesce("path", "p2"), F.coalesce("type", "t2")
    known_old = old.select(F.col("path").alias("_po")).distinct()
    known_new = new.select(F.col("path").alias("_pn")).distinct()
    j = j.select(path.alias("path"), typ.alias("type"), F.coalesce("old_share", F.lit(0.0)).alias("old_share"),
                 F.coalesce("new_share", F.lit(0.0)).alias("new_share"))
    j = j.join(known_old, F.col("path") == F.col("_po"), "left").join(known_new, F.col("path") == F.col("_pn"), "left")
    change = (F.when(F.col("_po").isNull(), "NEW_FIELD").when(F.col("_pn").isNull(), "LOST_FIELD")
              .when(F.col("old_share") == 0, "NEW_TYPE").when(F.col("new_share") == 0, "LOST_TYPE").otherwise("SHARE"))
    return j.select("path", "type", "old_share", "new_share", change.alias("change")).filter(
        F.abs(F.col("new_share") - F.col("old_share")) > F.lit(float(min_change)))
