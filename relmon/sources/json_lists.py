"""Large JSON list files, read by many tasks.

A file that holds one list of objects can't be cut at line ends.  Here it is read
in segments that end at a closing brace - any byte range of the file can find
those - and each segment is reduced to what it does to a parser: how many quotes
it has (whether it leaves a string open), and how it changes the depth of nesting,
once for a start outside and once for a start inside of a string.  These
effects compose, so the state at every segment is a running total: within a
byte range, and over one row for each range of a file.  A segment that brings the
depth back to that of the list's elements ends a record.

Files that hold objects one after another (one, or lines of them) are read as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relmon.operators.sequence import stage
from relmon.sources.logs import _finish, path_exists

# Patterns: an escaped character; a string, or one that is still open.
ESCAPED = r"(?s)\\."
STRING = '"[^"]*(?:"|$)'


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _effect(segment: Column) -> list[Column]:
    """q: quotes; d0, d1: change of the depth up to and with the closing brace
    behind the segment, for a start outside and inside of a string."""
    t = F.regexp_replace(segment, ESCAPED, "")
    q = _count(t, '"')
    behind = F.when(q > 0, F.substring_index(F.concat(t, F.lit('"')), '"', 1))
    rest = F.when(q > 0, F.substring(t, F.length(behind) + 2, F.length(t))).otherwise(F.lit(""))

    def depth(x: Column) -> Column:
        bare = F.regexp_replace(x, STRING, "")
        return _count(bare, "{[") - _count(bare, "}]")
    odd = q % 2
    return [q.cast("long").alias("q"), (depth(t) - (1 - odd)).cast("long").alias("d0"), (depth(rest) - odd).cast("long").alias("d1")]


def _before(df: DataFrame, value: str, to: str) -> DataFrame:
    """Adds the sum of ``value`` over all earlier segments of the file: within the
    byte range, and over the ranges before it from one row for each."""
    ranges = df.groupBy("source_file", "block").agg(F.sum(value).alias("_s"))
    w = Window.partitionBy("source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("source_file", "block", F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_base"))
    own = Window.partitionBy("source_file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0)))
    return d.join(ranges, ["source_file", "block"]).withColumn(to, F.col("_base") + F.col("_own")).drop("_base", "_own")


def read_json_lists(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """(source_file, record_index, raw, record, record_keys, parse_error): one row for
    each object of the files' lists, numbered in file order.

    Elements that are no objects have no row of their own and make the record behind them a parse
    error; so does what is left of a file that ends within a record.  An empty
    folder, file or list gives no rows."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], "source_file string, record_index long, raw string, record variant, record_keys array<string>, parse_error boolean")
    txt = spark.read.option("pathGlobFilter", pattern).option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"), F.col("value").alias("s"))
    text = stage(txt, "json-segments")
    seg = text.select("source_file", "block", "seq", *_effect(F.col("s")))
    first = text.groupBy("source_file").agg(F.min_by("s", F.struct("block", "seq")).alias("_f"))
    lists = first.select("source_file", F.when(F.ltrim(F.regexp_replace("_f", "^\\s+", "")).startswith("["), 1).otherwise(0).alias("base"))
    seg = _before(seg, "q", "quotes")
    inside = F.col("quotes") % 2
    seg = stage(seg.select("source_file", "block", "seq", ((inside + F.col("q")) % 2).alias("open"),
                           F.when(inside == 1, F.col("d1")).otherwise(F.col("d0")).alias("d")), "json-depths")
    seg = _before(seg, "d", "depth").join(lists, "source_file")
    seg = seg.withColumn("ends", ((F.col("depth") + F.col("d") == F.col("base")) & (F.col("open") == 0)).cast("long"))
    seg = _before(stage(seg.select("source_file", "block", "seq", "ends"), "json-ends"), "ends", "record_index")
    j = text.join(seg, ["source_file", "block", "seq"])
    g = j.groupBy("source_file", "record_index").agg(
        F.array_sort(F.collect_list(F.struct("block", "seq", "s"))).alias("p"), F.max("ends").alias("ended"))
    raw = F.concat(F.array_join(F.transform("p", lambda x: x["s"]), "}"), F.when(F.col("ended") == 1, F.lit("}")).otherwise(F.lit("")))
    raw = F.regexp_replace(raw, F.when(F.col("record_index") == 0, F.lit(r"^\s*\[?\s*")).otherwise(F.lit(r"^[\s,]+")), F.lit(""))
    g = g.select("source_file", F.col("record_index").cast("long").alias("record_index"), raw.alias("raw"), "ended")
    # behind the last record a list has its end, and a file nothing
    return _finish(g.filter((F.col("ended") == 1) | ~F.col("raw").rlike(r"^[\s\]]*$")).drop("ended"))
