"""Readers for monitored records: JSON log directories, CSV metric series,
typed tables turned into records, newest-n samples.

JSON logs come in two layouts:

* ``document``: a file holds one JSON object or a list of objects (read with
  ``wholetext``; one file is one task, fine for log-sized files);
* ``lines``: JSON Lines, split by Spark like any text file (the layout to use
  at scale).

Each record keeps its raw text so that its keys can be listed in source order
(``json_object_keys``), its parsed ``VARIANT`` value, the file it came from and
its index in the file.  A file or line that does not parse becomes one row
with ``parse_error = true`` and a NULL record: it is counted, not dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD_COLS = ("source_file", "record_index", "raw", "record", "record_keys", "parse_error")


def _finish(df: DataFrame) -> DataFrame:
    # a text that parses is an object if it begins with a brace: its schema needn't be written out.  Behind a generator,
    # so that a filter on parse_error isn't moved below it, where each text would be parsed once more
    brace = F.ltrim(F.col("raw"), F.lit(" \t\r\n")).startswith("{")
    df = df.select("source_file", "record_index", "raw",
                   F.inline(F.array(F.struct(F.when(brace, F.try_parse_json("raw")).alias("record")))))
    ok = F.col("record").isNotNull()
    return df.select("source_file", "record_index", "raw", "record",
                     F.when(ok, F.json_object_keys(F.col("raw"))).alias("record_keys"), (~ok).alias("parse_error"))


def list_files(spark: SparkSession, path: str, pattern: str = "*.json") -> list[str]:
    """File names of a directory (metadata only, sorted).  A path that does
    not exist is an empty source; any other error is raised."""
    if not path_exists(spark, path):
        return []
    return sorted(spark.read.format("text").option("pathGlobFilter", pattern).load(path).inputFiles())


def path_exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_json_logs(spark: SparkSession, path: str, layout: str = "document", first_files: int | None = None,
                   pattern: str = "*.json") -> DataFrame:
    """JSON records of a directory as (source_file, record_index, raw, record,
    record_keys, parse_error).  ``first_files`` keeps the first n files in
    file-name order (a deterministic form of "the first n files")."""
    if first_files is not None:
        files = list_files(spark, path, pattern)[:first_files]
    else:
        # no listing into Python: the reader gets the directory itself
        files = [path] if path_exists(spark, path) else []
    reader = spark.read.option("pathGlobFilter", pattern)
    if not files:
        return spark.createDataFrame([], "source_file string, record_index long, raw string, record variant, "
                                         "record_keys array<string>, parse_error boolean")
    if layout == "lines":
        txt = reader.text(files).select(F.col("_metadata.file_path").alias("source_file"),
                                            F.col("value").alias("raw"))
        txt = txt.filter(F.length(F.trim("raw")) > 0)
        # a line's position: monotonically increasing id is unique per file split
        txt = txt.withColumn("record_index", F.monotonically_increasing_id())
        return _finish(txt)
    doc = reader.text(files, wholetext=True).select(
        F.col("_metadata.file_path").alias("source_file"), F.trim(F.col("value")).alias("txt"))
    elems = (F.when(F.col("txt").startswith("["), F.from_json(F.col("txt"), "array<string>"))
              .otherwise(F.array(F.col("txt"))))
    exploded = doc.select("source_file", F.posexplode_outer(elems).alias("record_index", "raw"))
    # a broken list file parses to NULL: keep one parse_error row for it
    exploded = exploded.withColumn("record_index", F.coalesce("record_index", F.lit(0)).cast("long"))
    return _finish(exploded)


def load_metric_csv(spark: SparkSession, path: str, date_col: str = "order_date") -> DataFrame:
    """Daily metric CSV (``order_date,daily_orders,daily_revenue,avg_order_value``)
    as a long-format series (metric_name, bucket DATE, value DOUBLE)."""
    schema = f"{date_col} date, daily_orders int, daily_revenue decimal(12,2), avg_order_value decimal(10,2)"
    wide = spark.read.schema(schema).option("header", True).csv(path)
    metrics = ["daily_orders", "daily_revenue", "avg_order_value"]
    wide = wide.select(F.col(date_col).alias("bucket"), *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(["bucket"], metrics, "metric_name", "value").select("metric_name", "bucket", "value")


def iso_text(ts) -> Column:
    """ISO text as a DB client's ``isoformat`` gives it: six digits of
    fraction where there is one, none where there isn't."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(F.date_format(ts, "SSSSSS") == "000000", whole).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))


def table_records(df: DataFrame, columns: list[str], id_cols: list[str] | None = None) -> DataFrame:
    """Typed rows -> variant records (the DB path of contract validation):
    timestamps become ISO strings first, as a DB client would hand them over;
    the record's keys are the projected columns in projection order."""
    from pyspark.sql import types as T
    conv = []
    for c in columns:
        dt = df.schema[c].dataType
        if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            conv.append(iso_text(F.col(c)).alias(c))
        elif isinstance(dt, T.DateType):
            conv.append(F.date_format(F.col(c), "yyyy-MM-dd").alias(c))
        else:
            conv.append(F.col(c))
    rec = F.to_variant_object(F.struct(*conv))
    keep = [F.col(c) for c in (id_cols or [])]
    return df.select(*keep, rec.alias("record"), F.array(*[F.lit(c) for c in columns]).alias("record_keys"))


def newest(df: DataFrame, time_col: str, n: int | None, tie_break: list[str] | None = None) -> DataFrame:
    """Newest ``n`` rows by time (ties broken by ``tie_break``, descending).
    Spark plans this as TakeOrderedAndProject: a per-partition top-n, then a
    merge of n rows per partition; never a full sort.  ``n=None`` keeps the
    whole table."""
    order = [F.col(time_col).desc()] + [F.col(c).desc() for c in (tie_break or [])]
    return df.orderBy(*order).limit(n) if n else df


def sample_records(df: DataFrame, method: str, n: int | None, time_col: str | None = None,
                   order_cols: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Contract sampling: ``latest`` (newest n), ``sequential`` (first n in
    key order) or ``random`` (n rows by a seeded hash order).  All are top-n
    plans; ``n=None`` validates the whole table."""
    if not n:
        return df
    if method == "latest":
        return newest(df, time_col, n, order_cols)
    if method == "sequential":
        return df.orderBy(*(order_cols or [])).limit(n)
    if method == "random":
        key = F.xxhash64(*(order_cols or df.columns), F.lit(seed))
        return df.orderBy(key).limit(n)
    raise ValueError(f"unknown sampling method {method}")
