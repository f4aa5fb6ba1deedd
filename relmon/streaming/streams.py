"""Structured Streaming forms of the monitoring operators.

The batch column expressions are reused as they are; only the parts that
need state differ:

* hourly ingestion with late data: event-time watermark + tumbling window,
  append mode, so state holds only the windows still open;
* contract validation and quarantine: stateless, the same compiled contract;
* alert de-duplication across micro-batches: ``dropDuplicatesWithinWatermark``
  on a key that contains the alert day, so the result does not depend on
  where micro-batch boundaries fall;
* running freshness: ``max(ts)`` per source (state = one row per source);
* trailing totals and outages: sliding and session windows under the same
  watermark; closed windows are scored against the stored baselines;
* silent sources: timers per source (:mod:`relmon.streaming.silence`);
* sinks: ``foreachBatch`` writing each micro-batch to a directory named by
  its batch id with overwrite, so a replayed batch replaces itself
  (idempotent), then the batch operators run on the result.

Watermarks need TIMESTAMP (not TIMESTAMP_NTZ) event times, so the event
column is cast with the session time zone pinned to UTC.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmon.session import ensure_utc, scratch_path


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    """A file-source stream over a table path: a directory of part files (the
    layout on a cluster; new files become new micro-batches) or one file."""
    r = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return r.load(path)
    # the file source wants a directory: that of the file, with its name as the filter
    return r.option("pathGlobFilter", p.getName()).load(p.getParent().toString())


def kafka_stream(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    """Raw records of a Kafka topic as (raw, event_time): for the contract and
    count operators.  Needs Spark's Kafka package on the class path."""
    r = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    return r.options(**options).load().select(F.col("value").cast("string").alias("raw"),
                                              F.col("timestamp").alias("event_time"))


def event_time(df: DataFrame, ts_col: str, out_col: str = "event_time") -> DataFrame:
    ensure_utc(df.sparkSession)
    return df.withColumn(out_col, F.col(ts_col).cast("timestamp"))


def hourly_counts(stream: DataFrame, ts_col: str, by=(), watermark: str = "1 hour",
                  window: str = "1 hour") -> DataFrame:
    """Windowed row counts that tolerate data up to ``watermark`` late."""
    s = event_time(stream, ts_col).withWatermark("event_time", watermark)
    g = s.groupBy(F.window("event_time", window).alias("w"), *by).agg(F.count(F.lit(1)).alias("row_count"))
    return g.select(*by, F.col("w.start").cast("timestamp_ntz").alias("bucket"),
                    F.col("w.end").cast("timestamp_ntz").alias("bucket_end"), "row_count")


def dedup_alerts(stream: DataFrame, ts_col: str = "alert_timestamp", watermark: str = "1 day") -> DataFrame:
    """First-seen alert per (type, table, day) across micro-batches."""
    from relmon.operators.alerts import day_key
    s = event_time(stream, ts_col).withColumn("dedup_key", day_key(ts_col=ts_col))
    return s.withWatermark("event_time", watermark).dropDuplicatesWithinWatermark(["dedup_key"])


def latest_per_source(stream: DataFrame, ts_col: str, by=()) -> DataFrame:
    """Running latest event time per source (update/complete mode)."""
    return stream.groupBy(*by).agg(F.max(ts_col).alias(ts_col))


def sliding_counts(stream: DataFrame, ts_col: str, by=(), window: str = "24 hours", slide: str = "1 hour",
                   watermark: str = "1 hour") -> DataFrame:
    """Row counts of overlapping windows (a trailing total at each slide), each
    emitted once when the watermark has passed its end.  A row is in window/slide
    windows; they are summed on the map side before the shuffle."""
    s = event_time(stream, ts_col).withWatermark("event_time", watermark)
    g = s.groupBy(F.window("event_time", window, slide).alias("w"), *by).agg(F.count(F.lit(1)).alias("row_count"))
    return g.select(*by, F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                    F.col("w.end").cast("timestamp_ntz").alias("window_end"), "row_count")


def sessions(stream: DataFrame, ts_col: str, by=(), gap: str = "60 minutes", watermark: str = "1 hour") -> DataFrame:
    """Stretches of activity per source, closed by a silence of ``gap``: first and
    last event, rows.  What lies between a session's last event and the next one is
    an outage of at least ``gap``."""
    s = event_time(stream, ts_col).withWatermark("event_time", watermark)
    g = s.groupBy(F.session_window("event_time", gap).alias("w"), *by).agg(
        F.count(F.lit(1)).alias("row_count"), F.max("event_time").alias("last"))
    return g.select(*by, F.col("w.start").cast("timestamp_ntz").alias("first_event"),
                    F.col("last").cast("timestamp_ntz").alias("last_event"), "row_count")


def run_available(df: DataFrame, base: str, output_mode: str = "append") -> DataFrame:
    """Run a streaming query over the data available now, its checkpoint and
    output under ``base``, and return all that it has put out so far.  Called
    again, it goes on where it ended: state, offsets and output are those of the
    checkpoint, and data read before adds nothing."""
    out = base + "/out"
    q = df.writeStream.outputMode(output_mode).format("parquet").option("path", out) \
          .option("checkpointLocation", base + "/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def score_against_store(counts: DataFrame, baselines_path: str, base: str, keys, value_col: str = "row_count",
                        threshold: float = 3.0) -> DataFrame:
    """Score each closed window of a stream against the baseline store's newest
    version *at the time of its micro-batch*: the store is read again for every
    batch, so a profiling run takes effect without a restart.  A batch writes the
    folder of its id, so a replayed one replaces itself.  Returns all scores so far."""
    from relmon.operators.detect import latest_baseline
    from relmon.sinks.store import BASELINE_SCHEMA, _fs, read_latest
    spark = counts.sparkSession
    out = base + "/scores"
    cols = ["mean_value", "std_deviation", "sample_size", "calculation_timestamp"]

    def score(batch: DataFrame, batch_id: int) -> None:
        from relmon.functions import stats as S
        store = read_latest(batch.sparkSession, baselines_path, BASELINE_SCHEMA)
        b = latest_baseline(store, list(keys)).select(*keys, *cols)
        z = S.signed_z(value_col, "mean_value", "std_deviation")
        j = batch.join(b, list(keys), "left").withColumn("signed_z", S.as_z(z)) \
                 .withColumn("is_anomaly", F.coalesce(S.is_anomaly(z, threshold), F.lit(False)))
        j.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    counts.writeStream.option("checkpointLocation", base + "/checkpoint").foreachBatch(score) \
          .trigger(availableNow=True).start().awaitTermination()
    fs, p = _fs(spark, out)
    return spark.read.parquet(out).drop("batch_id") if fs.exists(p) else None


def run_to_table(df: DataFrame, name: str, output_mode: str = "append", trigger_once: bool = True) -> DataFrame:
    """Run a streaming query to completion over the data available now and
    return its output as a batch DataFrame.  Output and checkpoint live in
    the shared checkpoint folder (never the driver's memory); every run gets
    a fresh sub-folder."""
    spark = df.sparkSession
    base = scratch_path(spark, f"stream-{name}-{uuid.uuid4().hex[:12]}")
    out, ck = base + "/out", base + "/checkpoint"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # overwrite of the batch's own folder: a replayed batch is idempotent
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    w = df.writeStream.outputMode(output_mode).option("checkpointLocation", ck)
    if output_mode == "append":
        w = w.format("parquet").option("path", out)
    else:
        w = w.foreachBatch(write_batch)
    q = w.trigger(availableNow=True).start() if trigger_once else w.start()
    q.awaitTermination()
    if output_mode == "complete":
        # the last micro-batch carries the complete result
        from relmon.sinks.store import _fs
        fs, p = _fs(spark, out)
        ids = sorted(int(st.getPath().getName().split("=")[1]) for st in fs.listStatus(p)
                     if st.getPath().getName().startswith("batch_id=")) if fs.exists(p) else []
        if not ids:
            return spark.createDataFrame([], df.schema)
        return spark.read.parquet(f"{out}/batch_id={ids[-1]}")
    return spark.read.schema(df.schema).parquet(out)


def run_to_stores(stream: DataFrame, baselines_path: str | None = None, alerts_path: str | None = None,
                  to_baselines=None, to_alerts=None, checkpoint: str | None = None) -> int:
    """Feed the batch stores from a stream until no data is left: each
    micro-batch is turned into baseline rows and/or alert rows by the given
    functions and written with the batch sinks, whose upsert and
    insert-if-absent make a replayed batch harmless.  The batch id is handed
    on, so a finished upsert of a replayed batch is recognised.  Returns the
    number of micro-batches run."""
    from relmon.sinks.store import append_alerts, upsert_baselines
    spark = stream.sparkSession
    seen: list[int] = []

    def write(batch: DataFrame, batch_id: int) -> None:
        if to_baselines is not None:
            upsert_baselines(spark, to_baselines(batch), baselines_path, batch_id=batch_id)
        if to_alerts is not None:
            append_alerts(spark, to_alerts(batch), alerts_path)
        seen.append(batch_id)

    ck = checkpoint or scratch_path(spark, f"stream-stores-{uuid.uuid4().hex[:12]}")
    stream.writeStream.option("checkpointLocation", ck).foreachBatch(write).trigger(availableNow=True).start() \
          .awaitTermination()
    return len(seen)
