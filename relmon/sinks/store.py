"""Monitoring stores on plain files (parquet), safe for concurrent readers.

* **Baselines** (upsert by key): a versioned table.  Every upsert writes the
  merged table into a NEW directory ``<path>/v=<n>``; Spark's job commit
  writes ``_SUCCESS`` last, and readers only ever open the highest version
  that has it.  A half-written version is invisible, a failed job can simply
  be re-run (its folder's number is not used again), and old versions stay
  readable until pruned.
* **Alerts** (insert-if-absent): append-only, partitioned by ``alert_date``;
  an appended batch is first anti-joined (null-safe) against the stored keys
  of the dates it touches, so replaying a batch adds nothing.  Retention drops
  whole date partitions.

Everything goes through ``spark.read`` / ``df.write``; the Hadoop FileSystem
API is used only to list versions and drop expired partitions.
"""

from __future__ import annotations

import datetime as _dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relmon.operators.alerts import ALERT_COLUMNS, ALERT_KEY, new_alerts
from relmon.operators.detect import BASELINE_KEY, latest_baseline
from relmon.operators.profile import to_datetime
from relmon.session import scratch_path

BASELINE_SCHEMA = ("metric_name string, source_database string, table_name string, mean_value decimal(15,4), "
                   "std_deviation decimal(15,4), sample_size int, calculation_timestamp timestamp_ntz")


# Fixed value: the folder name of a null partition value.
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    out = []
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            if fs.exists(st.getPath().suffix("/_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def read_latest(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The newest committed version of a versioned table (None if none)."""
    v = _versions(spark, path)
    if not v:
        return spark.createDataFrame([], schema) if schema else None
    return spark.read.parquet(f"{path.rstrip('/')}/v={v[-1]:08d}")


def _attempts(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all version folders, also those a failed job left behind."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    names = [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
    return sorted(int(n[2:]) for n in names if n.startswith("v="))


def write_version(df: DataFrame, path: str) -> str:
    """Write ``df`` as the next version; returns its directory.  The number
    follows every folder present, so what a failed job left behind is in nobody's
    way.  Two writers that pick one number: the second fails on the folder of
    the first and can be run again."""
    n = max(_attempts(df.sparkSession, path), default=0) + 1
    out = f"{path.rstrip('/')}/v={n:08d}"
    df.write.mode("errorifexists").parquet(out)
    return out


def prune_versions(spark: SparkSession, path: str, keep: int = 3) -> int:
    """Delete all but the newest ``keep`` committed versions."""
    fs, p = _fs(spark, path)
    v = _versions(spark, path)
    dropped = 0
    for n in v[:-keep] if keep > 0 else v:
        fs.delete(p.suffix(f"/v={n:08d}"), True)
        dropped += 1
    return dropped


def upsert_baselines(spark: SparkSession, new: DataFrame, path: str, keys=BASELINE_KEY,
                     batch_id: int | None = None) -> str:
    """Upsert baselines by key: old and new rows are unioned and the latest
    per key (by calculation_timestamp) is written as a new version.  The
    merge is one aggregate over (#keys) rows, small at any data scale.

    With a ``batch_id`` (of a streaming micro-batch) a marker is left beside
    the versions; a batch that has one was merged before and is not again."""
    fs, p = _fs(spark, path)
    marker = p.suffix(f"/_batch_{batch_id}")
    if batch_id is not None and fs.exists(marker):
        v = _versions(spark, path)
        return f"{path.rstrip('/')}/v={v[-1]:08d}"
    old = read_latest(spark, path)
    cols = [c.split(" ")[0] for c in BASELINE_SCHEMA.split(", ")]
    merged = new.select(*cols) if old is None else old.select(*cols).unionByName(new.select(*cols))
    out = write_version(latest_baseline(merged, keys).select(*cols), path)
    if batch_id is not None:
        fs.create(marker, True).close()
    return out


def append_alerts(spark: SparkSession, batch: DataFrame, path: str, key=ALERT_KEY) -> None:
    """Insert the alerts of ``batch`` that are not stored yet (null-safe key).
    Only the date partitions the batch touches
    are read for the anti-join (dynamic partition pruning on ``alert_date``)."""
    # the batch is used several times: written once to the shared folder, so
    # whatever stands behind it (a validation run) isn't repeated
    staged = scratch_path(spark, f"alert-batch-{uuid.uuid4().hex[:12]}")
    batch.select(*ALERT_COLUMNS).withColumn("alert_date", F.to_date("alert_timestamp")).write.parquet(staged)
    b = spark.read.parquet(staged)
    fs, p = _fs(spark, path)
    if fs.exists(p):
        # semi-join on the partition column: dynamic partition pruning reads
        # only the dates present in the batch; null-safe, as an alert may have no time
        dates = b.select(F.col("alert_date").alias("b_date")).distinct()
        store = spark.read.parquet(path)
        store = store.join(dates, F.col("alert_date").eqNullSafe(F.col("b_date")), "left_semi")
        fresh = new_alerts(b.drop("alert_date"), store.select(*ALERT_COLUMNS), key)
    else:
        fresh = new_alerts(b.drop("alert_date"), b.drop("alert_date").limit(0), key)
    fresh = fresh.select(*ALERT_COLUMNS).withColumn("alert_date", F.to_date("alert_timestamp"))
    fresh.write.mode("append").partitionBy("alert_date").parquet(path)


def _drop_partitions(spark: SparkSession, path: str, column: str, cutoff: _dt.date) -> list[str]:
    """Drop the partitions of a date column older than ``cutoff``; rows without a date stay."""
    fs, p = _fs(spark, path)
    dropped = []
    if not fs.exists(p):
        return dropped
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith(column + "="):
            value = name.split("=", 1)[1]
            if value == NULL_PARTITION:
                continue
            if _dt.date.fromisoformat(value) < cutoff:
                fs.delete(st.getPath(), True)
                dropped.append(name)
    return dropped


def drop_expired_alerts(spark: SparkSession, path: str, as_of, days: int = 90) -> list[str]:
    """Retention: drop the ``alert_date`` partitions older than ``days``."""
    return _drop_partitions(spark, path, "alert_date", (to_datetime(as_of) - _dt.timedelta(days=int(days))).date())


def put_day_states(states: DataFrame, path: str) -> None:
    """Store baseline states (keys, state_day, state), one partition per day.
    The days present in ``states`` are replaced as a whole, other days are not
    touched, so a day profiled again (a replay, late rows) replaces itself."""
    states.repartition("state_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
          .partitionBy("state_day").parquet(path)


def day_states(spark: SparkSession, path: str) -> DataFrame | None:
    """Stored states; a filter on ``state_day`` reads only those days' files."""
    fs, p = _fs(spark, path)
    return spark.read.parquet(path) if fs.exists(p) else None


def drop_expired_states(spark: SparkSession, path: str, as_of, window_days: int) -> list[str]:
    """Days that have left the window of every later run."""
    return _drop_partitions(spark, path, "state_day", (to_datetime(as_of) - _dt.timedelta(days=int(window_days))).date())
