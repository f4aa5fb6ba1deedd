"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every relmon job wants.  AQE re-plans joins and coalesces the small
# post-aggregation partitions; the session time zone is pinned to UTC because
# monitored timestamps are naive and read as UTC.  hugeMethodLimit=8000 (the
# JVM's JIT limit) makes a stage whose fused code would be too long to JIT
# (a compiled contract) run as per-operator generated code instead, which is
# JIT-compiled and reused across queries that share the operator.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.aggregatePushdown": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "relmon", extra: dict | None = None) -> SparkSession:
    """Local/test session.  On a cluster, use the session the platform gives."""
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_utc(spark: SparkSession) -> None:
    """Naive timestamps are interpreted as UTC throughout."""
    if spark.conf.get("spark.sql.session.timeZone", None) != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def ensure_jit(spark: SparkSession) -> None:
    """Stages whose fused code the JVM would only interpret run as per-operator
    code (see ``DEFAULT_CONF``), also in a session that was built elsewhere."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(key, "65535")) > int(DEFAULT_CONF[key]):
        spark.conf.set(key, DEFAULT_CONF[key])


def checkpoint_dir(spark: SparkSession) -> str | None:
    """The shared folder named by ``spark.checkpoint.dir`` (cluster setting)."""
    try:
        d = spark.sparkContext.getCheckpointDir()
        if d:
            return d
    except Exception:  # noqa: BLE001 - no local SparkContext (e.g. a remote session)
        pass
    return spark.conf.get("spark.checkpoint.dir", None)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint dir, made known to the context.  Where none is
    configured, a local master gets a fresh scratch folder (tests); on a
    cluster that would be a folder on one machine only, so it is an error."""
    d = checkpoint_dir(spark)
    if not d:
        if not spark.conf.get("spark.master", "").split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir is not set: name a folder that all executors share")
        d = tempfile.mkdtemp(prefix="relmon-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(d)
        return spark.sparkContext.getCheckpointDir() or d
    except Exception:  # noqa: BLE001 - no local SparkContext (e.g. a remote session)
        return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for staged writes."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name


def spread(df, partitions: int | None):
    """Round-robin over ``partitions`` tasks when the caller asks for it (an
    input that arrives in too few splits for CPU-heavy row-local work);
    ``None`` leaves the input as it is.  The plan is not looked at."""
    return df.repartition(partitions) if partitions else df
