"""Spark session helpers.

The library never creates a session behind a caller's back; `build_session` is for
tests, benchmarks and scripts.  `checkpoint_dir` reads the cluster's shared
checkpoint folder and only falls back to a local scratch folder when the setting
is absent (local tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "calibra", extra: dict | None = None) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # no Python call-site capture per Column: plans here are built from hundreds
        # of expressions and the capture dominates driver-side plan construction
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by `spark.checkpoint.dir`.

    Only a local-mode session (tests, benchmarks) without the setting gets a
    scratch folder of its own; a cluster session without it is an error, because a
    machine-local folder would not survive the loss of that machine.
    """
    current = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getCheckpointDir()
    if current:
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(current)
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_CONF} to a shared folder (HDFS, object store) for this cluster")
    local = tempfile.mkdtemp(prefix="calibra-ckpt-")
    spark.conf.set(CHECKPOINT_CONF, local)
    spark.sparkContext.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for intermediate tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame several reports will read (e.g. an audit result):
    a reliable checkpoint into the shared checkpoint folder, so a lost executor
    re-reads the saved blocks instead of recomputing the audit."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
