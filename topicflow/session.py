"""Spark session defaults and small cluster-safety helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "topicflow",
              shuffle_partitions: int | None = None,
              extra: dict | None = None) -> SparkSession:
    """Session with AQE, UTC and the UI off; reuses an active session."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.sql.files.maxPartitionBytes": "64m",
        # AQE turns a sort-merge join into a shuffled hash join when every
        # build-side partition is below this size (checked at run time).
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; set a scratch one only when unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not path:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        path = tempfile.mkdtemp(prefix="topicflow-ckpt-")   # one machine only: local mode, tests
        spark.conf.set("spark.checkpoint.dir", path)
    try:
        spark.sparkContext.setCheckpointDir(path)
    except Exception:  # Spark Connect has no SparkContext
        pass
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder (never a machine-local temp dir)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into spark.checkpoint.dir (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """More tasks for a scan of fewer splits than cores (small files).

    An input with enough splits keeps them: nothing is shuffled.
    """
    cores = int(df.sparkSession.sparkContext.defaultParallelism)
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def materialise(df: DataFrame) -> DataFrame:
    """Persist (memory, spilling to disk) a frame several branches reuse.

    Lost executors recompute lost blocks from lineage.
    """
    from pyspark import StorageLevel
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def pinned(df: DataFrame) -> DataFrame:
    """A small table written to the shared folder and read back: later plans
    start from a leaf of known size, and joins choose their side by it."""
    path = shared_path(df.sparkSession, f"pinned-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
