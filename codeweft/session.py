"""Session helpers: table reading, checkpoints in the folder the cluster names, task sizing."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(cores: int | str = "*", app: str = "codeweft") -> SparkSession:
    """A local session for tests and the bench; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("SHUFFLE_PARTITIONS", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("DRIVER_MEMORY", "8g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; Parquet keeps pruning and pushdown available to the caller."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared folder of spark.checkpoint.dir; make a local one only where none is set and everything runs in one
    process (tests). Elsewhere a local folder would be out of other executors' reach, so its absence is an error."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if where:
        if current is None or not current.startswith(where.rstrip("/")):
            sc.setCheckpointDir(where)
        return where
    if current is None:
        if not (sc.master or "").startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors reach")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="codeweft-ckpt-"))
    return sc.getCheckpointDir()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder of its own beside the checkpoints, for tables that are written and read again."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{purpose}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write df once to the shared checkpoint folder, so that later uses read it and a lost executor costs nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame) -> DataFrame:
    """A scan of few, small files over all cores, for work that costs much more than its input is large.

    Scans that have at least half as many partitions as there are cores stay as they are, so large inputs aren't shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 < cores else df
