"""Fingerprint counts over a stream: each batch of rows updates a table of counts and first occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def batch_counts(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n, first): rows and smallest order of each key; null keys take no part."""
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))


def merged_counts(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts of two tables of counts together."""
    return a.unionByName(b).groupBy(key).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def upsert_counts(stream: DataFrame, key: str, order: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps a table of counts up to date with a stream; each batch adds the counts of its rows as one more file set.

    A batch's counts are written to path/batch=<id>, replacing what a failed try of the same batch left, so that every
    row counts once. Readers merge the batches with current_counts; compact_counts folds old batches into one.
    """

    def add(batch: DataFrame, batch_id: int) -> None:
        batch_counts(batch, key, order).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(key, n, first) over all batches that were written."""
    written = spark.read.parquet(path)
    return written.groupBy(key).agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def compact_counts(spark: SparkSession, path: str, key: str, target: str) -> None:
    """Folds the counts of all batches into one table of the same form at target; path stays, so that a reader of it loses nothing.

    A stream is stopped meanwhile and goes on with target as its path, where batch numbers go on too.
    """
    current_counts(spark, path, key).write.mode("overwrite").parquet(f"{target}/batch=-1")


def windowed_counts(stream: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Rows of each key in tumbling windows of event time; rows later than the watermark are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
