"""Positions in a total order without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from codeweft.session import cut


def global_rank(df: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """df with its position from 0 in the given order; rows equal in it are numbered in any order.

    Rows are range-partitioned and sorted inside their ranges; the number of rows before a range is summed over one
    number for each range, and only these numbers are sent around. Nothing is collected. An empty table stays empty.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    local = F.col("_at") - F.shiftleft(F.col("_part").cast("long"), 33)
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    out = ranged.join(F.broadcast(before.select("_part", "_before")), "_part")
    return out.withColumn(name, (local + F.col("_before")).cast("long")).drop("_part", "_at", "_before")
