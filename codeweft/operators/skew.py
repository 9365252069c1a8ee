"""Per-key results over heavily skewed keys.

Rows are reduced to one state for each (key, secondary value) before any exchange, so that a key of one secondary value
is a state for each map task and no more. The states are range-partitioned on (key, secondary order) with Spark's
sampled quantiles: a heavy key is cut into several neighbouring ranges instead of filling one task. Each range reduces
its part to one state per key, and the states of a key that crosses range borders are stitched. Rows never meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def skewed_key_stats(
    df: DataFrame,
    key: str,
    distinct_of: str,
    first_by: list[str],
    extra_keys: tuple[str, ...] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Occurrences, distinct values of one column and the first row of every key.

    key: the grouping column; rows with a null key give no result row. distinct_of: counted without nulls and used as
    the secondary order of the ranges. first_by: columns whose smallest tuple (nulls first) is the first occurrence.
    extra_keys: further grouping columns in front of key (a table name, say).

    Result: extra_keys, key, n_occurrences long, n_distinct long, first struct<first_by>. Repeated rows count each
    time. An empty input gives an empty result. Ties in first_by are equal tuples, so any of them is the answer.
    Other columns of df are ignored, whatever their names.
    """
    keys = [*extra_keys, key]
    rows = df.filter(F.col(key).isNotNull()).select(
        *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)],
        F.col(distinct_of).alias("_d"),
        F.struct(*[F.col(c) for c in first_by]).alias("_first"),
    )
    names = [f"_k{i}" for i in range(len(keys))]
    by = [F.col(n) for n in names] + [F.col("_d")]
    # Equal (key, secondary) rows are one state on the map side already, however many they are.
    states = rows.groupBy(*names, "_d").agg(F.count(F.lit(1)).alias("_n"), F.min("_first").alias("_first"))
    states = states.repartitionByRange(partitions, *by) if partitions else states.repartitionByRange(*by)
    # Stitching: the map side leaves one state per key and range, and the exchange carries these only.
    return (
        states.groupBy(*names)
        .agg(F.sum("_n").alias("n_occurrences"), F.count("_d").alias("n_distinct"), F.min("_first").alias("first"))
        .select(
            *[F.col(n).alias(k) for n, k in zip(names, keys)],
            "n_occurrences",
            "n_distinct",
            "first",
        )
    )


def heavy_keys(stats: DataFrame, totals: DataFrame, share: float, on: str) -> DataFrame:
    """Keys holding at least share of all rows of their table.

    totals: one row per table with n_rows, null keys included; its size is the number of tables. share is compared
    exactly in parts per million.
    """
    ppm = round(share * 1_000_000)
    hit: Column = F.col("n_occurrences") * F.lit(1_000_000) >= F.col("n_rows") * F.lit(ppm)
    return stats.join(F.broadcast(totals), on).filter(hit)
