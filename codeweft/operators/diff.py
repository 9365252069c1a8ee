"""Comparing sets of hashes: partition into common and one-sided, verification, look-up in an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.operators.ranking import global_rank


def _side(df: DataFrame, key: str, label: str, order: str | None, name: str) -> DataFrame:
    picked = F.max(F.struct(F.col(order).alias("o"), F.col(label).alias("l"))).getField("l") if order else F.max(label)
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(picked.alias(f"label_{name}"), F.count(F.lit(1)).alias(f"n_{name}"))


def hash_diff(a: DataFrame, b: DataFrame, key: str, label: str, order: str | None = None) -> DataFrame:
    """(key, status, label_a, label_b, n_a, n_b), status common, only_a or only_b.

    The label of a hash is its last one by order on each side, or the greatest without an order. Null hashes take no part.
    """
    both = _side(a, key, label, order, "a").join(_side(b, key, label, order, "b"), key, "full")
    status = F.when(F.col("n_b").isNull(), "only_a").when(F.col("n_a").isNull(), "only_b").otherwise("common")
    return both.select(key, status.alias("status"), "label_a", "label_b", F.coalesce("n_a", F.lit(0)).alias("n_a"), F.coalesce("n_b", F.lit(0)).alias("n_b"))


def ordered_diff(found: DataFrame, key: str) -> DataFrame:
    """A hash_diff with its position from 0 in ascending order of hash."""
    return global_rank(found, [F.col(key)])


def verify(expected: DataFrame, actual: DataFrame, key: str, both_ways: bool = True) -> DataFrame:
    """(key, problem): hashes that are missing from actual and, both ways, those that are extra. No rows mean success."""
    e, a = (x.filter(F.col(key).isNotNull()).select(key).distinct() for x in (expected, actual))
    missing = e.join(a, key, "left_anti").withColumn("problem", F.lit("missing"))
    if not both_ways:
        return missing
    return missing.unionByName(a.join(e, key, "left_anti").withColumn("problem", F.lit("extra")))


def probe_index(probes: DataFrame, index: DataFrame, key: str, first_by: list[str]) -> DataFrame:
    """probes with found boolean, n_places long and the first place of the same hash in the index. A null hash is never found."""
    places = index.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_places"), F.min(F.struct(*first_by)).alias("first_place"))
    out = probes.join(places, key, "left")
    return out.withColumn("n_places", F.coalesce("n_places", F.lit(0))).withColumn("found", F.col("n_places") > 0)


def cache_probe(wanted: DataFrame, cache: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): rows of wanted with the cached columns, and those without. Null keys are misses."""
    return wanted.join(cache, keys), wanted.join(cache.select(*keys).distinct(), keys, "left_anti")
