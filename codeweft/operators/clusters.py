"""Clusters of equal hashes, their health scores, and rankings inside and among them.

A cluster is kept as one row of aggregates; its members stay rows of their own, joined by the hash, for a cluster may
hold a large part of all rows. First and last members come from aggregates over structs, which combine before the
shuffle, not from windows over a whole cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.operators.ranking import global_rank


def clusters(df: DataFrame, key: str, first_by: list[str], least: int = 2, language: str | None = None) -> DataFrame:
    """One row for each hash with at least `least` rows: key, n_members, first struct<first_by>, and n_languages.

    Rows with a null key take no part. An empty table gives no clusters.
    """
    more = [F.count_distinct(language).alias("n_languages")] if language else []
    grouped = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n_members"), F.min(F.struct(*first_by)).alias("first"), *more)
    return grouped.filter(F.col("n_members") >= least)


def cross_language(df: DataFrame, key: str, language: str, first_by: list[str]) -> DataFrame:
    """Clusters with members of more than one language."""
    return clusters(df, key, first_by, 2, language).filter("n_languages > 1")


def members(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The rows of clusters, each with its cluster's size."""
    return df.join(found.select(key, "n_members"), key)


def ordered_clusters(found: DataFrame, key: str, by_first: bool = False) -> DataFrame:
    """Clusters with cluster_index from 0, larger ones first, then by hash or by first member."""
    second = F.col("first") if by_first else F.col(key)
    return global_rank(found, [F.col("n_members").desc(), second, F.col(key)], "cluster_index")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of every key in the given order; null keys are a key. Order columns should decide ties."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    first = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_r"))
    return first.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in [*order, *rest]]).select(*df.columns)


def after_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """All rows but the first of every key. Rows equal to the first in order stay out together with it."""
    first = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    same = [F.col(f"_k_{k}").eqNullSafe(F.col(k)) for k in keys]
    renamed = first.select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first")
    return df.join(renamed, on=same).filter(F.struct(*order) != F.col("_first")).select(*df.columns)


# --- health ------------------------------------------------------------------------------------------------------


def health_cli(total: Column, duplicate_members: Column) -> Column:
    """100 minus the share of rows in clusters, rounded half to even; 100 for no rows."""
    score = F.bround((F.lit(1.0) - duplicate_members / total) * 100, 0).cast("int")
    return F.when(total == 0, F.lit(100)).otherwise(F.greatest(F.lit(0), score))


def health_ui(total: Column, unique: Column) -> Column:
    """Share of different structures, cut to a whole number."""
    return (F.lit(100) * unique / F.greatest(total, F.lit(1))).cast("int")


def health_mcp(total: Column, extra: Column) -> Column:
    """100 minus the share of members beyond the first of their cluster, that share cut to a whole number."""
    return F.when(total == 0, F.lit(100)).otherwise(F.greatest(F.lit(0), F.lit(100) - (extra / total * 100).cast("int")))


def health_after_merge(total: Column, unique: Column, extra: Column) -> Column:
    return F.least(F.lit(100), (F.lit(100) * unique / F.greatest(total - extra, F.lit(1))).cast("int"))


def health_report(df: DataFrame, key: str, by: list[str], least: int = 2, count_unhashed: bool = False) -> DataFrame:
    """All scores for each value of by: total, unique, dup_members, extra, health_cli, health_ui, health_mcp, health_after.

    count_unhashed: rows without a hash count into the total, else they take no part at all.
    """
    rows = df if count_unhashed else df.filter(F.col(key).isNotNull())
    groups = rows.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    hashed = F.col(key).isNotNull()
    dup = hashed & (F.col("n") >= least)
    sums = groups.groupBy(*by).agg(
        F.sum("n").alias("total"),
        F.count(key).alias("unique"),
        F.coalesce(F.sum(F.when(dup, F.col("n"))), F.lit(0)).alias("dup_members"),
        F.coalesce(F.sum(F.when(dup, F.col("n") - 1)), F.lit(0)).alias("extra"),
    )
    total, unique, members_, extra = (F.col(c) for c in ("total", "unique", "dup_members", "extra"))
    return sums.withColumns(
        {
            "health_cli": health_cli(total, members_),
            "health_ui": health_ui(total, unique),
            "health_mcp": health_mcp(total, extra),
            "health_after": health_after_merge(total, unique, extra),
        }
    )


# --- accuracy ----------------------------------------------------------------------------------------------------


def classification_metrics(df: DataFrame, expected: str, actual: str, undefined: float = 0.0) -> DataFrame:
    """tp, tn, fp, fn, precision, recall, f1, accuracy of two boolean columns; undefined stands for 0 divided by 0. Nulls count as false."""
    e, a = (F.coalesce(F.col(c), F.lit(False)) for c in (expected, actual))
    counted = df.agg(
        F.count_if(e & a).alias("tp"), F.count_if(~e & ~a).alias("tn"), F.count_if(~e & a).alias("fp"), F.count_if(e & ~a).alias("fn")
    )
    ratio = lambda x, y: F.when(y == 0, F.lit(undefined)).otherwise(x / y)
    tp, tn, fp, fn = (F.col(c) for c in ("tp", "tn", "fp", "fn"))
    scored = counted.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "accuracy": ratio(tp + tn, tp + tn + fp + fn)})
    p, r = F.col("precision"), F.col("recall")
    return scored.withColumn("f1", ratio(2 * p * r, p + r))


def pairs_against_truth(rows: DataFrame, key: str, file: str, name: str, truth: DataFrame) -> DataFrame:
    """tp, fp, fn, precision and recall of the pairs of places that clusters imply, against known pairs.

    rows: a place (file, name) is one member of a cluster however often it is repeated there. truth: (file_a, name_a,
    file_b, name_b), in either order, repeats count once. Precision and recall are 1 where they are undefined. Pairs of a
    cluster are counted, not made: a known pair is found where both its places have the same hash. A pair of places that
    share several hashes counts for each of them among those found beyond the truth.
    """
    places = rows.filter(F.col(key).isNotNull()).select(F.col(key).alias("k"), F.struct(F.col(file).alias("f"), F.col(name).alias("n")).alias("p")).distinct()
    sizes = places.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    detected = sizes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("detected"))
    a, b = (F.struct(F.col(f"file_{x}").alias("f"), F.col(f"name_{x}").alias("n")) for x in "ab")
    known = truth.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    hit = known.join(places.select(F.col("p").alias("a"), "k"), "a").join(places.select(F.col("p").alias("b"), "k"), ["b", "k"]).select("a", "b", "k")
    counts = hit.agg(F.count_distinct("a", "b").alias("tp"), F.count(F.lit(1)).alias("met"))
    one = counts.join(F.broadcast(detected)).join(F.broadcast(known.agg(F.count(F.lit(1)).alias("wanted"))))  # one row each
    out = one.select("tp", (F.col("detected") - F.col("met")).alias("fp"), (F.col("wanted") - F.col("tp")).alias("fn"))
    part = lambda y: F.when(y == 0, F.lit(1.0)).otherwise(F.col("tp") / y)
    return out.withColumns({"precision": part(F.col("tp") + F.col("fp")), "recall": part(F.col("tp") + F.col("fn"))})


def stability(df: DataFrame, first: str, second: str) -> DataFrame:
    """Share in percent, rounded, of rows whose two hashes agree, among those that have both."""
    both = df.filter(F.col(first).isNotNull() & F.col(second).isNotNull())
    return both.agg(
        F.count_if(F.col(first) == F.col(second)).alias("stable"), F.count_if(F.col(first) != F.col(second)).alias("unstable")
    ).withColumn("stability", F.when(F.col("stable") + F.col("unstable") == 0, F.lit(0)).otherwise(F.bround(F.col("stable") * 100 / (F.col("stable") + F.col("unstable")), 0).cast("int")))
