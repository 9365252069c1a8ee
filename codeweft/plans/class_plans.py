"""Queries over classes: Merkle hashes, inheritance, exact clusters, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import sql
from codeweft.operators import classes, clusters, extract
from codeweft.session import spread, table
from codeweft.sources import generated


def _classes(spark: SparkSession, d: str) -> DataFrame:
    rows = generated.python_classes(table(spark, d, "orders"), table(spark, d, "lineitem"))
    return extract.python_classes(rows.select("o_orderkey", "o_custkey", "code"), "code")


def class_exact_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(_classes(spark, d), "class_hash", ["o_orderkey"]).select(F.col("first.o_orderkey").alias("first_key"), "n_members")


def class_method_order(spark: SparkSession, d: str) -> DataFrame:
    """Classes whose hash changes when their methods stand in another order: none."""
    rows = generated.python_classes(table(spark, d, "orders"), table(spark, d, "lineitem"))
    first = extract.python_classes(rows.select("o_orderkey", "code", "reversed_code"), "code").select("reversed_code", F.col("class_hash").alias("other"))
    return extract.python_classes(first, "reversed_code").agg(F.count(F.lit(1)).alias("n_classes"), F.count_if(F.col("class_hash") != F.col("other")).alias("n_changed"))


def health_classes(spark: SparkSession, d: str) -> DataFrame:
    return clusters.health_report(_classes(spark, d).withColumn("all", F.lit("all")), "class_hash", ["all"]).select("total", "unique", "health_cli")


def merkle_hash(spark: SparkSession, d: str) -> DataFrame:
    """Merkle hash of each order's quantities, as strings. The lines of an order are few by nature."""
    lines = table(spark, d, "lineitem")
    return lines.groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("int").cast("string")).alias("h")).select("l_orderkey", sql.merkle_hash(F.col("h")).alias("hash"))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    """Rows of classes, redelivered ones once."""
    columns = ["class_id", "name", "file", "lineno", "bases", "methods", "class_hash", "ord"]
    rows = table(spark, d, "classes").select(*columns)
    return rows.groupBy("class_id").agg(F.min(F.struct(*columns[1:])).alias("r")).select("class_id", "r.*")


def class_inheritance(spark: SparkSession, d: str) -> DataFrame:
    out = classes.fold_inheritance(_stored(spark, d).withColumn("rank", F.struct("ord", "class_id")), "class_id", "name", "bases", "class_hash", "rank")
    return out.select("class_id", "parent_hash", "folded_hash")


def class_inheritance_clusters(spark: SparkSession, d: str) -> DataFrame:
    out = classes.fold_inheritance(_stored(spark, d).withColumn("rank", F.struct("ord", "class_id")), "class_id", "name", "bases", "class_hash", "rank")
    return clusters.clusters(out, "folded_hash", ["class_id"]).select("folded_hash", F.col("first.class_id").alias("first_id"), "n_members")


def _similar(spark: SparkSession, d: str, threshold: float) -> DataFrame:
    rows = _stored(spark, d).withColumn("hashes", F.col("methods.hash")).withColumn("key", F.col("class_id"))
    return classes.similar_classes(rows, "class_id", ["key"], "hashes", "class_hash", threshold)


def class_similarity_t75(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, 0.75)


def class_similarity_t50(spark: SparkSession, d: str) -> DataFrame:
    return _similar(spark, d, 0.5)


def class_similarity_t0(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of the class catalogue, a table of fixed size."""
    rows = table(spark, d, "class_catalog").withColumn("hashes", F.col("methods.hash"))
    return classes.similar_classes(rows, "class_id", ["library", "name", "class_id"], "hashes", "class_hash", 0.0)


def class_similarity_ordered(spark: SparkSession, d: str) -> DataFrame:
    return classes.ordered_pairs(_similar(spark, d, 0.5)).select("position", "index_a", "index_b", "similarity")


def class_similarity_namesakes(spark: SparkSession, d: str) -> DataFrame:
    """Similar classes where those of one library are namesakes: each is paired by its first class only."""
    rows = table(spark, d, "class_catalog").withColumn("hashes", F.col("methods.hash"))
    return classes.similar_classes(rows, "class_id", ["library"], "hashes", "class_hash", 0.0)


def class_pair_details(spark: SparkSession, d: str) -> DataFrame:
    out = classes.pair_details(_similar(spark, d, 0.75), _stored(spark, d), "class_id", "methods")
    return out.select("index_a", "index_b", F.size("shared").alias("n_common"), F.size("only_in_a").alias("n_only_a"), F.size("only_in_b").alias("n_only_b"))


QUERIES = {
    f.__name__: f
    for f in (
        class_exact_clusters, class_method_order, health_classes, merkle_hash, class_inheritance, class_inheritance_clusters,
        class_similarity_t75, class_similarity_t50, class_similarity_t0, class_similarity_ordered, class_similarity_namesakes, class_pair_details,
    )
}

_ORDERS = "SELECT l_orderkey AS k, list_sort(list(l_quantity::INT)) AS q FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1"
_C = "c AS (SELECT DISTINCT class_id, name, bases, methods, class_hash, ord FROM classes)"
_FOLD = f"""
WITH {_C}, b AS (SELECT name, arg_max(class_hash, (ord, class_id)) AS h FROM c WHERE class_hash IS NOT NULL GROUP BY 1),
w AS (SELECT class_id, unnest(bases) AS base FROM c), p AS (SELECT class_id, list_sort(list(h)) AS ps FROM w JOIN b ON b.name = base GROUP BY 1)
SELECT class_id, CASE WHEN len(ps) = 1 THEN ps[1] WHEN len(ps) > 1 THEN sha256(to_json(ps)::VARCHAR) END AS parent_hash,
  CASE WHEN ps IS NULL THEN class_hash ELSE sha256(to_json({{'methods': class_hash, 'parents': ps}})::VARCHAR) END AS folded_hash
FROM c LEFT JOIN p USING (class_id)"""


def _similarity(threshold: float, source: str) -> str:
    return f"""
WITH c AS ({source}), m AS (SELECT class_id, class_hash, len(methods) AS n, list_distinct(list_filter(list_transform(methods, lambda x: x.hash), lambda y: y IS NOT NULL)) AS hs FROM c WHERE len(methods) > 0),
e AS (SELECT class_id, class_hash, n, unnest(hs) AS h FROM m),
p AS (SELECT a.class_id AS i, b.class_id AS j, count(*) AS s FROM e a JOIN e b ON a.h = b.h AND a.class_id < b.class_id GROUP BY 1, 2)
SELECT i AS index_a, j AS index_b, s::INT AS n_shared, s / greatest(x.n, y.n) AS similarity FROM p JOIN m x ON x.class_id = i JOIN m y ON y.class_id = j
WHERE x.class_hash IS DISTINCT FROM y.class_hash AND s / greatest(x.n, y.n) >= {threshold}"""


_STORED = "SELECT DISTINCT class_id, methods, class_hash FROM classes"
SQL = {
    "class_exact_clusters": f"SELECT min(k) AS first_key, count(*) AS n_members FROM ({_ORDERS}) GROUP BY q HAVING count(*) >= 2",
    "class_method_order": f"SELECT count(*) AS n_classes, 0::BIGINT AS n_changed FROM ({_ORDERS})",
    "health_classes": f"""WITH g AS (SELECT q, count(*) AS n FROM ({_ORDERS}) GROUP BY 1)
SELECT sum(n)::BIGINT AS total, count(*) AS "unique", greatest(0, round_even((1.0::DOUBLE - coalesce(sum(CASE WHEN n >= 2 THEN n END), 0)::DOUBLE / sum(n)) * 100, 0)::INT) AS health_cli FROM g""",
    "merkle_hash": "SELECT l_orderkey, sha256(to_json(list_sort(list(l_quantity::INT::VARCHAR)))::VARCHAR) AS hash FROM lineitem GROUP BY 1",
    "class_inheritance": _FOLD,
    "class_inheritance_clusters": f"SELECT folded_hash, min(class_id) AS first_id, count(*) AS n_members FROM ({_FOLD}) WHERE folded_hash IS NOT NULL GROUP BY 1 HAVING count(*) >= 2",
    "class_similarity_t75": _similarity(0.75, _STORED),
    "class_similarity_t50": _similarity(0.5, _STORED),
    "class_similarity_t0": """
WITH m AS (SELECT class_id, class_hash, len(methods) AS n, list_distinct(list_filter(list_transform(methods, lambda x: x.hash), lambda y: y IS NOT NULL)) AS hs FROM class_catalog WHERE len(methods) > 0)
SELECT a.class_id AS index_a, b.class_id AS index_b, len(list_intersect(a.hs, b.hs))::INT AS n_shared, len(list_intersect(a.hs, b.hs)) / greatest(a.n, b.n) AS similarity
FROM m a JOIN m b ON a.class_id < b.class_id WHERE a.class_hash IS DISTINCT FROM b.class_hash""",
    "class_similarity_ordered": f"""SELECT row_number() OVER (ORDER BY similarity DESC, index_a, index_b) - 1 AS position, index_a, index_b, similarity FROM ({_similarity(0.5, _STORED)})""",
    "class_similarity_namesakes": """
WITH m AS (SELECT class_id, class_hash, len(methods) AS n, list_distinct(list_filter(list_transform(methods, lambda x: x.hash), lambda y: y IS NOT NULL)) AS hs, library,
  row_number() OVER (PARTITION BY library ORDER BY class_id) AS rn FROM class_catalog WHERE len(methods) > 0)
SELECT a.class_id AS index_a, b.class_id AS index_b, len(list_intersect(a.hs, b.hs))::INT AS n_shared, len(list_intersect(a.hs, b.hs)) / greatest(a.n, b.n) AS similarity
FROM m a JOIN m b ON a.class_id < b.class_id WHERE a.class_hash IS DISTINCT FROM b.class_hash AND (a.rn = 1 AND b.rn = 1 OR a.rn = 1 AND b.rn = 2 AND a.library = b.library)""",
    "class_pair_details": f"""
SELECT index_a, index_b, n_shared AS n_common, (len(x.hs) - n_shared)::INT AS n_only_a, (len(y.hs) - n_shared)::INT AS n_only_b FROM ({_similarity(0.75, _STORED)}) q
JOIN (SELECT DISTINCT class_id, list_distinct(list_filter(list_transform(methods, lambda x: x.hash), lambda y: y IS NOT NULL)) AS hs FROM classes) x ON x.class_id = index_a
JOIN (SELECT DISTINCT class_id, list_distinct(list_filter(list_transform(methods, lambda x: x.hash), lambda y: y IS NOT NULL)) AS hs FROM classes) y ON y.class_id = index_b""",
}
