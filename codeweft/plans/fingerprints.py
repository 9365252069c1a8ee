"""Queries over functions: extraction, hashing, clusters, health, differences, JavaScript and cross-language forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import pycanon, sql
from codeweft.operators import clusters, diff, extract
from codeweft.operators.ranking import global_rank
from codeweft.session import spread, table
from codeweft.sources import generated


def _parts(spark: SparkSession, d: str, variant: str = pycanon.STRICT, where: str | None = None) -> DataFrame:
    """Functions of the generated part sources: extracted, then hashed. where: filter on part, applied at the scan."""
    part = table(spark, d, "part")
    rows = generated.python_parts(spread(part.filter(where) if where else part))
    found = extract.python_functions(rows.drop("name"), "code")
    return found.withColumn("sem_hash", sql.sem_hash(F.col("source"), variant))


def fn_clusters_strict(spark: SparkSession, d: str) -> DataFrame:
    found = clusters.clusters(_parts(spark, d), "sem_hash", ["p_partkey"])
    return found.select(F.col("first.p_partkey").alias("first_key"), "n_members").orderBy(F.desc("n_members"), "first_key")


def fn_clusters_exact_mode(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d, pycanon.EXACT)
    return rows.agg(F.count(F.lit(1)).alias("total"), F.count_distinct("sem_hash").alias("unique"))


def fn_unique_count(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).agg(F.count_distinct("sem_hash").alias("unique"))


def fn_min_cluster_n(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d)
    return clusters.clusters(rows.withColumn("key", F.concat("sem_hash", "p_brand")), "key", ["p_partkey"], 3).select(F.col("first.p_partkey").alias("first_key"), "n_members")


def _orders(spark: SparkSession, d: str, variant: str) -> DataFrame:
    rows = generated.python_orders(spread(table(spark, d, "orders"))).withColumn("sem_hash", sql.sem_hash(F.col("code"), variant))
    return clusters.clusters(rows, "sem_hash", ["o_orderkey"]).select(F.col("first.o_orderkey").alias("first_key"), "n_members")


def fn_clusters_aggressive(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, pycanon.AGGRESSIVE)


def fn_clusters_strict_builtin(spark: SparkSession, d: str) -> DataFrame:
    return _orders(spark, d, pycanon.STRICT)


def fn_canonical_pick(spark: SparkSession, d: str) -> DataFrame:
    rows = _parts(spark, d).select("sem_hash", "file", "lineno", "p_partkey")
    return clusters.keep_first(rows, ["sem_hash"], ["file", "lineno", "p_partkey"]).select("file", "p_partkey")


def fn_removals(spark: SparkSession, d: str) -> DataFrame:
    return clusters.after_first(_parts(spark, d).select("sem_hash", "p_partkey"), ["sem_hash"], ["p_partkey"]).select("p_partkey")


def fn_cluster_index(spark: SparkSession, d: str) -> DataFrame:
    found = clusters.clusters(_parts(spark, d), "sem_hash", ["p_partkey"])
    return clusters.ordered_clusters(found, "sem_hash", by_first=True).select("cluster_index", F.col("first.p_partkey").alias("first_key"), "n_members")


def health_scores(spark: SparkSession, d: str) -> DataFrame:
    return clusters.health_report(_parts(spark, d), "sem_hash", ["p_brand"])


def health_walk_lines(spark: SparkSession, d: str) -> DataFrame:
    """Methods keep their indent in this mode and don't hash, but count into the total."""
    rows = generated.python_classes(spread(table(spark, d, "orders")), table(spark, d, "lineitem"))
    found = extract.python_functions(rows, "code", "walk_lines")
    hashed = found.withColumn("sem_hash", sql.sem_hash_with_fallback(F.col("source")))
    return clusters.health_report(hashed.withColumn("all", F.lit("all")), "sem_hash", ["all"], count_unhashed=True).select("total", "unique", "health_cli")


def fn_ranked(spark: SparkSession, d: str) -> DataFrame:
    return global_rank(table(spark, d, "part").select("p_partkey", "p_name"), [F.col("p_name"), F.col("p_partkey")]).select("p_partkey", "position")


def _halves(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The functions of two sets of brands, each half parsed once."""
    key = F.concat("sem_hash", F.lit("/"), "p_type")
    return tuple(_parts(spark, d, where=f"p_brand {op} 'Brand#3'").withColumn("key", key) for op in ("<", ">="))


def hash_diff(spark: SparkSession, d: str) -> DataFrame:
    out = diff.hash_diff(*_halves(spark, d), "key", "p_partkey", "p_partkey")
    return out.select("status", "label_a", "label_b", "n_a", "n_b")


def hash_diff_ordered(spark: SparkSession, d: str) -> DataFrame:
    """The difference in order of hash, as a report lists it."""
    a, b = (x.withColumn("key", F.concat("p_size", F.lit("/"), "p_type")) for x in _halves(spark, d))
    return diff.ordered_diff(diff.hash_diff(a, b, "key", "p_partkey", "p_partkey"), "key").select("position", "key", "status", "label_a", "label_b")


def verify_missing_extra(spark: SparkSession, d: str) -> DataFrame:
    return diff.verify(*_halves(spark, d), "key").groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


def index_probe(spark: SparkSession, d: str) -> DataFrame:
    index, probes = _halves(spark, d)
    out = diff.probe_index(probes.select("p_partkey", "key"), index, "key", ["p_partkey"])
    return out.select("p_partkey", "found", "n_places", F.col("first_place.p_partkey").alias("first_key"))


def _js(spark: SparkSession, d: str) -> DataFrame:
    found = extract.js_functions(generated.js_parts(spread(table(spark, d, "part"))), "code")
    return found.withColumn("js_hash", sql.js_hash(F.col("params"), F.col("body_src")))


def js_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clusters(_js(spark, d), "js_hash", ["p_partkey"]).select("js_hash", F.col("first.p_partkey").alias("first_key"), "n_members")


def ts_equals_js(spark: SparkSession, d: str) -> DataFrame:
    ts = extract.js_functions(generated.ts_suppliers(spread(table(spark, d, "supplier"))).withColumn("ts", F.lit(True)), "code", "ts")
    ts = ts.withColumn("js_hash", sql.js_hash(F.col("params"), F.col("body_src"))).select("js_hash", F.lit("ts").alias("lang"), F.col("s_suppkey").alias("k"))
    both = ts.unionByName(_js(spark, d).select("js_hash", F.lit("js").alias("lang"), F.col("p_partkey").alias("k")))
    return clusters.cross_language(both, "js_hash", "lang", ["lang", "k"]).select("js_hash", "n_members", "n_languages")


def universal_cross_language(spark: SparkSession, d: str) -> DataFrame:
    part = spread(table(spark, d, "part"))
    py = generated.python_operator_parts(part).select("code", F.lit("m.py").alias("path"), "p_partkey")
    js = generated.js_parts(part).select("code", F.lit("m.js").alias("path"), "p_partkey")
    found = extract.universal_functions(py.unionByName(js), "code", "path")
    return clusters.cross_language(found, "universal_hash", "path", ["p_partkey", "path"]).select("universal_hash", "n_members", "n_languages")


QUERIES = {
    f.__name__: f
    for f in (
        fn_clusters_strict, fn_clusters_exact_mode, fn_unique_count, fn_min_cluster_n, fn_clusters_aggressive, fn_clusters_strict_builtin,
        fn_canonical_pick, fn_removals, fn_cluster_index, health_scores, health_walk_lines, fn_ranked, hash_diff, hash_diff_ordered, verify_missing_extra,
        index_probe, js_clusters, ts_equals_js, universal_cross_language,
    )
}

_FILE = "'src/' || replace(p_brand, '#', '_') || '/m' || (p_partkey % 7) || '.py'"
_OPS = "['+', '-', '*', '/', '%', '&']"
_JS_DATA = """'{"body":"{ const v2 = v0 ' || op || ' v1 ; return v2 + NUM ; }","lang":"javascript","params":["v0","v1"],"type":"JSFunction"}'"""
_JS = f"""
SELECT lang, k, sha256('{{"nodes":{{"' || root || '":' || data || '}},"root":"' || root || '"}}') AS js_hash FROM (
  SELECT *, sha256(data) AS root FROM (SELECT *, {_JS_DATA} AS data FROM (
    SELECT 'js' AS lang, p_partkey AS k, {_OPS}[(length(p_type) % 6 + 1)::INT] AS op FROM part
    UNION ALL SELECT 'ts', s_suppkey, {_OPS}[(s_suppkey % 6 + 1)::INT] FROM supplier)))"""
_HALVES = """WITH p AS (SELECT *, p_size || '/' || p_type AS key FROM part), a AS (SELECT * FROM p WHERE p_brand < 'Brand#3'), b AS (SELECT * FROM p WHERE p_brand >= 'Brand#3')"""
SQL = {
    "fn_clusters_strict": "SELECT min(p_partkey) AS first_key, count(*) AS n_members FROM part GROUP BY p_size HAVING count(*) >= 2",
    "fn_clusters_exact_mode": 'SELECT count(*) AS total, count(DISTINCT p_partkey) AS "unique" FROM part',
    "fn_unique_count": 'SELECT count(DISTINCT p_size) AS "unique" FROM part',
    "fn_min_cluster_n": "SELECT min(p_partkey) AS first_key, count(*) AS n_members FROM part GROUP BY p_size, p_brand HAVING count(*) >= 3",
    "fn_clusters_aggressive": "SELECT min(o_orderkey) AS first_key, count(*) AS n_members FROM orders",
    "fn_clusters_strict_builtin": "SELECT min(o_orderkey) AS first_key, count(*) AS n_members FROM orders GROUP BY substr(o_orderpriority, 1, 1) HAVING count(*) >= 2",
    "fn_canonical_pick": f"SELECT file, p_partkey FROM (SELECT {_FILE} AS file, p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY {_FILE}, p_partkey) AS rn FROM part) WHERE rn = 1",
    "fn_removals": "SELECT p_partkey FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS rn FROM part) WHERE rn > 1",
    "fn_cluster_index": """SELECT row_number() OVER (ORDER BY n_members DESC, first_key) - 1 AS cluster_index, first_key, n_members
        FROM (SELECT min(p_partkey) AS first_key, count(*) AS n_members FROM part GROUP BY p_size HAVING count(*) >= 2)""",
    "health_scores": """
WITH g AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2),
s AS (SELECT p_brand, sum(n)::BIGINT AS total, count(*) AS "unique", coalesce(sum(CASE WHEN n >= 2 THEN n END), 0)::BIGINT AS dup_members,
      coalesce(sum(CASE WHEN n >= 2 THEN n - 1 END), 0)::BIGINT AS extra FROM g GROUP BY 1)
SELECT *, greatest(0, round_even((1.0::DOUBLE - dup_members::DOUBLE / total) * 100, 0)::INT) AS health_cli, floor(100 * "unique" / greatest(total, 1))::INT AS health_ui,
  greatest(0, 100 - floor(extra::DOUBLE / total * 100)::INT) AS health_mcp,
  least(100, floor(100 * "unique" / greatest(total - extra, 1))::INT) AS health_after FROM s""",
    "health_walk_lines": 'SELECT count(*) AS total, 0::BIGINT AS "unique", 100 AS health_cli FROM lineitem JOIN orders ON o_orderkey = l_orderkey',
    "fn_ranked": "SELECT p_partkey, row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS position FROM part",
    "hash_diff": f"""{_HALVES}, x AS (SELECT key, max(p_partkey) AS label_a, count(*) AS n_a FROM a GROUP BY 1), y AS (SELECT key, max(p_partkey) AS label_b, count(*) AS n_b FROM b GROUP BY 1)
SELECT CASE WHEN n_b IS NULL THEN 'only_a' WHEN n_a IS NULL THEN 'only_b' ELSE 'common' END AS status, label_a, label_b, coalesce(n_a, 0) AS n_a, coalesce(n_b, 0) AS n_b FROM x FULL JOIN y USING (key)""",
    "hash_diff_ordered": f"""{_HALVES}, x AS (SELECT key, max(p_partkey) AS label_a FROM a GROUP BY 1), y AS (SELECT key, max(p_partkey) AS label_b FROM b GROUP BY 1)
SELECT row_number() OVER (ORDER BY key) - 1 AS position, key, CASE WHEN label_b IS NULL THEN 'only_a' WHEN label_a IS NULL THEN 'only_b' ELSE 'common' END AS status, label_a, label_b FROM x FULL JOIN y USING (key)""",
    "verify_missing_extra": f"""{_HALVES} SELECT problem, count(*) AS n FROM (
  SELECT DISTINCT key, 'missing' AS problem FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT DISTINCT key, 'extra' FROM b WHERE key NOT IN (SELECT key FROM a)) GROUP BY 1""",
    "index_probe": f"""{_HALVES}, i AS (SELECT key, count(*) AS n, min(p_partkey) AS f FROM a GROUP BY 1)
SELECT p_partkey, n IS NOT NULL AS found, coalesce(n, 0) AS n_places, f AS first_key FROM b LEFT JOIN i USING (key)""",
    "js_clusters": f"SELECT js_hash, min(k) AS first_key, count(*) AS n_members FROM ({_JS}) WHERE lang = 'js' GROUP BY 1 HAVING count(*) >= 2",
    "ts_equals_js": f"SELECT js_hash, count(*) AS n_members, count(DISTINCT lang) AS n_languages FROM ({_JS}) GROUP BY 1 HAVING count(DISTINCT lang) > 1",
    "universal_cross_language": f"""SELECT sha256('{{"universal_sir":"FUNC v_func ( v0 v1 ) {{ v2 = v0 ' || w || ' v1 RETURN v2 ADD NUM }}"}}') AS universal_hash, 2 * count(*) AS n_members, 2::BIGINT AS n_languages
FROM (SELECT ['ADD', 'SUB', 'MULT', 'DIV', 'MOD', NULL][(length(p_type) % 6 + 1)::INT] AS w FROM part) WHERE w IS NOT NULL GROUP BY w""",
}
