"""Queries of the general problems: skewed keys (4) and differences between two copies (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.operators.reconcile import reconcile
from codeweft.operators.skew import heavy_keys, skewed_key_stats
from codeweft.session import table

HEAVY_SHARE = 0.02


def _sources(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    occur = table(spark, d, "occur").select(
        F.col("semantic_hash").alias("hash_key"), "file", F.col("scanned_at").alias("seen_at"), "lineno"
    )
    roots = table(spark, d, "roots").select(
        F.col("sir_sha256").alias("hash_key"), "file", F.col("packed_at").alias("seen_at"), "lineno"
    )
    return [("occur", occur), ("roots", roots)]


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    (n1, x), (n2, y) = _sources(spark, d)
    return x.withColumn("src_table", F.lit(n1)).unionByName(y.withColumn("src_table", F.lit(n2)))


def _stats(spark: SparkSession, d: str) -> DataFrame:
    return skewed_key_stats(_tagged(spark, d), "hash_key", "file", ["seen_at", "file", "lineno"], ("src_table",))


def p4_keys(spark: SparkSession, d: str) -> DataFrame:
    return _stats(spark, d).select(
        "src_table",
        "hash_key",
        "n_occurrences",
        F.col("n_distinct").alias("n_files"),
        F.col("first.seen_at").alias("first_at"),
        F.col("first.file").alias("first_file"),
        F.col("first.lineno").alias("first_lineno"),
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    totals = None
    for name, df in _sources(spark, d):
        one = df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("src_table", F.lit(name))
        totals = one if totals is None else totals.unionByName(one)
    return heavy_keys(_stats(spark, d), totals, HEAVY_SHARE, "src_table").select("src_table", "hash_key")


FIELDS = {
    "root": "string",
    "file": "string",
    "qualname": "string",
    "lineno": "long",
    "sir_sha256": "string",
    "source_sha256": "string",
    "pack_id": "string",
    "packed_at": "timestamp_ntz",
}


def p6_diff(spark: SparkSession, d: str) -> DataFrame:
    out = reconcile(table(spark, d, "roots"), table(spark, d, "roots_mirror"), "occurrence_key", FIELDS)
    diff = (
        F.when(F.col("diff") == "missing_in_b", F.lit("missing_in_mirror"))
        .when(F.col("diff") == "missing_in_a", F.lit("missing_in_roots"))
        .otherwise(F.col("diff"))
    )
    return out.select("occurrence_key", diff.alias("diff"), F.col("value_a").alias("roots_value"), F.col("value_b").alias("mirror_value"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_diff(spark, d).select("occurrence_key", "diff")


QUERIES = {"p4_found": p4_found, "p4_keys": p4_keys, "p6_found": p6_found, "p6_diff": p6_diff}

_ROWS = """
SELECT 'occur' AS src_table, semantic_hash AS hash_key, file, scanned_at AS seen_at, lineno FROM occur
UNION ALL SELECT 'roots', sir_sha256, file, packed_at, lineno FROM roots
"""
_FIELD_SQL = "\nUNION ALL\n".join(
    f"SELECT occurrence_key, '{f}' AS diff, CAST(r.{f} AS VARCHAR) AS roots_value, CAST(m.{f} AS VARCHAR) AS mirror_value "
    f"FROM r JOIN m USING (occurrence_key) WHERE r.{f} IS DISTINCT FROM m.{f}"
    for f in FIELDS
    if f != "packed_at"
) + (
    "\nUNION ALL\nSELECT occurrence_key, 'packed_at', rtrim(rtrim(strftime(r.packed_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.'), "
    "rtrim(rtrim(strftime(m.packed_at, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.') "
    "FROM r JOIN m USING (occurrence_key) WHERE r.packed_at IS DISTINCT FROM m.packed_at"
)
_DIFF = f"""
WITH r AS (SELECT DISTINCT occurrence_key, {', '.join(FIELDS)} FROM roots),
     m AS (SELECT DISTINCT occurrence_key, {', '.join(FIELDS)} FROM roots_mirror)
SELECT occurrence_key, 'missing_in_mirror' AS diff, CAST(NULL AS VARCHAR) AS roots_value, CAST(NULL AS VARCHAR) AS mirror_value
FROM r ANTI JOIN m USING (occurrence_key)
UNION ALL SELECT occurrence_key, 'missing_in_roots', NULL, NULL FROM m ANTI JOIN r USING (occurrence_key)
UNION ALL {_FIELD_SQL}
"""
SQL = {
    "p4_found": f"""
WITH a AS ({_ROWS}), t AS (SELECT src_table, count(*) AS n FROM a GROUP BY 1)
SELECT src_table, hash_key FROM a JOIN t USING (src_table) WHERE hash_key IS NOT NULL
GROUP BY src_table, hash_key, n HAVING count(*) * 50 >= n""",
    "p4_keys": f"""
WITH a AS ({_ROWS}),
f AS (SELECT *, row_number() OVER (PARTITION BY src_table, hash_key
      ORDER BY seen_at NULLS FIRST, file NULLS FIRST, lineno NULLS FIRST) AS rn FROM a WHERE hash_key IS NOT NULL)
SELECT src_table, hash_key, count(*) AS n_occurrences, count(DISTINCT file) AS n_files,
  max(CASE WHEN rn = 1 THEN seen_at END) AS first_at, max(CASE WHEN rn = 1 THEN file END) AS first_file,
  max(CASE WHEN rn = 1 THEN lineno END) AS first_lineno
FROM f GROUP BY 1, 2""",
    "p6_found": f"SELECT occurrence_key, diff FROM ({_DIFF})",
    "p6_diff": _DIFF,
}
