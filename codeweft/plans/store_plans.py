"""Queries over stored fingerprints, packs, merges, translations, files and texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import sql
from codeweft.operators import clusters, diff, extract, merge, pack, translate
from codeweft.operators.ranking import global_rank
from codeweft.session import spread, table
from codeweft.sources import files, generated


def occurrence_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of stored occurrences, redelivered rows once."""
    rows = table(spark, d, "occur").select("occur_id", "semantic_hash", "file", "lineno").distinct()
    return clusters.clusters(rows, "semantic_hash", ["file", "lineno", "occur_id"]).select("semantic_hash", "n_members", F.col("first.file").alias("first_file"))


def occurrence_health(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "occur").select("occur_id", "semantic_hash", "repo").distinct()
    return clusters.health_report(rows, "semantic_hash", ["repo"])


def _indexed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hash_index").select("hash", "file", "name", "lineno").distinct()


def merge_plan(spark: SparkSession, d: str) -> DataFrame:
    out = merge.merge_plan(_indexed(spark, d), "hash", "file", "name", "lineno")
    return out.select("cluster_index", "hash", "file", "name", "lineno", "canonical_file", "canonical_name", "canonical_lineno", "module", "import_statement")


def pack_meta(spark: SparkSession, d: str) -> DataFrame:
    rows = generated.python_parts(spread(table(spark, d, "part"))).withColumn("lineno", F.lit(1))
    return pack.pack_python(rows, "file", "name", "lineno", "code").meta().select("functions", "unique_roots", "namemaps")


def pack_restore(spark: SparkSession, d: str) -> DataFrame:
    """Restored functions whose hash differs from the packed one, and whose names came back: none and all."""
    rows = generated.python_parts(spread(table(spark, d, "part"))).withColumn("lineno", F.lit(1))
    docs = extract.documents(rows.select("name", "code"), "code")
    back = pack.restore_python(docs).withColumn("again", sql.sem_hash(F.col("restored_src")))
    return back.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("again") != F.col("sir_sha256")).alias("n_differ"), F.count_if(F.col("restored_src").contains(F.col("name"))).alias("n_named")
    )


def pack_js_store(spark: SparkSession, d: str) -> DataFrame:
    found = extract.js_functions(generated.js_parts(spread(table(spark, d, "part"))), "code")
    hashed = found.withColumn("sir_sha256", sql.js_hash(F.col("params"), F.col("body_src")))
    return pack.first_store(hashed.withColumn("params_count", F.size("params")), "sir_sha256", ["p_partkey"], ["params_count", "body_src"]).select("params_count", "body_src")


def pack_ai_store(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ai_pack_store").select("store_id", "sir_sha256", "lang", "confidence").distinct()
    return pack.first_store(rows, "sir_sha256", ["store_id"], ["store_id", "lang"])


def pack_counts(spark: SparkSession, d: str) -> DataFrame:
    return pack.pack_counts(table(spark, d, "roots").select("occurrence_key", "sir_sha256").distinct(), "sir_sha256")


def restore_skip_seen_file(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "roots").select("file", "sir_sha256", "lineno", "occurrence_key").distinct().filter("sir_sha256 is not null")
    return clusters.keep_first(rows, ["file", "sir_sha256"], ["lineno", "occurrence_key"]).select("occurrence_key")


def restore_skip_seen_global(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "roots").select("file", "sir_sha256", "lineno", "occurrence_key").distinct().filter("sir_sha256 is not null")
    return clusters.keep_first(rows, ["sir_sha256"], ["file", "lineno", "occurrence_key"]).select("occurrence_key")


def occurrence_list(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "roots").select("root", "file", "qualname", "lineno", "occurrence_key").distinct()
    ranked = global_rank(rows, [F.col("occurrence_key")], "position")
    name = sql.occurrence_filename(F.col("position"), F.col("file"), F.col("lineno"), F.coalesce("qualname", F.lit("")), F.col("root"))
    return ranked.select("position", "occurrence_key", name.alias("filename"))


def restored_files(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ai_pack_store").select("store_id", "repo", "file", "lineno", "original_src").distinct()
    return pack.restore_text(rows.withColumn("path", F.concat_ws("/", "repo", "file")), "path", "lineno", "original_src").select("path", "n_functions", F.length("content").alias("n_chars"))


def bundle_size(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ai_pack_store").select("store_id", "original_src", "python_src").distinct()
    return pack.bundle_size(rows, "original_src", "python_src")


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", sql.cache_key(F.col("lang"), F.col("text")).alias("cache_key"))


def cache_hits_misses(spark: SparkSession, d: str) -> DataFrame:
    """Functions of incoming batches against those accepted before, by name and code."""
    wanted = table(spark, d, "batch_functions").select("occ_id", sql.cache_key(F.col("name"), F.col("code")).alias("cache_key")).distinct()
    known = table(spark, d, "hash_index").select(sql.cache_key(F.col("name"), F.col("code")).alias("cache_key")).distinct()
    hits, misses = diff.cache_probe(wanted, known, ["cache_key"])
    return hits.select("occ_id", F.lit("hit").alias("status")).unionByName(misses.select("occ_id", F.lit("miss").alias("status")))


def confidence_histogram(spark: SparkSession, d: str) -> DataFrame:
    return translate.confidence_counts(table(spark, d, "ai_pack_store").select("store_id", "confidence").distinct(), "confidence")


def confidence_state(spark: SparkSession, d: str) -> DataFrame:
    """The state machine over two translations told by the columns of the store."""
    rows = table(spark, d, "ai_pack_store").select("store_id", "python_src", "sir_sha256", "confidence").distinct()
    level = translate.confidence(F.length("python_src") > 0, F.col("sir_sha256"), F.col("confidence") != "FAILED", F.when(F.col("confidence") == "HIGH", F.col("sir_sha256")).otherwise(F.lit("other")))
    return rows.select("store_id", level.alias("level"))


def nonblank_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", sql.nonblank_lines(F.col("text")).alias("n_lines"))


def classifier_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Equal hash as a forecast of equal code, over stored functions with both."""
    rows = table(spark, d, "batch_functions").select("occ_id", "hash", "code").distinct()
    known = table(spark, d, "hash_index")
    by_hash = known.filter("hash is not null").select("hash").distinct().withColumn("a", F.lit(True))
    by_code = known.filter("code is not null").select("code").distinct().withColumn("e", F.lit(True))
    return clusters.classification_metrics(rows.join(by_hash, "hash", "left").join(by_code, "code", "left"), "e", "a")


def _files(spark: SparkSession, d: str) -> DataFrame:
    return generated.customer_files(table(spark, d, "customer"))


IGNORED = ["node_modules", "dist/", "test_"]


def file_ignore_paths(spark: SparkSession, d: str) -> DataFrame:
    return files.ignore_paths(_files(spark, d), "path", files.parse_ignore([*IGNORED, "", "# comment"])).select("path")


def fn_ignore_names(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "roots").select("occurrence_key", "qualname").distinct()
    return files.ignore_names(rows, "qualname", ["drain_prime", "sort_dusky_invoice", "align_dusky"]).select("occurrence_key")


def file_language(spark: SparkSession, d: str) -> DataFrame:
    ext = sql.extension(F.col("path"))
    return _files(spark, d).select("path", ext.alias("ext"), files.language_of(ext).alias("lang"), files.class_language_of(ext).alias("class_lang"), files.family_of(ext).alias("family"))


def file_walk_pruned(spark: SparkSession, d: str) -> DataFrame:
    return files.prune_directories(_files(spark, d), "path", files.JS_PRUNED).select("path")


def index_walk(spark: SparkSession, d: str) -> DataFrame:
    return files.index_files(_files(spark, d), "path").agg(F.count(F.lit(1)).alias("files_scanned"), F.count_if("indexed").alias("files_indexed"))


def remote_listing(spark: SparkSession, d: str) -> DataFrame:
    return files.remote_listing(_files(spark, d), [".py", ".js", ".tsx"]).select("path", "size")


def repo_addresses(spark: SparkSession, d: str) -> DataFrame:
    url = F.concat(F.lit("https://github.com/o"), F.col("c_nationkey").cast("string"), F.lit("/r"), F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, F.lit("/tree/dev")).otherwise(F.lit("")))
    return table(spark, d, "customer").select("c_custkey", sql.repo_parts(url).alias("p")).select("c_custkey", "p.owner", "p.repo", "p.branch")


def names_and_imports(spark: SparkSession, d: str) -> DataFrame:
    rows = _indexed(spark, d)
    module = sql.module_name(F.col("file"))
    return rows.select(
        "file", "name", "lineno", sql.occurrence_key(F.col("file"), F.col("name"), F.col("lineno")).alias("occurrence_key"),
        sql.diff_label(F.col("file"), F.col("name"), F.col("lineno")).alias("label"), module.alias("module"),
        sql.import_statement(module, F.col("name"), F.lit("x")).alias("import_statement"), sql.display_hash(F.col("hash")).alias("short_hash"), sql.safe_slug(F.col("file")).alias("slug"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        occurrence_clusters, occurrence_health, merge_plan, pack_meta, pack_restore, pack_js_store, pack_ai_store, pack_counts,
        restore_skip_seen_file, restore_skip_seen_global, occurrence_list, restored_files, bundle_size, cache_keys, cache_hits_misses,
        confidence_histogram, confidence_state, nonblank_lines, classifier_metrics,
        file_ignore_paths, fn_ignore_names, file_language, file_walk_pruned, index_walk, remote_listing, repo_addresses, names_and_imports,
       
    )
}

_FILES = """(SELECT *, folder || '/' || name || ext AS path FROM (SELECT c_custkey,
  ['.py', '.js', '.tsx', '.java', '.rs', '.H', '.txt', '.cpp', '.fsx', ''][(c_custkey % 10 + 1)::INT] AS ext,
  ['src', 'node_modules', 'lib/dist', '.cache', 'tests', 'app/build/x', 'vendor', 'pkg'][(c_nationkey % 8 + 1)::INT] AS folder,
  CASE WHEN c_custkey % 11 = 0 THEN 'test_' ELSE 'c' END || c_custkey AS name, (c_custkey * 97)::BIGINT AS size,
  CASE WHEN c_custkey % 13 = 0 THEN 'tree' ELSE 'blob' END AS type FROM customer))"""
_KEY = "substr(sha256({0} || '::' || {1}), 1, 32)"
_MODULE = "replace(replace(regexp_replace({0}, '\\.py$', ''), '/', '.'), '\\', '.')"
_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
_SEEN = r"[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SLUG = r"[^\p{L}\p{N}_.\-]"
SQL = {
    "occurrence_clusters": """WITH o AS (SELECT DISTINCT occur_id, semantic_hash, file, lineno FROM occur WHERE semantic_hash IS NOT NULL)
SELECT semantic_hash, count(*) AS n_members, min(file) AS first_file FROM o GROUP BY 1 HAVING count(*) >= 2""",
    "occurrence_health": """
WITH o AS (SELECT DISTINCT occur_id, semantic_hash, repo FROM occur WHERE semantic_hash IS NOT NULL), g AS (SELECT repo, semantic_hash, count(*) AS n FROM o GROUP BY 1, 2),
s AS (SELECT repo, sum(n)::BIGINT AS total, count(*) AS "unique", coalesce(sum(CASE WHEN n >= 2 THEN n END), 0)::BIGINT AS dup_members, coalesce(sum(CASE WHEN n >= 2 THEN n - 1 END), 0)::BIGINT AS extra FROM g GROUP BY 1)
SELECT *, greatest(0, round_even((1.0::DOUBLE - dup_members::DOUBLE / total) * 100, 0)::INT) AS health_cli, floor(100 * "unique" / greatest(total, 1))::INT AS health_ui,
  greatest(0, 100 - floor(extra::DOUBLE / total * 100)::INT) AS health_mcp, least(100, floor(100 * "unique" / greatest(total - extra, 1))::INT) AS health_after FROM s""",
    "merge_plan": f"""
WITH r AS (SELECT DISTINCT hash, file, name, lineno FROM hash_index WHERE hash IS NOT NULL),
w AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY file, lineno, name) AS rn, count(*) OVER (PARTITION BY hash) AS n FROM r),
c AS (SELECT hash, file AS canonical_file, name AS canonical_name, lineno AS canonical_lineno, row_number() OVER (ORDER BY n DESC, file, lineno, name, hash) - 1 AS cluster_index,
      {_MODULE.format('file')} AS module FROM w WHERE rn = 1 AND n >= 2)
SELECT cluster_index, hash, file, name, lineno, canonical_file, canonical_name, canonical_lineno, module,
  'from ' || module || ' import ' || canonical_name || CASE WHEN canonical_name = name THEN '' ELSE ' as ' || name END AS import_statement
FROM w JOIN c USING (hash) WHERE rn > 1""",
    "pack_meta": "SELECT count(*) AS functions, count(DISTINCT p_size) AS unique_roots, count(*) AS namemaps FROM part",
    "pack_restore": "SELECT count(*) AS n, 0::BIGINT AS n_differ, count(*) AS n_named FROM part",
    "pack_js_store": """SELECT 2 AS params_count, '{ const r' || k || ' = a' || k || ' ' || op || ' b' || k || ' ; return r' || k || ' + ' || p_size || ' ; }' AS body_src FROM (
  SELECT p_partkey AS k, p_size, ['+', '-', '*', '/', '%', '&'][(length(p_type) % 6 + 1)::INT] AS op, row_number() OVER (PARTITION BY length(p_type) % 6 ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1""",
    "pack_ai_store": "SELECT sir_sha256, store_id, lang FROM (SELECT DISTINCT sir_sha256, store_id, lang, min(store_id) OVER (PARTITION BY sir_sha256) AS f FROM ai_pack_store WHERE sir_sha256 IS NOT NULL) WHERE store_id = f",
    "pack_counts": 'SELECT count(sir_sha256) AS total, count(DISTINCT sir_sha256) AS "unique", count(sir_sha256) - count(DISTINCT sir_sha256) AS duplicates FROM (SELECT DISTINCT occurrence_key, sir_sha256 FROM roots)',
    "restore_skip_seen_file": "SELECT occurrence_key FROM (SELECT occurrence_key, row_number() OVER (PARTITION BY file, sir_sha256 ORDER BY lineno NULLS FIRST, occurrence_key) AS rn FROM (SELECT DISTINCT file, sir_sha256, lineno, occurrence_key FROM roots) WHERE sir_sha256 IS NOT NULL) WHERE rn = 1",
    "restore_skip_seen_global": "SELECT occurrence_key FROM (SELECT occurrence_key, row_number() OVER (PARTITION BY sir_sha256 ORDER BY file NULLS FIRST, lineno NULLS FIRST, occurrence_key) AS rn FROM (SELECT DISTINCT file, sir_sha256, lineno, occurrence_key FROM roots) WHERE sir_sha256 IS NOT NULL) WHERE rn = 1",
    "occurrence_list": rf"""SELECT position, occurrence_key, format('{{:04d}}_{{}}_L{{}}_{{}}_{{}}.py', position, regexp_replace(file, '{_SLUG}', '_', 'g'), lineno, regexp_replace(coalesce(qualname, ''), '{_SLUG}', '_', 'g'), substr(root, 1, 8)) AS filename
FROM (SELECT *, row_number() OVER (ORDER BY occurrence_key) - 1 AS position FROM (SELECT DISTINCT root, file, qualname, lineno, occurrence_key FROM roots))""",
    "restored_files": """SELECT concat_ws('/', repo, file) AS path, count(*)::INT AS n_functions, (coalesce(sum(length(original_src)), 0) + 2 * (greatest(count(original_src), 1) - 1))::INT AS n_chars
FROM (SELECT DISTINCT store_id, repo, file, lineno, original_src FROM ai_pack_store) GROUP BY 1""",
    "bundle_size": """SELECT source_bytes, stored_bytes, CASE WHEN source_bytes = 0 THEN 0.0 ELSE stored_bytes / source_bytes END AS ratio FROM (
  SELECT coalesce(sum(strlen(original_src)), 0)::BIGINT AS source_bytes, coalesce(sum(strlen(python_src)), 0)::BIGINT AS stored_bytes FROM (SELECT DISTINCT store_id, original_src, python_src FROM ai_pack_store))""",
    "cache_keys": f"SELECT doc_id, {_KEY.format('lang', 'text')} AS cache_key FROM documents",
    "cache_hits_misses": f"""WITH k AS (SELECT {_KEY.format('name', 'code')} AS c FROM hash_index), w AS (SELECT DISTINCT occ_id, {_KEY.format('name', 'code')} AS c FROM batch_functions)
SELECT occ_id, CASE WHEN c IN (SELECT c FROM k WHERE c IS NOT NULL) THEN 'hit' ELSE 'miss' END AS status FROM w""",
    "confidence_histogram": "SELECT coalesce(confidence, 'MEDIUM') AS confidence, count(*) AS n FROM (SELECT DISTINCT store_id, confidence FROM ai_pack_store) GROUP BY 1",
    "confidence_state": """SELECT store_id, CASE WHEN NOT coalesce(length(python_src) > 0, false) THEN 'FAILED' WHEN coalesce(confidence <> 'FAILED', false) AND sir_sha256 IS NOT NULL
  THEN CASE WHEN confidence = 'HIGH' THEN 'HIGH' ELSE 'LOW' END ELSE 'MEDIUM' END AS level FROM (SELECT DISTINCT store_id, python_src, sir_sha256, confidence FROM ai_pack_store)""",
    "nonblank_lines": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN len(list_filter(regexp_split_to_array(text, '{_END}'), lambda x: regexp_matches(x, '{_SEEN}')))::INT END AS n_lines FROM documents",
    "classifier_metrics": """
WITH b AS (SELECT DISTINCT occ_id, hash, code FROM batch_functions),
f AS (SELECT coalesce(hash IN (SELECT hash FROM hash_index WHERE hash IS NOT NULL), false) AS a, coalesce(code IN (SELECT code FROM hash_index WHERE code IS NOT NULL), false) AS e FROM b),
c AS (SELECT count_if(e AND a)::BIGINT AS tp, count_if(NOT e AND NOT a)::BIGINT AS tn, count_if(NOT e AND a)::BIGINT AS fp, count_if(e AND NOT a)::BIGINT AS fn FROM f),
s AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall, (tp + tn) / (tp + tn + fp + fn) AS accuracy FROM c)
SELECT *, CASE WHEN "precision" + recall = 0 THEN 0.0 ELSE 2 * "precision" * recall / ("precision" + recall) END AS f1 FROM s""",
    "file_ignore_paths": f"SELECT path FROM {_FILES} WHERE NOT (contains(path, 'node_modules') OR contains(path, 'dist/') OR contains(path, 'test_'))",
    "fn_ignore_names": "SELECT occurrence_key FROM (SELECT DISTINCT occurrence_key, qualname FROM roots) WHERE qualname IS NULL OR string_split(qualname, '.')[-1] NOT IN ('drain_prime', 'sort_dusky_invoice', 'align_dusky')",
    "file_language": f"""SELECT path, ext, CASE lower(ext) WHEN '.py' THEN 'Python' WHEN '.js' THEN 'JavaScript' WHEN '.tsx' THEN 'TypeScript' WHEN '.java' THEN 'Java' WHEN '.rs' THEN 'Rust' WHEN '.h' THEN 'C/C++ header' WHEN '.cpp' THEN 'C++' WHEN '.fsx' THEN 'F#' END AS lang,
  CASE lower(ext) WHEN '.java' THEN 'Java' WHEN '.rs' THEN 'Rust' WHEN '.h' THEN 'C++' WHEN '.cpp' THEN 'C++' END AS class_lang,
  CASE WHEN ext = '.py' THEN 'python' WHEN ext IN ('.js', '.tsx') THEN 'js' WHEN ext IN ('.java', '.rs', '.cpp', '.fsx') THEN 'translated' END AS family FROM {_FILES}""",
    "file_walk_pruned": f"SELECT path FROM {_FILES} WHERE folder NOT IN ('node_modules', 'lib/dist', '.cache', 'app/build/x')",
    "index_walk": f"SELECT count(*) AS files_scanned, count_if(NOT starts_with(name, 'test_'))::BIGINT AS files_indexed FROM {_FILES} WHERE ext = '.py' AND folder NOT IN ('node_modules', 'lib/dist', 'app/build/x')",
    "remote_listing": f"SELECT path, size FROM {_FILES} WHERE type = 'blob' AND ext IN ('.py', '.js', '.tsx') AND size < 500000 AND folder NOT IN ('node_modules', 'lib/dist', 'app/build/x')",
    "repo_addresses": "SELECT c_custkey, 'o' || c_nationkey AS owner, 'r' || c_custkey AS repo, CASE WHEN c_custkey % 3 = 0 THEN 'dev' END AS branch FROM customer",
    "names_and_imports": rf"""SELECT file, name, lineno, file || '::' || name || '::' || lineno AS occurrence_key, file || '::' || name || '::L' || lineno AS label, {_MODULE.format('file')} AS module,
  'from ' || {_MODULE.format('file')} || ' import ' || name || CASE WHEN name = 'x' THEN '' ELSE ' as x' END AS import_statement, substr(hash, 1, 16) AS short_hash, regexp_replace(file, '{_SLUG}', '_', 'g') AS slug
FROM (SELECT DISTINCT hash, file, name, lineno FROM hash_index)""",
}
