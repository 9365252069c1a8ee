"""Queries over merges, restores, translations, reports and accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import sql
from codeweft.operators import clusters, diff, extract, merge, pack, reports, translate
from codeweft.plans.texts import text_sql
from codeweft.session import cut, shared_folder, spread, table
from codeweft.sources import generated

# --- merges ---------------------------------------------------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    return generated.part_files(spread(table(spark, d, "part")))


def _functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions of the files with their hashes; a file's text stays behind, for each function would have a copy."""
    return extract.hashed_functions(_files(spark, d), "content", keep=["path"])


def _places(spark: SparkSession, d: str) -> DataFrame:
    return cut(extract.hashed_functions(_files(spark, d), "content", source=False, keep=["path"]))


def _plan(spark: SparkSession, d: str) -> DataFrame:
    return merge.merge_plan(_places(spark, d), "sem_hash", "path", "name", "lineno")


def _counted(df: DataFrame) -> DataFrame:
    lines = F.split("new_source", "\n")
    return df.select("path", F.size(F.filter(lines, lambda x: x.startswith("def "))).alias("n_defs"), F.size(F.filter(lines, lambda x: x.startswith("from "))).alias("n_imports"))


def merge_apply(spark: SparkSession, d: str) -> DataFrame:
    """Files after a merge plan: the functions that are left and the imports that came."""
    return _counted(merge.apply_plan(_files(spark, d), _plan(spark, d)))


def merge_delete_only(spark: SparkSession, d: str) -> DataFrame:
    """The merge that keeps the first copy and only deletes the others."""
    return _counted(merge.apply_plan(_files(spark, d), _plan(spark, d), imports=False))


def merge_chosen(spark: SparkSession, d: str) -> DataFrame:
    """The merge that keeps the copies chosen: of each cluster the last one by key, if it isn't in a first file."""
    rows = _places(spark, d)
    last = rows.groupBy("sem_hash").agg(F.max_by(F.struct(F.col("path").alias("file"), "name", "lineno"), F.regexp_extract("name", r"\d+", 0).cast("long")).alias("c"))
    plan = merge.merge_plan(rows, "sem_hash", "path", "name", "lineno", keep=last.select("sem_hash", "c.*").withColumn("noise", F.lit(1)))
    return plan.select("file", "name", "canonical_name")


def merge_shared_module(spark: SparkSession, d: str) -> DataFrame:
    """The merge that moves the canonical functions to a module of their own."""
    return _counted(merge.apply_python(_files(spark, d), _plan(spark, d)))


def merge_utils(spark: SparkSession, d: str) -> DataFrame:
    return merge.utils_module(_files(spark, d), _plan(spark, d)).select("name", sql.source_hash(F.col("source")).alias("source_sha256"))


def merge_lines_saved(spark: SparkSession, d: str) -> DataFrame:
    files = cut(_files(spark, d))
    return merge.lines_saved(files, merge.apply_plan(files, _plan(spark, d), imports=False))


def js_merge(spark: SparkSession, d: str) -> DataFrame:
    """Script files after their copies went to utils.js."""
    files = cut(generated.js_files(spread(table(spark, d, "part"))))
    found = cut(extract.js_functions(files, "content", keep=["path"]).select("path", "name", "lineno", sql.js_hash(F.col("params"), F.col("body_src")).alias("h")))
    plan = merge.merge_plan(found, "h", "path", "name", "lineno")
    out = merge.apply_js(files, plan)
    lines = F.split("new_source", "\n")
    return out.select("path", F.size(F.filter(lines, lambda x: x.startswith("function "))).alias("n_functions"), F.size(F.filter(lines, lambda x: x.startswith("import {"))).alias("n_imports"))


# --- restores -------------------------------------------------------------------------------------------------------


def restored_whole_files(spark: SparkSession, d: str) -> DataFrame:
    files, _ = merge.restore_files(cut(_functions(spark, d)), "sem_hash", "path", "name", "lineno", "source")
    return files.select("path", "n_functions", sql.source_hash(F.col("content")).alias("content_sha256"))


def restored_utils(spark: SparkSession, d: str) -> DataFrame:
    # one aggregate reads the functions, so they aren't written first
    _, utils = merge.restore_files(_functions(spark, d), "sem_hash", "path", "name", "lineno", "source")
    return utils.select("name", sql.source_hash(F.col("source")).alias("source_sha256"))


def restored_archives(spark: SparkSession, d: str) -> DataFrame:
    """Restored files in archives; the archives together hold each file once."""
    files, _ = merge.restore_files(cut(_functions(spark, d)), "sem_hash", "path", "name", "lineno", "source")
    return reports.archives(files, "path", "content").agg(F.sum("n_files").alias("n_files"), F.count_if(F.substring("archive", 1, 2) != F.unhex(F.lit("504B"))).alias("n_bad"))


def _pack(spark: SparkSession, d: str) -> pack.Pack:
    rows = generated.python_parts(spread(table(spark, d, "part"))).withColumn("lineno", F.lit(1))
    return pack.pack_python(rows, "file", "name", "lineno", "code")


def pack_written(spark: SparkSession, d: str) -> DataFrame:
    """A pack written, compressed, read again, and every occurrence restored under its file name and hashed."""
    where = shared_folder(spark, "pack")
    _pack(spark, d).write(where)
    back = pack.restore_python(pack.documents_of(pack.Pack.read(spark, where)))
    name = sql.occurrence_filename(F.lit(7), F.col("file"), F.col("lineno"), F.col("qualname"), F.lit("00000000"))
    same = sql.sem_hash(F.col("restored_src")) == F.col("sir_sha256")
    return back.select("occurrence_key", name.alias("filename"), same.alias("same"), F.col("restored_src").startswith(F.concat(F.lit("def "), F.col("qualname"), F.lit("("))).alias("named"))


def pack_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Node counts of a store: nodes of the common form, and those that hang on a function's literal."""
    return _pack(spark, d).meta().select("unique_roots", "nodes")


def pack_namemaps(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences with their names."""
    p = _pack(spark, d)
    joined = p.roots.select("occurrence_key").join(p.namemaps, "occurrence_key", "left")
    first = F.get("functions", F.lit(0))
    return joined.select("occurrence_key", first["canon_func"].alias("canon"), first["orig_func"].alias("orig"), F.array_join(F.array_sort(F.map_values(first["canon_to_orig"])), ",").alias("names"))


# --- translations ---------------------------------------------------------------------------------------------------

_GOOD = "def f~k~(a):\n    return a + ~n~"
#: Answers of a translator: raw text, the text after cleaning, and what is wrong with it.
_ANSWERS = [
    ("```python\ndef f~k~(a):\n    return a + ~n~\n```", _GOOD, None),
    ("Sure, here it is:\ndef f~k~(a):\n    return a + ~n~", _GOOD, None),
    ("async def f~k~(a):\n    return a", "async def f~k~(a):\n    return a", None),
    ("x = ~n~", "x = ~n~", "No function definition found in translation"),
    ("def f~k~(a:\n    return a", "def f~k~(a:\n    return a", "SyntaxError"),
    ("   ", "", "Empty translation"),
]


def _answers(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    raw = F.coalesce(*[F.when(k % len(_ANSWERS) == i, generated._text(a[0], k=k, n=n)) for i, a in enumerate(_ANSWERS)])
    return spread(table(spark, d, "customer")).select("c_custkey", "c_nationkey", raw.alias("raw"))


def translation_checks(spark: SparkSession, d: str) -> DataFrame:
    """Raw answers cleaned and judged."""
    clean = sql.clean_translation(F.col("raw"))
    rows = _answers(spark, d).withColumn("clean", clean).withColumn("error", sql.translation_error(F.col("clean")))
    return rows.select("c_custkey", "clean", F.when(F.col("error").startswith("SyntaxError"), F.lit("SyntaxError")).otherwise(F.col("error")).alias("error"))


def class_translation_checks(spark: SparkSession, d: str) -> DataFrame:
    """Class answers judged in both ways: as a class, and as a class with methods."""
    k = F.col("c_custkey")
    forms = ["class A~k~:\n    def m(self):\n        pass", "class A~k~:\n    x = 1", "def f~k~():\n    pass"]
    text = F.coalesce(*[F.when(k % 3 == i, generated._text(f, k=k)) for i, f in enumerate(forms)])
    rows = spread(table(spark, d, "customer")).select("c_custkey", text.alias("t"))
    return rows.select("c_custkey", sql.translation_error(F.col("t"), "class").alias("as_class"), sql.translation_error(F.col("t"), "class_with_methods").alias("with_methods"))


def normalised_sources(spark: SparkSession, d: str) -> DataFrame:
    code = generated._text("\n\n    def f~k~(a):\n        return a\n  \n", k=F.col("c_custkey"))
    return spread(table(spark, d, "customer")).select("c_custkey", sql.normalised(code).alias("code"))


def part_backend(language: str, code: str, number: int) -> str:
    """A backend of its own mind: what it gives for a code depends on the number in it and on the call."""
    n = int(code)
    if n % 5 == 4 or (n % 5 == 3 and number == 0):
        return "no idea"
    body = f"return a + {n}" if n % 5 != 2 or number == 0 else f"return a - {n}"
    if n % 5 == 1 and number > 0:
        raise TimeoutError("no answer")
    return f"def f(a):\n    {body}"


def _translated(spark: SparkSession, d: str, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "part").select("p_partkey", F.lit("Java").alias("lang"), F.col("p_size").cast("string").alias("code"))
    return translate.translate(rows, "lang", "code", part_backend, cache)


def translated_functions(spark: SparkSession, d: str) -> DataFrame:
    """Confidence and hash groups of translated functions; those that failed have no text."""
    rows, _ = _translated(spark, d)
    return rows.select("p_partkey", "confidence", F.col("python_src").isNotNull().alias("has_text"))


def translated_usable(spark: SparkSession, d: str) -> DataFrame:
    rows, _ = _translated(spark, d)
    return translate.usable(rows).groupBy("hash1").agg(F.count(F.lit(1)).alias("n")).select("n")


def translation_cache(spark: SparkSession, d: str) -> DataFrame:
    """A second run over a kept cache: all but the results of low confidence are hits. A cleared cache has none."""
    where = shared_folder(spark, "translations")
    _, fresh = _translated(spark, d)
    translate.add_to_cache(fresh, where)
    again, _ = _translated(spark, d, translate.read_cache(spark, where))
    out = again.groupBy("confidence", "cache_hit").agg(F.count(F.lit(1)).alias("n"))
    out = cut(out)
    translate.clear_cache(spark, where)
    return out.unionByName(translate.read_cache(spark, where).groupBy("confidence").agg(F.lit(True).alias("cache_hit"), F.count(F.lit(1)).alias("n")))


def backend_probe(spark: SparkSession, d: str) -> DataFrame:
    found = translate.available({"recorded": translate.recorded_backend({("Java", "0"): ["x"]}), "none": translate.recorded_backend({})}, "Java", "0")
    return spark.createDataFrame(sorted(found.items()), "backend string, answers boolean")


# --- reports and accuracy -------------------------------------------------------------------------------------------


def _store(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ai_pack_store").select("store_id", "sir_sha256", "lang", "file", "name", "lineno", "original_src").distinct()


def translated_merge_summary(spark: SparkSession, d: str) -> DataFrame:
    summary, _ = merge.translated_report(_store(spark, d), "sir_sha256", "lang", "file", "name", "lineno")
    return summary


def translated_merge_clusters(spark: SparkSession, d: str) -> DataFrame:
    _, found = merge.translated_report(_store(spark, d), "sir_sha256", "lang", "file", "name", "lineno")
    return found.select("sir_sha256", "n_members", "n_languages", F.col("first.file").alias("first_file"))


def translated_merge_markdown(spark: SparkSession, d: str) -> DataFrame:
    rows = _store(spark, d).select("sir_sha256", "file", "lineno", "name", "lang", "store_id")
    members = reports.cluster_members(rows, "sir_sha256", ["file", "lineno", "name", "lang", "store_id"])
    return reports.markdown_lines(members, "sir_sha256", "name", "file", "lineno", "lang").select("cluster_index", "rank", "value")


def scan_report_json(spark: SparkSession, d: str) -> DataFrame:
    """The listing of a scan as written: lines in order, read again."""
    rows = table(spark, d, "hash_index").select("hash", "file", "lineno", "name").distinct()
    lines = reports.json_lines(reports.cluster_members(rows, "hash", ["file", "lineno", "name"]), "hash", ["file", "lineno", "name"])
    where = shared_folder(spark, "report")
    reports.write_lines(lines, ["cluster_index", "file", "lineno", "name"], where)
    return spark.read.text(where)


def scan_report_html(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hash_index").select("hash", F.concat(F.lit("<"), F.col("file"), F.lit(">")).alias("file"), "lineno", "name").distinct()
    members = reports.cluster_members(rows, "hash", ["file", "lineno", "name"])
    return reports.html_lines(members, "hash", "name", "file", "lineno").select("cluster_index", "rank", "value")


def code_previews(spark: SparkSession, d: str) -> DataFrame:
    return _store(spark, d).select("store_id", reports.preview(F.col("original_src")).alias("p500"), reports.preview(F.col("original_src"), 40).alias("p40"))


def duplicate_messages(spark: SparkSession, d: str) -> DataFrame:
    """What is said of incoming functions whose hash is in the index, of the first place it has there."""
    index = table(spark, d, "hash_index").select("hash", "file", "name", "lineno").distinct()
    probes = table(spark, d, "batch_functions").select("occ_id", "hash").distinct()
    out = diff.probe_index(probes, index, "hash", ["file", "name", "lineno"])
    return out.select("occ_id", reports.duplicate_message(F.when(F.col("found"), F.array("first_place")).otherwise(F.array().cast("array<struct<file:string,name:string,lineno:int>>"))).alias("message"))


def constructors_left_out(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("entry_id") % 3 == 0, F.initcap("name")).otherwise(F.col("name"))
    rows = table(spark, d, "hash_index").select("entry_id", name.alias("name")).distinct()
    return rows.filter(~sql.constructor(F.col("name")))


def truth_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of functions implied by clusters against known pairs: neighbours by key, in both orders of naming."""
    rows = generated.python_parts(spread(table(spark, d, "part"))).withColumn("h", sql.sem_hash(F.col("code")))
    k = F.col("p_partkey")
    name = lambda c: F.concat(F.lit("part_"), c.cast("string"))
    truth = rows.select(F.lit("f").alias("file_a"), name(k).alias("name_a"), F.lit("f").alias("file_b"), name(F.greatest(F.lit(1), k - k % 50)).alias("name_b")).filter("name_a <> name_b")
    return clusters.pairs_against_truth(rows.withColumn("file", F.lit("f")), "h", "file", "name", truth)


def hash_stability(spark: SparkSession, d: str) -> DataFrame:
    """Two translations of each function: those of every seventh differ, every eleventh has no second one."""
    k = F.col("p_partkey")
    rows = generated.python_parts(spread(table(spark, d, "part"))).withColumn("second", F.when(k % 11 == 0, F.lit("def (")).when(k % 7 == 0, F.replace("code", F.lit(" + "), F.lit(" - "))).otherwise(F.replace("code", F.lit("part_"), F.lit("p_"))))
    rows = rows.withColumns({"h1": sql.sem_hash(F.col("code")), "h2": sql.sem_hash(F.col("second"))})
    return clusters.stability(rows, "h1", "h2")


QUERIES = {
    f.__name__: f
    for f in (
        merge_apply, merge_delete_only, merge_chosen, merge_shared_module, merge_utils, merge_lines_saved, js_merge, restored_whole_files, restored_utils,
        restored_archives, pack_written, pack_nodes, pack_namemaps, translation_checks, class_translation_checks, normalised_sources, translated_functions,
        translated_usable, translation_cache, backend_probe, translated_merge_summary, translated_merge_clusters, translated_merge_markdown, scan_report_json,
        scan_report_html, code_previews, duplicate_messages, constructors_left_out, truth_pairs, hash_stability,
    )
}

_K = {"k": "p_partkey", "n": "p_size"}
_C = {"k": "c_custkey", "n": "c_nationkey"}
_CODE = text_sql("def part_~k~(a~k~, b~k~):\n    r~k~ = a~k~ * ~n~\n    if r~k~ > b~k~:\n        return r~k~\n    return b~k~ + r~k~", _K)
#: Functions with their file, line, and place in the cluster of their literal.
_F = f"""
f AS (SELECT *, 'src/' || replace(p_brand, '#', '_') || '/m' || (p_partkey % 7) || '.py' AS path, 'part_' || p_partkey AS name, {_CODE} AS code FROM part),
l AS (SELECT *, 6 * row_number() OVER (PARTITION BY path ORDER BY p_partkey) - 3 AS line FROM f),
w AS (SELECT *, count(*) OVER (PARTITION BY p_size) AS n, row_number() OVER c AS rn, first_value(path) OVER c AS cfile, first_value(name) OVER c AS cname, first_value(line) OVER c AS cline FROM l WINDOW c AS (PARTITION BY p_size ORDER BY path, line, name))"""
_J = """
j AS (SELECT 'js/' || replace(p_brand, '#', '_') || '.js' AS path, p_partkey, length(p_type) % 6 AS op FROM part),
i AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY p_partkey) AS line FROM j),
v AS (SELECT *, count(*) OVER (PARTITION BY op) AS n FROM i)"""
_MEMBERS = """
r AS (SELECT DISTINCT hash, file, lineno, name FROM hash_index WHERE hash IS NOT NULL),
c AS (SELECT hash, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, hash) - 1 AS cluster_index FROM r GROUP BY 1 HAVING count(*) >= 2)"""
_T = "t AS (SELECT DISTINCT store_id, sir_sha256, lang, file, name, lineno FROM ai_pack_store WHERE sir_sha256 IS NOT NULL)"
_LEVEL = "CASE p_size % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' WHEN 3 THEN 'HIGH' ELSE 'FAILED' END"


def _cases(i: int) -> str:
    return "CASE c_custkey % 6 " + " ".join(f"WHEN {j} THEN {'NULL' if a[i] is None else text_sql(a[i], _C)}" for j, a in enumerate(_ANSWERS)) + " END"


SQL = {
    "merge_apply": f"WITH {_F} SELECT path, count_if(rn = 1)::INT AS n_defs, count_if(rn > 1 AND cfile <> path)::INT AS n_imports FROM w GROUP BY 1 HAVING count_if(rn > 1) > 0",
    "merge_delete_only": f"WITH {_F} SELECT path, count_if(rn = 1)::INT AS n_defs, 0 AS n_imports FROM w GROUP BY 1 HAVING count_if(rn > 1) > 0",
    "merge_chosen": f"""WITH {_F}, q AS (SELECT p_size, max(p_partkey) AS k FROM w WHERE n > 1 GROUP BY 1)
SELECT path AS file, name, 'part_' || k AS canonical_name FROM w JOIN q USING (p_size) WHERE p_partkey <> k""",
    "merge_shared_module": f"WITH {_F} SELECT path, count_if(n = 1)::INT AS n_defs, count(DISTINCT CASE WHEN n > 1 THEN cname END)::INT AS n_imports FROM w GROUP BY 1 HAVING count_if(n > 1) > 0",
    "merge_utils": f"WITH {_F} SELECT name, sha256(code) AS source_sha256 FROM w WHERE rn = 1 AND n > 1",
    "merge_lines_saved": f"""WITH {_F}, g AS (SELECT path, count(*) AS a, count_if(rn = 1) AS b FROM w GROUP BY 1 HAVING count_if(rn > 1) > 0)
SELECT (sum(5 * a + 1))::BIGINT AS lines_before, (sum(5 * b + 1))::BIGINT AS lines_after, (5 * sum(a - b))::BIGINT AS saved FROM g""",
    "js_merge": f"WITH {_J} SELECT path, count_if(n = 1)::INT AS n_functions, count(DISTINCT CASE WHEN n > 1 THEN op END)::INT AS n_imports FROM v GROUP BY 1 HAVING count_if(n > 1) > 0",
    "restored_whole_files": f"""WITH {_F} SELECT path, count_if(n = 1)::INT AS n_functions,
  sha256(array_to_string(list_concat(CASE WHEN count_if(n > 1) > 0 THEN ['from utils import ' || array_to_string(list_sort(list(DISTINCT cname) FILTER (n > 1)), ', ')] ELSE [] END, coalesce(list(code ORDER BY line) FILTER (n = 1), [])), chr(10) || chr(10))) AS content_sha256
FROM w GROUP BY 1""",
    "restored_utils": f"WITH {_F} SELECT name, sha256(code) AS source_sha256 FROM w WHERE rn = 1 AND n > 1",
    "restored_archives": f"WITH {_F} SELECT count(DISTINCT path) AS n_files, 0::BIGINT AS n_bad FROM w",
    "pack_written": """SELECT 'src/' || replace(p_brand, '#', '_') || '/m' || (p_partkey % 7) || '.py::part_' || p_partkey || '::1' AS occurrence_key,
  '0007_src_' || replace(p_brand, '#', '_') || '_m' || (p_partkey % 7) || '.py_L1_part_' || p_partkey || '_00000000.py' AS filename, true AS same, true AS named FROM part""",
    # 8 nodes hang on the literal: it, its constant, product and assignment, the body's list, the function, the module's list, the module
    "pack_nodes": "SELECT count(DISTINCT p_size) AS unique_roots, 24 + 8 * count(DISTINCT p_size) AS nodes FROM part",
    "pack_namemaps": """SELECT 'src/' || replace(p_brand, '#', '_') || '/m' || (p_partkey % 7) || '.py::part_' || p_partkey || '::1' AS occurrence_key, 'f0' AS canon, 'part_' || p_partkey AS orig,
  'a' || p_partkey || ',b' || p_partkey || ',part_' || p_partkey || ',r' || p_partkey AS names FROM part""",
    "translation_checks": f"SELECT c_custkey, {_cases(1)} AS clean, {_cases(2)} AS error FROM customer",
    "class_translation_checks": """SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'No class definition found in translation' END AS as_class,
  CASE c_custkey % 3 WHEN 1 THEN 'Class has no methods' WHEN 2 THEN 'No class definition found in translation' END AS with_methods FROM customer""",
    "normalised_sources": "SELECT c_custkey, 'def f' || c_custkey || '(a):' || chr(10) || '    return a' AS code FROM customer",
    "translated_functions": f"SELECT p_partkey, {_LEVEL} AS confidence, p_size % 5 <> 4 AS has_text FROM part",
    "translated_usable": "SELECT count(*) AS n FROM part WHERE p_size % 5 <> 4 GROUP BY p_size",
    "translation_cache": f"SELECT {_LEVEL} AS confidence, p_size % 5 <> 2 AS cache_hit, count(*) AS n FROM part GROUP BY 1, 2",
    "backend_probe": "SELECT * FROM (VALUES ('none', false), ('recorded', true)) AS t(backend, answers)",
    "translated_merge_summary": f"""WITH {_T}, g AS (SELECT sir_sha256, count(*) AS n, count(DISTINCT lang) AS k FROM t GROUP BY 1),
s AS (SELECT sum(n)::BIGINT AS total, count(*) AS u, count_if(n >= 2)::BIGINT AS duplicate_clusters, count_if(n >= 2 AND k > 1)::BIGINT AS cross_language, coalesce(sum(CASE WHEN n >= 2 THEN n - 1 END), 0)::BIGINT AS extra FROM g)
SELECT total, duplicate_clusters, cross_language, floor(100 * u / greatest(total, 1))::INT AS health_before, least(100, floor(100 * u / greatest(total - extra, 1))::INT) AS health_after FROM s""",
    "translated_merge_clusters": f"WITH {_T} SELECT sir_sha256, count(*) AS n_members, count(DISTINCT lang) AS n_languages, min(file) AS first_file FROM t GROUP BY 1 HAVING count(*) >= 2",
    "translated_merge_markdown": f"""WITH {_T}, c AS (SELECT sir_sha256, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, sir_sha256) - 1 AS cluster_index FROM t GROUP BY 1 HAVING count(*) >= 2)
SELECT cluster_index, 0 AS rank, '## Cluster ' || substr(sir_sha256, 1, 16) || '... (' || n || ' duplicates)' AS value FROM c
UNION ALL SELECT cluster_index, 1, '- `' || coalesce(name, '') || '` in `' || file || '` (line ' || lineno || ') [' || coalesce(lang, '') || ']' FROM t JOIN c USING (sir_sha256)""",
    "scan_report_json": f"""WITH {_MEMBERS} SELECT '{{"count":' || n || ',"file":"' || file || '","hash":"' || substr(hash, 1, 16) || '","lineno":' || lineno || ',"name":"' || name || '"}}' AS value FROM r JOIN c USING (hash)""",
    "scan_report_html": f"""WITH {_MEMBERS} SELECT cluster_index, 0 AS rank, '<h3>' || substr(hash, 1, 16) || ' (' || n || ')</h3>' AS value FROM c
UNION ALL SELECT cluster_index, 1, '<li><code>' || name || '</code> in <code>&lt;' || file || '&gt;</code> line ' || lineno || '</li>' FROM r JOIN c USING (hash)""",
    "code_previews": "SELECT store_id, substr(original_src, 1, 500) AS p500, substr(original_src, 1, 40) AS p40 FROM (SELECT DISTINCT store_id, sir_sha256, lang, file, name, lineno, original_src FROM ai_pack_store)",
    "duplicate_messages": f"""WITH i AS (SELECT hash, min((file, name, lineno)) AS p FROM (SELECT DISTINCT hash, file, name, lineno FROM hash_index WHERE hash IS NOT NULL) GROUP BY 1), b AS (SELECT DISTINCT occ_id, hash FROM batch_functions)
SELECT occ_id, CASE WHEN p IS NOT NULL THEN '{reports.FOUND_ALREADY}' || chr(10) || '  → ' || p[2] || '() in ' || p[1] || ' at line ' || p[3] || chr(10) || '{reports.REUSE}' END AS message FROM b LEFT JOIN i USING (hash)""",
    "constructors_left_out": """SELECT DISTINCT entry_id, name FROM (SELECT entry_id, name FROM hash_index WHERE entry_id % 3 <> 0 OR name IS NULL) WHERE name IS NULL OR NOT regexp_matches(substr(name, 1, 1), '\\p{Lu}')
UNION SELECT entry_id, name FROM hash_index WHERE entry_id % 3 = 0 AND NOT regexp_matches(upper(substr(name, 1, 1)), '\\p{Lu}')""",
    "truth_pairs": """
WITH p AS (SELECT p_partkey AS a, greatest(1, p_partkey - p_partkey % 50) AS b FROM part), k AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM p WHERE a <> b),
h AS (SELECT count(*) AS tp FROM k JOIN part x ON x.p_partkey = k.a JOIN part y ON y.p_partkey = k.b WHERE x.p_size = y.p_size),
g AS (SELECT sum(n * (n - 1) / 2)::BIGINT AS detected FROM (SELECT count(*) AS n FROM part GROUP BY p_size)), s AS (SELECT tp, detected - tp AS fp, (SELECT count(*) FROM k) - tp AS fn FROM h, g)
SELECT tp, fp, fn, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS "precision", CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS recall FROM s""",
    "hash_stability": """WITH s AS (SELECT count_if(p_partkey % 11 <> 0 AND p_partkey % 7 <> 0)::BIGINT AS stable, count_if(p_partkey % 11 <> 0 AND p_partkey % 7 = 0)::BIGINT AS unstable FROM part)
SELECT stable, unstable, round_even(stable * 100 / (stable + unstable), 0)::INT AS stability FROM s""",
}
