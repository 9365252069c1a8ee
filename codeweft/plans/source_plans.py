"""Queries over sources of many languages, files, caches, streams and registered functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import pycanon, sql
from codeweft.operators import clusters, extract, pack, scan
from codeweft.plans.texts import block_sql, text_sql
from codeweft.session import shared_folder, spread, table
from codeweft.sources import files, generated
from codeweft.streaming import counts


def _blocks(spark: SparkSession, d: str, blocks: list[tuple]) -> DataFrame:
    return generated.customer_blocks(spread(table(spark, d, "customer")), blocks)


def raw_functions_languages(spark: SparkSession, d: str) -> DataFrame:
    out = extract.raw_functions(_blocks(spark, d, generated.FUNCTION_BLOCKS), "code", "language")
    return out.select("c_custkey", "name", "lineno", sql.source_hash(F.col("source")).alias("source_sha256"))


def raw_functions_proper(spark: SparkSession, d: str) -> DataFrame:
    """Languages told apart as they should be: Ruby blocks have their lines, Scala has a head of its own."""
    out = extract.raw_functions(_blocks(spark, d, generated.FUNCTION_BLOCKS), "code", "language", quirks=False)
    return out.filter(F.col("language").isin("Ruby", "Scala")).select("c_custkey", "name", "lineno")


def raw_classes_languages(spark: SparkSession, d: str) -> DataFrame:
    out = extract.raw_classes(_blocks(spark, d, generated.CLASS_BLOCKS), "code", "language")
    return out.select("c_custkey", "name", "lineno", sql.source_hash(F.col("source")).alias("source_sha256"))


def plain_classes_languages(spark: SparkSession, d: str) -> DataFrame:
    out = extract.raw_classes(_blocks(spark, d, generated.CLASS_BLOCKS), "code", "language", plain=True)
    return out.select("c_custkey", "name", "lineno", sql.source_hash(F.col("source")).alias("source_sha256"))


_CLASS_TAIL = "\nclass C~k~:\n    def m(self):\n        def inner(x):\n            return x + ~n~\n        return inner\n"


def _with_class(spark: SparkSession, d: str) -> DataFrame:
    rows = generated.python_parts(spread(table(spark, d, "part"))).drop("name")
    return rows.withColumn("code", F.concat("code", generated._text(_CLASS_TAIL, k=F.col("p_partkey"), n=F.col("p_size"))))


def python_sources(spark: SparkSession, d: str) -> DataFrame:
    """Top-level functions and methods with the digest of their sources."""
    out = extract.python_functions(_with_class(spark, d), "code")
    return out.select("p_partkey", "name", "lineno", sql.source_hash(F.col("source")).alias("source_sha256"))


def python_sources_broken(spark: SparkSession, d: str) -> DataFrame:
    """Sources that don't parse give nothing, the others all they have."""
    rows = _with_class(spark, d).withColumn("code", F.when(F.col("p_partkey") % 3 == 0, F.concat("code", F.lit("def ("))).otherwise(F.col("code")))
    return extract.python_functions(rows, "code").groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter("name not like 'part%' and name not like 'C%'").unionByName(
        extract.python_functions(rows, "code").agg(F.lit("all").alias("name"), F.count(F.lit(1)).alias("n"))
    )


def walk_segments(spark: SparkSession, d: str) -> DataFrame:
    """Functions at any depth by their segments, so that methods and inner functions have hashes."""
    out = extract.python_functions(_with_class(spark, d), "code", "walk_segment").withColumn("h", sql.sem_hash(F.col("source")))
    return out.groupBy("name", "lineno").agg(F.count("h").alias("n_hashed"), F.count_distinct("h").alias("n_distinct")).filter("name in ('m', 'inner')")


def find_functions(spark: SparkSession, d: str) -> DataFrame:
    rows = _with_class(spark, d)
    wanted = F.concat(F.lit("part_"), (F.col("p_partkey") + F.when(F.col("p_partkey") % 4 == 0, 1).otherwise(0)).cast("string"))
    return rows.select("p_partkey", sql.source_hash(sql.find_function(F.col("code"), wanted)).alias("source_sha256"))


def _tree(spark: SparkSession, d: str) -> DataFrame:
    """A mixed tree: a Python, a JavaScript and a text file for each part, a TypeScript file for each supplier."""
    part = spread(table(spark, d, "part"))
    name = lambda col, ext: F.concat(F.lit("src/f"), F.col(col).cast("string"), F.lit(ext)).alias("path")
    py = generated.python_parts(part).select(name("p_partkey", ".py"), "code")
    js = generated.js_parts(part).select(name("p_partkey", ".js"), "code")
    txt = generated.js_parts(part).select(name("p_partkey", ".txt"), "code")
    ts = generated.ts_suppliers(spread(table(spark, d, "supplier"))).select(name("s_suppkey", ".TS"), "code")
    return py.unionByName(js).unionByName(txt).unionByName(ts)


def mixed_scan(spark: SparkSession, d: str) -> DataFrame:
    found = scan.mixed_functions(_tree(spark, d), "code", "path")
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n_functions"), F.count_distinct("sem_hash").alias("n_hashes"))


def mixed_scan_summary(spark: SparkSession, d: str) -> DataFrame:
    return scan.scan_summary(scan.mixed_functions(_tree(spark, d), "code", "path"))


_CLASS_CODE = "class T~k~ {\n  int f(int a) { return a + ~n~; }\n}\n"


def echo_backend(language: str, code: str, number: int) -> str:
    """A backend that turns the one class form of this query into Python, in a fence and with talk around it."""
    name, n = code.split()[1], code.split("+ ")[1].split(";")[0]
    return f"Here it is:\n```python\nclass {name}:\n    def f(self, a):\n        return a + {n}\n```"


def mixed_classes(spark: SparkSession, d: str) -> DataFrame:
    """Classes of Python files and, by translation, of Java and Kotlin files; other files have none."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".java", ".kt", ".py", ".txt")]), (k % 4 + 1).cast("int"))
    python = generated._text("class T~k~:\n    def f(self, b):\n        return b + ~n~\n", k=k, n=n)
    code = F.when(k % 4 == 2, python).otherwise(generated._text(_CLASS_CODE, k=k, n=n))
    rows = spread(table(spark, d, "customer")).select("c_custkey", "c_nationkey", F.concat(F.lit("t"), k.cast("string"), ext).alias("path"), code.alias("content"))
    found = scan.mixed_classes(rows, "content", "path", echo_backend)
    return found.groupBy("class_hash").agg(
        F.min("c_nationkey").alias("c_nationkey"), F.count(F.lit(1)).alias("n"), F.count_if("ai_translated").alias("n_translated"), F.count_distinct("original_language").alias("n_languages"),
        F.count_if(F.col("ai_confidence") == "HIGH").alias("n_high"), F.count_if(F.col("name") == F.concat(F.lit("T"), F.col("c_custkey").cast("string"))).alias("n_named"),
    ).drop("class_hash")


def file_discovery(spark: SparkSession, d: str) -> DataFrame:
    """A tree of one text file for each supplier, written and discovered again."""
    root = shared_folder(spark, "tree")
    rows = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("sup = "), F.col("s_name"), F.lit(" é")).alias("value"))
    rows.repartition("s_suppkey").write.partitionBy("s_suppkey").text(root)
    found = files.discover(spark, root, [".txt"])
    key = F.regexp_extract("rel_path", r"s_suppkey=(\d+)/", 1).cast("long")
    return found.select(key.alias("s_suppkey"), "ext", "content", "file_sha256", "length", F.col("rel_path").startswith("s_suppkey=").alias("is_relative"))


def uploaded_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Files given as bytes, each with a byte that isn't UTF-8, read in both modes."""
    data = F.concat(F.encode(F.concat(F.lit("x = "), F.col("c_name")), "UTF-8"), F.unhex(F.lit("FF")), F.encode(F.lit("é"), "UTF-8"))
    rows = spread(table(spark, d, "customer")).select("c_custkey", F.concat(F.lit("d/c"), F.col("c_custkey").cast("string"), F.lit(".Py")).alias("path"), data.alias("data"))
    a = files.from_bytes(rows, "path", "data").select("path", "lang", "file_sha256", "length", F.col("content").alias("replaced"))
    b = files.from_bytes(rows, "path", "data", "ignore").select("path", F.col("content").alias("ignored"))
    return a.join(b, "path")


def stdin_scan(spark: SparkSession, d: str) -> DataFrame:
    return extract.python_functions(files.literal_source(spark, "def f(a):\n    return a\n"), "content").select("path", "name", "lineno", "source")


def canonical_rows(spark: SparkSession, d: str) -> DataFrame:
    """Nested rows as JSON with their fields in order."""
    inner = F.struct(F.col("c_nationkey").alias("z"), F.struct(F.col("c_mktsegment").alias("q"), F.col("c_name").alias("b")).alias("a"))
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), inner.alias("at"), F.array(F.struct(F.lit(1).alias("y"), F.lit(2).alias("x"))).alias("all"))
    return rows.select("key", sql.canonical_json(rows.schema).alias("json"))


def hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Hash values of sources small enough to write their canonical text down."""
    n = F.col("p_size").cast("string")
    method = F.concat(F.lit("def area(self, w):\n    return self.h * w + "), n)
    return spread(table(spark, d, "part")).select(
        "p_partkey", sql.sem_hash(n).alias("strict"), sql.sem_hash(n, pycanon.AGGRESSIVE).alias("aggressive"), sql.method_hash(method).alias("method"),
        sql.merkle_hash(F.array(sql.method_hash(method))).alias("class_hash"),
    )


def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The registered functions, called from SQL."""
    sql.register(spark)
    generated.python_parts(spread(table(spark, d, "part"))).createOrReplaceTempView("codeweft_parts")
    return spark.sql(
        """WITH h AS (SELECT p_brand, sem_hash(code) AS h FROM codeweft_parts), g AS (SELECT p_brand, h, count(*) AS n FROM h GROUP BY 1, 2),
        s AS (SELECT p_brand, sum(n) AS total, count(*) AS uniques, coalesce(sum(CASE WHEN n >= 2 THEN n END), 0) AS dup, coalesce(sum(CASE WHEN n >= 2 THEN n - 1 END), 0) AS extra FROM g GROUP BY 1)
        SELECT p_brand, health_cli(total, dup) AS cli, health_ui(total, uniques) AS ui, health_mcp(total, extra) AS mcp, health_after_merge(total, uniques, extra) AS after,
               merkle_hash(array(p_brand, 'a')) AS merkle, folded_hash(p_brand, array('q', 'p')) AS folded, occurrence_key(p_brand, 'f', 7) AS place FROM s"""
    )


_TS = [
    "function t~k~(p: number, q: Array<string>): number { return p + q; }",
    "@log() function t~k~(p: number, q: number) { return p! + q!; }",
    "interface I { a: string; }\nfunction t~k~<T>(p: T, q: T): T { return p + q; }",
    "type N = number | string;\n// remark\nfunction t~k~(p: N, q: N): N { /* sum */ return p + q; }",
]


def type_erasure(spark: SparkSession, d: str) -> DataFrame:
    """TypeScript functions of several forms that all are one JavaScript function."""
    k = F.col("s_suppkey")
    code = F.coalesce(*[F.when(k % len(_TS) == i, generated._text(t, k=k)) for i, t in enumerate(_TS)])
    rows = spread(table(spark, d, "supplier")).select("s_suppkey", code.alias("code"), F.lit(True).alias("ts"))
    found = extract.js_functions(rows, "code", "ts")
    return found.select("s_suppkey", "name", sql.js_hash(F.col("params"), F.col("body_src")).alias("js_hash"))


def _js(spark: SparkSession, d: str) -> DataFrame:
    found = extract.js_functions(generated.js_parts(spread(table(spark, d, "part"))).join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey"), "code")
    return found.withColumn("sir_sha256", sql.js_hash(F.col("params"), F.col("body_src")))


def js_pack_roots(spark: SparkSession, d: str) -> DataFrame:
    """Roots of a pack with the digest of their own source and what the store holds for them."""
    roots = _js(spark, d).withColumn("source_sha256", sql.source_hash(F.col("body_src")))
    store = pack.first_store(roots.withColumn("params_count", F.size("params")), "sir_sha256", ["p_partkey"], ["p_partkey", "params_count", "body_src"])
    store = store.select("sir_sha256", F.col("p_partkey").alias("stored_from"), "params_count", sql.source_hash(F.col("body_src")).alias("stored_sha256"))
    return roots.select("p_partkey", "sir_sha256", "source_sha256").join(store, "sir_sha256").drop("sir_sha256")


def js_health_sides(spark: SparkSession, d: str) -> DataFrame:
    """Health of both sides of a difference of scripts."""
    rows = _js(spark, d).withColumn("side", F.when(F.col("p_brand") < "Brand#3", F.lit("a")).otherwise(F.lit("b")))
    return rows.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sir_sha256").alias("u")).select("side", "n", clusters.health_ui(F.col("n"), F.col("u")).alias("health"))


def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    """A stream of occurrences, counted batch by batch, and the batches folded into one."""
    stream = spark.readStream.schema(table(spark, d, "occur").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/occur.parquet*")
    out, ckpt, folded = (shared_folder(spark, x) for x in ("counts", "counts-progress", "counts-folded"))
    counts.upsert_counts(stream, "semantic_hash", "occur_id", out, ckpt).awaitTermination()
    counts.compact_counts(spark, out, "semantic_hash", folded)
    return counts.current_counts(spark, folded, "semantic_hash")


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Events by type in windows of six hours that the watermark has closed."""
    stream = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    found = counts.windowed_counts(stream, "ts", "event_type", "6 hours", "1 day")
    out, ckpt = (shared_folder(spark, x) for x in ("windows", "windows-progress"))
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def file_hash_cache(spark: SparkSession, d: str) -> DataFrame:
    """Hashes of files kept and found again: a third of the files has changed since."""
    rows = generated.python_parts(spread(table(spark, d, "part"))).select("p_partkey", F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), "code")
    old = rows.withColumn("file_sha256", sql.source_hash(F.col("code")))
    functions = extract.python_functions(old, "code").withColumnRenamed("name", "qualname").withColumn("sem_hash", sql.sem_hash(F.col("source")))
    where = shared_folder(spark, "hash-cache")
    none = files.read_cache(spark, where)
    files.write_cache(functions.unionByName(none, allowMissingColumns=True), where)
    new = rows.withColumn("code", F.when(F.col("p_partkey") % 3 == 0, F.concat("code", F.lit("#"))).otherwise(F.col("code"))).withColumn("file_sha256", sql.source_hash(F.col("code")))
    known, again = files.file_cache(new, files.read_cache(spark, where))
    return known.select("path", F.lit("cached").alias("status")).unionByName(again.select("path", F.lit("scan").alias("status")))


QUERIES = {
    f.__name__: f
    for f in (
        raw_functions_languages, raw_functions_proper, raw_classes_languages, plain_classes_languages, python_sources, python_sources_broken,
        walk_segments, find_functions, mixed_scan, mixed_scan_summary, mixed_classes, file_discovery, uploaded_bytes, stdin_scan, canonical_rows,
        hash_vectors, sql_functions, type_erasure, js_pack_roots, js_health_sides, stream_counts, stream_windows, file_hash_cache,
    )
}

_PART = "def part_~k~(a~k~, b~k~):\n    r~k~ = a~k~ * ~n~\n    if r~k~ > b~k~:\n        return r~k~\n    return b~k~ + r~k~"
_K = {"k": "p_partkey", "n": "p_size"}
_M = "def m(self):\n        def inner(x):\n            return x + ~n~\n        return inner"
_C = {"k": "c_custkey", "n": "c_nationkey"}
_OPS = "['+', '-', '*', '/', '%', '&'][(length(p_type) % 6 + 1)::INT]"
_BODY = f"'{{ const r' || p_partkey || ' = a' || p_partkey || ' ' || {_OPS} || ' b' || p_partkey || ' ; return r' || p_partkey || ' + ' || p_size || ' ; }}'"
_ONE = """'{"body":"{ return v0 + v1 ; }","lang":"javascript","params":["v0","v1"],"type":"JSFunction"}'"""
_DUMP = """'Module(body=[FunctionDef(name=''f0'', args=arguments(args=[arg(arg=''v0''), arg(arg=''v1'')]), body=[Return(value=BinOp(left=BinOp(left=Attribute(value=Name(id=''v0'', ctx=Load()), attr=''a0'', ctx=Load()), op=Mult(), right=Name(id=''v1'', ctx=Load())), op=Add(), right=Constant(value=' || p_size || ')))])])'"""
_VECTOR = """
a AS (SELECT *, '{"f":{"k":"int","v":' || p_size || '},"t":"Lit"}' AS lit, '{"f":{},"t":"None"}' AS nil, '{"f":{"items":[]},"t":"List"}' AS l0 FROM part),
b AS (SELECT *, '{"f":{"kind":"' || sha256(nil) || '","value":"' || sha256(lit) || '"},"t":"Constant"}' AS con FROM a),
c AS (SELECT *, '{"f":{"value":"' || sha256(con) || '"},"t":"Expr"}' AS ex FROM b),
e AS (SELECT *, '{"f":{"items":["' || sha256(ex) || '"]},"t":"List"}' AS l1 FROM c),
m AS (SELECT *, '{"f":{"body":"' || sha256(l1) || '","type_ignores":"' || sha256(l0) || '"},"t":"Module"}' AS mo FROM e),
v AS (SELECT *, sha256('{"nodes":{' || array_to_string(list_sort(list_transform([lit, nil, l0, con, ex, l1, mo], lambda x: '"' || sha256(x) || '":' || x)), ',') || '},"root":"' || sha256(mo) || '"}') AS h FROM m)"""
SQL = {
    "raw_functions_languages": block_sql("customer", _C, [(b[0], b[2]) for b in generated.FUNCTION_BLOCKS]),
    "raw_functions_proper": f"""SELECT c_custkey, CASE WHEN c_custkey % {len(generated.FUNCTION_BLOCKS)} = 7 THEN 'u' || c_custkey || '?' ELSE 'x' || c_custkey END AS name,
  CASE WHEN c_custkey % {len(generated.FUNCTION_BLOCKS)} = 7 THEN 3 ELSE 1 END AS lineno FROM customer WHERE c_custkey % {len(generated.FUNCTION_BLOCKS)} IN (7, 10)""",
    "raw_classes_languages": block_sql("customer", _C, [(b[0], b[2]) for b in generated.CLASS_BLOCKS]),
    "plain_classes_languages": block_sql("customer", _C, [(b[0], b[3]) for b in generated.CLASS_BLOCKS]),
    "python_sources": f"""SELECT p_partkey, 'part_' || p_partkey AS name, 1 AS lineno, sha256({text_sql(_PART, _K)}) AS source_sha256 FROM part
UNION ALL SELECT p_partkey, 'C' || p_partkey || '.m', 8, sha256({text_sql(_M, _K)}) FROM part""",
    "python_sources_broken": "SELECT 'all' AS name, 2 * count(*) AS n FROM part WHERE p_partkey % 3 <> 0",
    "walk_segments": "SELECT name, lineno, count(*) AS n_hashed, count(DISTINCT p_size) AS n_distinct FROM part, (VALUES ('m', 8), ('inner', 9)) AS f(name, lineno) GROUP BY 1, 2",
    "find_functions": f"SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN sha256({text_sql(_PART, _K)}) END AS source_sha256 FROM part",
    "mixed_scan": f"""SELECT 'Python' AS lang, count(*) AS n_functions, count(DISTINCT p_size) AS n_hashes FROM part
UNION ALL SELECT 'JavaScript', count(*), count(DISTINCT {_OPS}) FROM part UNION ALL SELECT 'TypeScript', count(*), count(DISTINCT s_suppkey % 6) FROM supplier""",
    "mixed_scan_summary": f"""
WITH f AS (SELECT 'py' || p_size AS h FROM part UNION ALL SELECT {_OPS} FROM part UNION ALL SELECT ['+', '-', '*', '/', '%', '&'][(s_suppkey % 6 + 1)::INT] FROM supplier),
g AS (SELECT h, count(*) AS n FROM f GROUP BY 1), s AS (SELECT sum(n)::BIGINT AS total_functions, count_if(n >= 2)::BIGINT AS duplicate_clusters, coalesce(sum(CASE WHEN n >= 2 THEN n END), 0)::BIGINT AS duplicate_functions FROM g)
SELECT *, greatest(0, round_even((1.0::DOUBLE - duplicate_functions::DOUBLE / total_functions) * 100, 0)::INT) AS health_score, CASE WHEN duplicate_clusters > 0 THEN 1 ELSE 0 END AS strict_exit FROM s""",
    "mixed_classes": """SELECT c_nationkey, count(*) AS n, count_if(c_custkey % 4 < 2)::BIGINT AS n_translated, count(DISTINCT c_custkey % 4) AS n_languages,
  count_if(c_custkey % 4 < 2)::BIGINT AS n_high, count(*) AS n_named FROM customer WHERE c_custkey % 4 < 3 GROUP BY 1""",
    "file_discovery": """SELECT s_suppkey, '.txt' AS ext, 'sup = ' || s_name || ' é' || chr(10) AS content, sha256('sup = ' || s_name || ' é' || chr(10)) AS file_sha256, strlen('sup = ' || s_name || ' é') + 1 AS length, true AS is_relative FROM supplier""",
    "uploaded_bytes": r"""SELECT 'd/c' || c_custkey || '.Py' AS path, 'Python' AS lang, sha256(encode('x = ' || c_name) || '\xFF'::BLOB || encode('é')) AS file_sha256, strlen('x = ' || c_name) + 3 AS length,
  'x = ' || c_name || chr(65533) || 'é' AS replaced, 'x = ' || c_name || 'é' AS ignored FROM customer""",
    "stdin_scan": "SELECT '<stdin>' AS path, 'f' AS name, 1 AS lineno, 'def f(a):' || chr(10) || '    return a' AS source",
    "canonical_rows": """SELECT c_custkey AS key, '{"all":[{"x":2,"y":1}],"at":{"a":{"b":"' || c_name || '","q":"' || c_mktsegment || '"},"z":' || c_nationkey || '},"key":' || c_custkey || '}' AS json FROM customer""",
    "hash_vectors": f"""WITH {_VECTOR} SELECT p_partkey, h AS "strict", h AS aggressive, sha256({_DUMP}) AS "method", sha256('["' || sha256({_DUMP}) || '"]') AS class_hash FROM v""",
    "sql_functions": """
WITH g AS (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY 1, 2),
s AS (SELECT p_brand, sum(n)::BIGINT AS total, count(*) AS uniques, coalesce(sum(CASE WHEN n >= 2 THEN n END), 0)::BIGINT AS dup, coalesce(sum(CASE WHEN n >= 2 THEN n - 1 END), 0)::BIGINT AS extra FROM g GROUP BY 1)
SELECT p_brand, greatest(0, round_even((1.0::DOUBLE - dup::DOUBLE / total) * 100, 0)::INT) AS cli, floor(100 * uniques / greatest(total, 1))::INT AS ui, greatest(0, 100 - floor(extra::DOUBLE / total * 100)::INT) AS mcp,
  least(100, floor(100 * uniques / greatest(total - extra, 1))::INT) AS "after", sha256('["' || p_brand || '","a"]') AS merkle, sha256('{"methods":"' || p_brand || '","parents":["p","q"]}') AS folded, p_brand || '::f::7' AS place FROM s""",
    "type_erasure": f"""SELECT s_suppkey, 't' || s_suppkey AS name, sha256('{{"nodes":{{"' || sha256({_ONE}) || '":' || {_ONE} || '}},"root":"' || sha256({_ONE}) || '"}}') AS js_hash FROM supplier""",
    "js_pack_roots": f"""
WITH r AS (SELECT p_partkey, {_OPS} AS op, sha256({_BODY}) AS source_sha256 FROM part), s AS (SELECT op, min(p_partkey) AS stored_from FROM r GROUP BY 1)
SELECT r.p_partkey, r.source_sha256, s.stored_from, 2 AS params_count, q.source_sha256 AS stored_sha256 FROM r JOIN s USING (op) JOIN r q ON q.p_partkey = s.stored_from""",
    "js_health_sides": f"""SELECT CASE WHEN p_brand < 'Brand#3' THEN 'a' ELSE 'b' END AS side, count(*) AS n, floor(100 * count(DISTINCT {_OPS}) / count(*))::INT AS health FROM part GROUP BY 1""",
    "stream_counts": 'SELECT semantic_hash, count(*) AS n, min(occur_id) AS "first" FROM occur WHERE semantic_hash IS NOT NULL GROUP BY 1',
    "stream_windows": """SELECT w AS window_start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS w, event_type FROM events)
WHERE w + INTERVAL 6 HOURS <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""",
    "file_hash_cache": "SELECT 'p' || p_partkey || '.py' AS path, CASE WHEN p_partkey % 3 = 0 THEN 'scan' ELSE 'cached' END AS status FROM part",
}
