"""Queries of the problems on text and code collections, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.llm import credentials, handwritten, history, mixing, pysyntax, setjoin, splitting, tokens
from codeweft.session import spread, table


def _texts(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table whose texts are parsed or encoded; small files are spread over all cores."""
    return spread(table(spark, d, name).select(*columns))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    # documents holds one row per doc_id, so no text has to meet another.
    docs = _texts(spark, d, "documents", "doc_id", "text")
    return tokens.encode_table(docs, "doc_id", "text")


SIMILAR_CLASSES = 0.75


def _p1(spark: SparkSession, d: str) -> setjoin.SimilarRecords:
    columns = ["class_id", "class_hash", F.col("methods.hash").alias("hashes")]
    rows = (
        table(spark, d, "classes").select(*columns, F.lit(True).alias("is_class"))
        .unionByName(table(spark, d, "class_catalog").select(*columns, F.lit(False).alias("is_class")))
    )
    return setjoin.similar_classes(rows, "class_id", "hashes", "class_hash", SIMILAR_CLASSES, F.col("is_class"))


def p1_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = setjoin.record_pairs(_p1(spark, d))
    return pairs.select(F.col("id_a").alias("class_id_a"), F.col("id_b").alias("class_id_b"), "similarity")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_pairs(spark, d).select("class_id_a", "class_id_b")


def p1_sets(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct sets, each named by the least class that has it."""
    found = _p1(spark, d)
    least = found.members.groupBy("set_id").agg(F.min("id").alias("least"))
    side = lambda t: least.select(F.col("set_id").alias(f"set_{t}"), F.col("least").alias(f"least_{t}")).hint("merge")
    both = found.pairs.join(side("a"), "set_a").join(side("b"), "set_b")
    return both.select(F.least("least_a", "least_b").alias("class_id_a"), F.greatest("least_a", "least_b").alias("class_id_b"), "similarity")


def p1_links(spark: SparkSession, d: str) -> DataFrame:
    """Every class with values: the least class of the same set, and the number of its pairs in p1_pairs."""
    found = _p1(spark, d)
    least = found.members.groupBy("set_id").agg(F.min("id").alias("set_class_id"))
    links = setjoin.record_links(found).join(least.hint("merge"), "set_id")
    return links.select(F.col("id").alias("class_id"), "set_class_id", "n_links")


_P2 = (("extract_all_functions", "fn_id", "body_src"), ("ai_pack_store", "store_id", "original_src"))


def _p2(spark: SparkSession, d: str) -> DataFrame:
    found = [
        credentials.find_credentials(_texts(spark, d, t, i, c), i, c).select(
            F.lit(t).alias("src_table"), F.col(i).alias("row_id"), "line_no", "kind"
        )
        for t, i, c in _P2
    ]
    return found[0].unionByName(found[1])


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).select("src_table", "row_id", "line_no")


def p2_kinds(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d).groupBy("src_table", "kind").agg(F.count(F.lit(1)).alias("n_lines"))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """Both columns blanked, with the lines and kinds of what was found, from one pass over the texts."""
    found = [
        credentials.scan_table(_texts(spark, d, t, i, c), i, c).select(F.lit(t).alias("src_table"), F.col(i).alias("row_id"), F.col(c).alias("text"), "found") for t, i, c in _P2
    ]
    return found[0].unionByName(found[1])


_P3 = ("fn_id", "repo", "rel_file", "body_src")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_reasons(spark, d).select("repo", "rel_file")


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(_texts(spark, d, "extract_all_functions", *_P3), table(spark, d, "vendor_catalog"))


def p3_handwritten(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.handwritten_rows(_texts(spark, d, "extract_all_functions", *_P3), table(spark, d, "vendor_catalog"))


NEAR_REPEAT = 0.8


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    incoming = table(spark, d, "batch_functions").select(
        F.col("occ_id").alias("row_id"), F.col("batch_no").alias("batch"), "hash", F.col("code").alias("text")
    )
    index = table(spark, d, "hash_index")
    hashes = index.select("hash").unionByName(table(spark, d, "roots").select(F.col("sir_sha256").alias("hash")))
    found = history.repeats_of_known(incoming, index.select(F.col("code").alias("text")), hashes, NEAR_REPEAT)
    return found.select(F.col("row_id").alias("occ_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_kinds(spark, d).select("repo", "file")


def p7_kinds(spark: SparkSession, d: str) -> DataFrame:
    return pysyntax.broken_files(_texts(spark, d, "ai_pack_store", "repo", "file", "python_src"), "repo", "file", "python_src")


def p7_rates_repo(spark: SparkSession, d: str) -> DataFrame:
    return pysyntax.broken_rates(_texts(spark, d, "ai_pack_store", "repo", "file", "python_src"), "repo", "file", "python_src", ["repo"])


def p7_rates_lang(spark: SparkSession, d: str) -> DataFrame:
    rows = _texts(spark, d, "ai_pack_store", "repo", "file", "lang", "python_src").withColumn("language", F.coalesce(F.lower("lang"), F.lit("unknown")))
    return pysyntax.broken_rates(rows, "repo", "file", "python_src", ["language"])


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    chosen, _ = mixing.mix(_texts(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "mix_targets"), "doc_id", "text", "source")
    return chosen


def p9_copies(spark: SparkSession, d: str) -> DataFrame:
    """The mix itself: every text as often as it is taken."""
    docs = table(spark, d, "documents")
    chosen, _ = mixing.mix(_texts(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "mix_targets"), "doc_id", "text", "source")
    return mixing.emit(docs, chosen, "doc_id", "text")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix(_texts(spark, d, "documents", "doc_id", "text", "source"), table(spark, d, "mix_targets"), "doc_id", "text", "source")
    return report


PIECE_TOKENS, PIECE_OVERLAP = 512, 64


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_texts(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text", PIECE_TOKENS, PIECE_OVERLAP)


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the texts that the ids of all documents decode to."""
    back = tokens.decode_table(p8_ids(spark, d), "doc_id", "ids")
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha256"))


def p10_joined(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the texts that the pieces of all documents make when they are put together without their overlaps."""
    pieces = splitting.split_texts(_texts(spark, d, "documents", "doc_id", "text"), "doc_id", "text", PIECE_TOKENS, PIECE_OVERLAP, places=True)
    over = F.count_if(F.col("n_tokens") > PIECE_TOKENS)
    sizes = pieces.groupBy("doc_id").agg(over.alias("n_over"))
    return splitting.joined(pieces, "doc_id").join(sizes, "doc_id").select("doc_id", F.sha2("text", 256).alias("text_sha256"), "n_over")


#: Lines that hold a credential, in layers, or nothing but what resembles one. ~k~ is the row's key.
_PLANTED = [
    ("base64", 'password = "kQ29!xz~k~"'), ("twice", '{"client_secret":"kQ29!xz~k~"}'), ("hex", "pwd='kQ29!xz~k~'"), ("percent", 'passwd%3D%22kQ29!xz~k~%22'),
    ("base64", "the quick brown fox ~k~ jumps over the lazy dog"), ("hex", "release notes of build ~k~"), ("none", "id-~k~"),
]


def credentials_planted(spark: SparkSession, d: str) -> DataFrame:
    """Credentials that only decoded layers show, planted in texts of customers, among harmless encoded lines."""
    k = F.col("c_custkey")

    def line(form: str, text: str) -> Column:
        plain = F.replace(F.lit(text), F.lit("~k~"), k.cast("string"))
        once = F.base64(F.encode(plain, "UTF-8"))
        coded = {"base64": once, "twice": F.base64(F.encode(once, "UTF-8")), "hex": F.lower(F.hex(F.encode(plain, "UTF-8"))), "percent": plain, "none": plain}[form]
        return F.concat(F.lit('// line one\nload("'), F.regexp_replace(coded, r"\s", ""), F.lit('");\n'))

    code = F.coalesce(*[F.when(k % len(_PLANTED) == i, line(*p)) for i, p in enumerate(_PLANTED)])
    rows = spread(table(spark, d, "customer").select("c_custkey")).select("c_custkey", code.alias("code"))
    return credentials.find_credentials(rows, "c_custkey", "code").select("c_custkey", "line_no", "kind")


#: Python sources with their damage: broken, cost, kind. ~k~ is the row's key.
_DAMAGED = [
    ("def f~k~(a):\n    return a + ~k~\n", 0, None),
    ("def f~k~(a)\n    return a + ~k~\n\n\nx = 1\ny = 2\nz = 3\n", 1, "damage"),
    ("x = 1\ny = 2\n\n\ndef f~k~(a):\n    return (a + ~k~", 1, "truncation"),
    ("x = 1\ny = 2\nz = 3\n\n\ndef f~k~(a):\n", 1, "truncation"),
    ("a = 1\nb = 2\n<<<<<<< HEAD\nx = ~k~\n=======\nx = 2\n>>>>>>> other\nc = 3\nd = 4\n", None, "conflict"),
    ("int f~k~(int a, int b) { return a; }", None, "mismatch"),
]


def syntax_planted(spark: SparkSession, d: str) -> DataFrame:
    """Damage of Python sources planted by customer; costs are told where the least edits are plain to see."""
    k = F.col("c_custkey")
    text = F.coalesce(*[F.when(k % len(_DAMAGED) == i, F.replace(F.lit(p[0]), F.lit("~k~"), k.cast("string"))) for i, p in enumerate(_DAMAGED)])
    rows = spread(table(spark, d, "customer").select("c_custkey")).select("c_custkey", text.alias("src"))
    told = (k % len(_DAMAGED)).isin(*[i for i, p in enumerate(_DAMAGED) if p[1] is not None])
    found = pysyntax.check_sources(rows, ["c_custkey"], "src")
    return found.select("c_custkey", "broken", "kind", F.when(told, F.col("cost")).alias("cost"))


#: Files with the reason why they aren't hand-written: minified, generated, data, or none.
_WRITTEN = [
    ("{\n  const a = read(~k~);\n  if (a > 1) {\n    return a - 1;\n  }\n  return send(a);\n}", None),
    ("{const a=read(~k~);if(a>1){b(a)}else{c(a)}d(a);e(a);f(a);g(a);for(;;){h(a);break}return a}", "minified"),
    ("{\n" + "".join(f"  set('k{i}', ~k~);\n" for i in range(12)) + "}", "generated"),
    ("{\n  return \"" + "aB3+" * 60 + "~k~\";\n}", "data"),
]


def layout_planted(spark: SparkSession, d: str) -> DataFrame:
    """Files told by their layout alone: their paths, remarks and tokens say nothing."""
    k = F.col("c_custkey")
    body = F.coalesce(*[F.when(k % len(_WRITTEN) == i, F.replace(F.lit(p[0]), F.lit("~k~"), k.cast("string"))) for i, p in enumerate(_WRITTEN)])
    rows = spread(table(spark, d, "customer").select("c_custkey")).select(k.alias("fn_id"), F.lit("r").alias("repo"), F.concat(F.lit("src/f"), k.cast("string"), F.lit(".js")).alias("rel_file"), body.alias("body_src"))
    return handwritten.not_handwritten(rows).select("rel_file", "reason")


QUERIES = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p1_sets": p1_sets,
    "p1_links": p1_links,
    "p2_found": p2_found,
    "p2_kinds": p2_kinds,
    "p2_redacted": p2_redacted,
    "p3_found": p3_found,
    "p3_reasons": p3_reasons,
    "p3_handwritten": p3_handwritten,
    "p5_found": p5_found,
    "p7_found": p7_found,
    "p7_kinds": p7_kinds,
    "p7_rates_repo": p7_rates_repo,
    "p7_rates_lang": p7_rates_lang,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_copies": p9_copies,
    "p9_shares": p9_shares,
    "p10_pieces": p10_pieces,
    "p8_decoded": p8_decoded,
    "p10_joined": p10_joined,
    "credentials_planted": credentials_planted,
    "syntax_planted": syntax_planted,
    "layout_planted": layout_planted,
}
_P1 = """
WITH c AS (SELECT DISTINCT class_id, class_hash, list_distinct(list_transform(methods, lambda x: x.hash)) AS hs, true AS own FROM classes
           UNION ALL SELECT class_id, class_hash, list_distinct(list_transform(methods, lambda x: x.hash)), false FROM class_catalog),
m AS (SELECT class_id, class_hash, own, len(hs) AS n, unnest(hs) AS h FROM c),
p AS (SELECT a.class_id AS class_id_a, b.class_id AS class_id_b, count(*) AS k, max(greatest(a.n, b.n)) AS larger
      FROM m a JOIN m b ON a.h = b.h AND a.class_id < b.class_id AND (a.own OR b.own)
      WHERE a.class_hash IS DISTINCT FROM b.class_hash GROUP BY 1, 2)
SELECT class_id_a, class_id_b, k / larger AS similarity FROM p WHERE k * 4 >= larger * 3"""
_P5 = """
WITH b AS (SELECT DISTINCT occ_id, batch_no, hash, code FROM batch_functions),
h AS (SELECT DISTINCT code FROM hash_index WHERE code IS NOT NULL),
w AS (SELECT 'h' || row_number() OVER () AS k, CAST(-1 AS BIGINT) AS bn, CAST(0 AS BIGINT) AS oc,
             list_distinct(regexp_extract_all(code, '[A-Za-z0-9_]+')) AS ws FROM h
      UNION ALL SELECT 'b' || occ_id, batch_no, occ_id, list_distinct(regexp_extract_all(code, '[A-Za-z0-9_]+')) FROM b WHERE code IS NOT NULL),
t AS (SELECT k, bn, oc, len(ws) AS n, unnest(ws) AS x FROM w),
df AS (SELECT x, count(*) AS f FROM t GROUP BY x),
r AS (SELECT t.*, row_number() OVER (PARTITION BY k ORDER BY f, x) AS rn FROM t JOIN df USING (x)),
p AS (SELECT * FROM r WHERE rn <= n - ceil(0.8 * n) + 1),
c AS (SELECT DISTINCT a.oc AS occ_id, a.k AS ka, e.k AS ke, a.n AS na, e.n AS ne FROM p a JOIN p e ON a.x = e.x
      AND (e.bn < a.bn OR e.bn = a.bn AND e.oc < a.oc) WHERE a.bn >= 0 AND least(a.n, e.n) >= 0.8 * greatest(a.n, e.n)),
s AS (SELECT c.occ_id, ka, ke, any_value(na + ne) AS n, count(*) AS k FROM c JOIN t a ON a.k = ka JOIN t e ON e.k = ke AND e.x = a.x GROUP BY 1, 2, 3),
known AS (SELECT hash FROM hash_index WHERE hash IS NOT NULL UNION SELECT sir_sha256 FROM roots WHERE sir_sha256 IS NOT NULL)
SELECT occ_id FROM s WHERE k * 10 >= 8 * (n - k)
UNION SELECT occ_id FROM b WHERE hash IN (SELECT hash FROM known)
UNION SELECT b.occ_id FROM b JOIN b e ON e.hash = b.hash AND (e.batch_no < b.batch_no OR e.batch_no = b.batch_no AND e.occ_id < b.occ_id)"""
_P1_SETS = """
WITH c AS (SELECT DISTINCT class_id, list_sort(list_distinct(list_transform(methods, lambda x: x.hash))) AS hs FROM classes
           UNION SELECT class_id, list_sort(list_distinct(list_transform(methods, lambda x: x.hash))) FROM class_catalog),
s AS (SELECT min(class_id) AS class_id, hs FROM c WHERE len(hs) > 0 GROUP BY hs)"""
_P1_LINKS = f"""{_P1_SETS}, p AS ({_P1}),
w AS (SELECT class_id_a AS class_id FROM p UNION ALL SELECT class_id_b FROM p)
SELECT c.class_id, s.class_id AS set_class_id, (SELECT count(*) FROM w WHERE w.class_id = c.class_id) AS n_links FROM c JOIN s USING (hs)"""
_P1_SETS += """,
m AS (SELECT class_id, len(hs) AS n, unnest(hs) AS h FROM s),
p AS (SELECT a.class_id AS class_id_a, b.class_id AS class_id_b, count(*) AS k, max(greatest(a.n, b.n)) AS larger
      FROM m a JOIN m b ON a.h = b.h AND a.class_id < b.class_id GROUP BY 1, 2)
SELECT class_id_a, class_id_b, k / larger AS similarity FROM p WHERE k * 4 >= larger * 3"""
def _cases(values: list[str | None]) -> str:
    return f"CASE c_custkey % {len(values)} " + " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else repr(v)) for i, v in enumerate(values)) + " END"


SQL: dict[str, str] = {
    "p8_decoded": "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents",
    "p10_joined": "SELECT doc_id, sha256(text) AS text_sha256, 0::BIGINT AS n_over FROM documents WHERE length(text) > 0",
    "credentials_planted": "SELECT c_custkey, 2 AS line_no, 'encoded' AS kind FROM customer WHERE c_custkey % 7 < 4",
    "syntax_planted": f"SELECT c_custkey, c_custkey % 6 <> 0 AS broken, {_cases([x[2] for x in _DAMAGED])} AS kind, {_cases([x[1] for x in _DAMAGED])} AS cost FROM customer",
    "layout_planted": f"SELECT 'src/f' || c_custkey || '.js' AS rel_file, {_cases([x[1] for x in _WRITTEN])} AS reason FROM customer WHERE c_custkey % 4 > 0",
    "p1_sets": _P1_SETS,
    "p1_links": _P1_LINKS,
    "p5_found": _P5,
    "p1_found": f"SELECT class_id_a, class_id_b FROM ({_P1})",
    "p1_pairs": _P1,
}
