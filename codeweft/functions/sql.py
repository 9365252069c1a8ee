"""Column functions and their registration for SQL."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from codeweft import schemas
from codeweft.functions import jscanon, pycanon, pysource, universal


def _text_udf(make: Callable[[str], object], kind: str = "string"):
    """An Arrow function of one text; equal texts of a batch are computed once."""

    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        known = {t: make(t) for t in s.dropna().unique()}
        return s.map(known) if len(known) else pd.Series([None] * len(s), dtype=object)

    return run.asNondeterministic()  # else a filter on the result computes it a second time


def sem_hash(code: Column, variant: str = pycanon.STRICT) -> Column:
    """Structure hash of Python code, null where it is null or doesn't parse. variant: strict, aggressive or exact."""
    return _text_udf(lambda t: pycanon.hash_or_none(t, variant))(code)


def sem_hash_with_fallback(code: Column) -> Column:
    return _text_udf(pycanon.hash_with_fallback)(code)


def structure_root(code: Column, variant: str = pycanon.STRICT) -> Column:
    """Root id of the node graph: equal roots mean equal hashes, and it is cheaper, for the nodes aren't written out."""

    def root(t: str) -> str | None:
        try:
            tree = pycanon.parse(t)
            return pycanon.Graph(pycanon.rename_plan(tree, variant)).add(tree)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None

    return _text_udf(root)(code)


def method_hash(code: Column) -> Column:
    return _text_udf(pycanon.method_hash)(code)


def _js_hash_udf():
    @F.pandas_udf("string")
    def run(p: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if y is None else jscanon.js_hash_of_text(list(x) if x is not None else [], y) for x, y in zip(p, b)], dtype=object)

    return run.asNondeterministic()


def js_hash(params: Column, body: Column) -> Column:
    """Hash of a JavaScript function from its parameters and body text."""
    return _js_hash_udf()(params, body)


def _universal_hash_udf():
    def one(code: str | None, language: str | None) -> str | None:
        low = (language or "").lower()
        if not code:
            return None
        try:
            if low == "python":
                node = next((n for n in pycanon.parse(code).body if hasattr(n, "args") and hasattr(n, "body")), None)
                return universal.universal_hash(universal.python_tokens(node)) if node is not None else None
            if low in ("javascript", "typescript"):
                found = jscanon.functions(code, low == "typescript")
                return universal.universal_hash(universal.js_tokens(found[0])) if found else None
        except (SyntaxError, ValueError, RecursionError):
            return None
        return None

    @F.pandas_udf("string")
    def run(c: pd.Series, lang: pd.Series) -> pd.Series:
        return pd.Series([one(x, y) for x, y in zip(c, lang)], dtype=object)

    return run.asNondeterministic()


def universal_hash(code: Column, language: Column) -> Column:
    """Universal hash of the first function of a code: Python, JavaScript or TypeScript; null for others."""
    return _universal_hash_udf()(code, language)


def translation_error(code: Column, wanted: str = "function") -> Column:
    return F.coalesce(_text_udf(lambda t: pysource.translation_error(t, wanted))(code), F.when(code.isNull(), F.lit("Empty translation")))


def normalised(code: Column) -> Column:
    """Code without the indent that all lines share and without blank ends."""
    return _text_udf(pysource.normalised)(code)


def find_function(code: Column, name: Column) -> Column:
    """Source of the first top-level function of a name in a Python source, or null."""

    @F.pandas_udf("string")
    def run(c: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([pysource.find_function(x, y) for x, y in zip(c, n)], dtype=object)

    return run.asNondeterministic()(code, name)


def clean_translation(raw: Column, wanted: str = "function") -> Column:
    return _text_udf(pysource.clean_class_translation if wanted == "class" else pysource.clean_translation)(raw)


def document(code: str, variant: str) -> tuple | None:
    """Row of a code's document, or null where it doesn't parse."""
    try:
        d = pycanon.encode(code, variant)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    nodes = [(k, n["t"], json.dumps(n["f"], ensure_ascii=False, sort_keys=True, separators=(",", ":"))) for k, n in d["nodes"].items()]
    return d["root"], d["sir_sha256"], d["source_sha256"], nodes, [(f["canon_func"], f["orig_func"], f["canon_to_orig"]) for f in d["functions"]]


# --- expressions without Python ---------------------------------------------------------------------------------


def merkle_hash(hashes: Column) -> Column:
    """Order-free digest of an array of hashes."""
    return F.sha2(F.to_json(F.sort_array(hashes)), 256)


def folded_hash(methods: Column, parents: Column) -> Column:
    return F.sha2(F.to_json(F.struct(methods.alias("methods"), F.sort_array(parents).alias("parents"))), 256)


def cache_key(language: Column, code: Column) -> Column:
    return F.substring(F.sha2(F.concat(language, F.lit("::"), code), 256), 1, 32)


def class_cache_key(language: Column, code: Column, tag_code: bool = True) -> Column:
    """Keys of class translations: the tag stands before the code, or before the language."""
    if tag_code:
        return cache_key(language, F.concat(F.lit("class::"), code))
    return cache_key(F.concat(F.lit("class:"), language), code)


def occurrence_key(file: Column, qualname: Column, line: Column) -> Column:
    return F.concat(file, F.lit("::"), qualname, F.lit("::"), line.cast("string"))


def diff_label(file: Column, name: Column, line: Column) -> Column:
    return F.concat(file, F.lit("::"), name, F.lit("::L"), line.cast("string"))


def safe_slug(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}_.\-]", "_")


def occurrence_filename(index: Column, file: Column, line: Column, qualname: Column, root: Column) -> Column:
    return F.format_string("%04d_%s_L%d_%s_%s.py", index, safe_slug(file), line, safe_slug(qualname), F.substring(root, 1, 8))


def module_name(path: Column) -> Column:
    return F.translate(F.regexp_replace(path, r"\.py$", ""), "/\\", "..")


def import_statement(module: Column, name: Column, alias: Column) -> Column:
    base = F.concat(F.lit("from "), module, F.lit(" import "), name)
    return F.when(name == alias, base).otherwise(F.concat(base, F.lit(" as "), alias))


#: What ends a line and what is blank, as Python's splitlines and strip see it.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
VISIBLE = r"[^\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def nonblank_lines(text: Column) -> Column:
    return F.size(F.filter(F.split(text, LINE_END), lambda x: x.rlike(VISIBLE)))


def constructor(name: Column) -> Column:
    """Whether a function's name is written as a class's, with a capital letter first; false for null."""
    return F.coalesce(F.substring(name, 1, 1).rlike(r"\p{Lu}"), F.lit(False))


def source_hash(text: Column) -> Column:
    """Digest of a source as it stands."""
    return F.sha2(text, 256)


def canonical_json(df_schema: StructType, of: Callable[[str], Column] = F.col) -> Column:
    """JSON of a row with the fields of all structs, at any depth, in alphabetical order and without spaces."""

    def ordered(value: Column, kind: DataType) -> Column:
        if isinstance(kind, StructType):
            made = F.struct(*[ordered(value[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
            return F.when(value.isNotNull(), made)
        if isinstance(kind, ArrayType):
            return F.transform(value, lambda x: ordered(x, kind.elementType))
        return value

    return F.to_json(F.struct(*[ordered(of(f.name), f.dataType).alias(f.name) for f in sorted(df_schema.fields, key=lambda f: f.name)]))


def display_hash(h: Column, n: int = 16) -> Column:
    return F.substring(h, 1, n)


def extension(path: Column) -> Column:
    """Last suffix of a file name with its dot, or an empty text."""
    return F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1)


def repo_parts(url: Column) -> Column:
    """Owner, repository and branch of a repository address; the branch is null unless the address names a tree."""
    rest = F.regexp_replace(F.regexp_replace(url, r"^https?://(www\.)?[^/]+/", ""), r"(\.git)?/?$", "")
    parts = F.split(rest, "/")
    return F.struct(
        F.get(parts, F.lit(0)).alias("owner"),
        F.get(parts, F.lit(1)).alias("repo"),
        F.when(F.get(parts, F.lit(2)) == "tree", F.get(parts, F.lit(3))).alias("branch"),
    )


#: Functions that SQL can express, by their heads.
EXPRESSIONS = {
    "merkle_hash(hashes ARRAY<STRING>) RETURNS STRING": "sha2(to_json(sort_array(hashes)), 256)",
    "folded_hash(methods STRING, parents ARRAY<STRING>) RETURNS STRING": "sha2(to_json(struct(methods AS methods, sort_array(parents) AS parents)), 256)",
    "health_cli(total BIGINT, dup_members BIGINT) RETURNS INT": "CASE WHEN total = 0 THEN 100 ELSE greatest(0, CAST(bround((1.0D - dup_members / total) * 100, 0) AS INT)) END",
    "health_ui(total BIGINT, uniques BIGINT) RETURNS INT": "CAST(100 * uniques / greatest(total, 1) AS INT)",
    "health_mcp(total BIGINT, extra BIGINT) RETURNS INT": "CASE WHEN total = 0 THEN 100 ELSE greatest(0, 100 - CAST(extra / total * 100 AS INT)) END",
    "health_after_merge(total BIGINT, uniques BIGINT, extra BIGINT) RETURNS INT": "least(100, CAST(100 * uniques / greatest(total - extra, 1) AS INT))",
    "occurrence_key(file STRING, qualname STRING, line INT) RETURNS STRING": "concat(file, '::', qualname, '::', CAST(line AS STRING))",
    "cache_key(language STRING, code STRING) RETURNS STRING": "substring(sha2(concat(language, '::', code), 256), 1, 32)",
}


def register(spark: SparkSession) -> None:
    """Makes the functions and table functions of this package callable from SQL."""
    from pyspark.sql.functions import udtf

    texts = {
        "sem_hash": lambda t: pycanon.hash_or_none(t),
        "sem_hash_aggressive": lambda t: pycanon.hash_or_none(t, pycanon.AGGRESSIVE),
        "sem_hash_exact": lambda t: pycanon.hash_or_none(t, pycanon.EXACT),
        "method_hash": pycanon.method_hash,
        "translation_error": pysource.translation_error,
        "clean_translation": pysource.clean_translation,
    }
    for name, make in texts.items():
        spark.udf.register(name, _text_udf(make))
    spark.udf.register("js_hash", _js_hash_udf())
    spark.udf.register("universal_hash", _universal_hash_udf())
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")

    @udtf(returnType=schemas.FUNCTION)
    class ExtractFunctions:
        def eval(self, code: str):  # type: ignore[no-untyped-def]
            try:
                yield from (tuple(f) for f in pysource.top_functions(code or ""))
            except (SyntaxError, ValueError, RecursionError):
                return

    @udtf(returnType=schemas.JS_FUNCTION)
    class ExtractJs:
        def eval(self, code: str, typescript: bool):  # type: ignore[no-untyped-def]
            for f in jscanon.functions(code or "", bool(typescript)):
                yield f.name, f.line, f.params, jscanon.source_of(f.body)

    @udtf(returnType=schemas.CLASS)
    class ExtractClasses:
        def eval(self, code: str):  # type: ignore[no-untyped-def]
            try:
                for c in pysource.classes(code or ""):
                    yield c.name, c.line, c.bases, [tuple(m) for m in c.methods], c.hash
            except (SyntaxError, ValueError, RecursionError):
                return

    spark.udtf.register("extract_functions", ExtractFunctions)
    spark.udtf.register("extract_js", ExtractJs)
    spark.udtf.register("extract_classes", ExtractClasses)
