"""Scans over mixed source trees: functions and classes of every supported language, with one hash column each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions import jscanon, pycanon, pysource, rawcode, sql
from codeweft.operators import clusters, extract, translate
from codeweft.sources import files

FOUND = "name string, lineno int, lang string, sem_hash string"
#: Languages by extension, for files that are hashed as they are.
_SCRIPTS = {".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript"}


def mixed_functions(df: DataFrame, content: str, path: str, keep_unhashed: bool = False) -> DataFrame:
    """Functions of .py, .js, .jsx, .ts and .tsx files with name, lineno, lang and sem_hash; other files give nothing.

    Python functions of any depth are hashed from their lines as they stand, so those that are indented have no hash;
    they are left out unless keep_unhashed. Sources that don't parse and null contents give nothing. Extensions count in
    any case. One pass over the files serves all languages.
    """

    def make(text: str | None, name: str | None) -> list[tuple]:
        low = (name or "").lower()
        suffix = next((e for e in (".py", *_SCRIPTS) if low.endswith(e)), None)
        if text is None or suffix is None:
            return []
        try:
            if suffix == ".py":
                found = [(f.name, f.line, "Python", pycanon.hash_with_fallback(f.source)) for f in pysource.all_functions(text, whole_lines=True)]
                return [f for f in found if keep_unhashed or f[3]]
            lang = _SCRIPTS[suffix]
            return [(f.name, f.line, lang, jscanon.js_hash_of_text(f.params, jscanon.source_of(f.body))) for f in jscanon.functions(text, lang == "TypeScript")]
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return []

    return extract.explode_text(df, [content, path], make, FOUND)


def scan_summary(functions: DataFrame, least: int = 2) -> DataFrame:
    """One row: total_functions, duplicate_clusters, duplicate_functions, health_score and strict_exit, 1 where a strict run fails."""
    groups = functions.filter(F.col("sem_hash").isNotNull()).groupBy("sem_hash").agg(F.count(F.lit(1)).alias("n"))
    dup = F.col("n") >= least
    sums = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_functions"), F.count_if(dup).alias("duplicate_clusters"),
        F.coalesce(F.sum(F.when(dup, F.col("n"))), F.lit(0)).alias("duplicate_functions"),
    )
    return sums.withColumns(
        {
            "health_score": clusters.health_cli(F.col("total_functions"), F.col("duplicate_functions")),
            "strict_exit": strict_exit(F.col("duplicate_clusters")),
        }
    )


def strict_exit(*findings: F.Column) -> F.Column:
    """Exit status of a strict run: 1 where any of the counts of findings is above 0."""
    return F.greatest(F.lit(0), *[F.signum(f).cast("int") for f in findings])


def native_classes(df: DataFrame, content: str) -> DataFrame:
    """Classes of Python files, with the columns that tell of translation."""
    found = extract.python_classes(df, content)
    return found.withColumns({"ai_translated": F.lit(False), "ai_confidence": F.lit(None).cast("string"), "original_language": F.lit("Python")})


def translated_classes(df: DataFrame, content: str, language: str, backend: translate.Backend, cache: DataFrame | None = None, check: bool = True) -> DataFrame:
    """Classes of other languages: their blocks are translated, and the classes of the translations extracted.

    Name and lineno are those of the block; every class of its translation gets them. Blocks whose translation failed
    give nothing. Rows without a language give nothing.
    """
    blocks = extract.raw_classes(df.filter(F.col(language).isNotNull()), content, language).withColumnsRenamed({"name": "_name", "lineno": "_line", "source": "_block"}).drop("walk_ord")
    done, _ = translate.translate(blocks, language, "_block", backend, cache, "class_with_methods", check)
    done = translate.usable(done).withColumnRenamed("python_src", "_python").drop("cache_key", "error", "hash1", "hash2", "cache_hit", "_block")
    found = extract.python_classes(done, "_python")
    return found.drop("name", "lineno", "_python").withColumnsRenamed({"_name": "name", "_line": "lineno", "confidence": "ai_confidence"}).withColumns(
        {"ai_translated": F.lit(True), "original_language": F.col(language)}
    )


def mixed_classes(df: DataFrame, content: str, path: str, backend: translate.Backend, cache: DataFrame | None = None) -> DataFrame:
    """Classes of a mixed tree: Python files as they are, files of languages with classes by translation, others not at all."""
    ext = F.lower(sql.extension(F.col(path)))
    native = native_classes(df.filter(ext.isin(*rawcode.PYTHON_EXTENSIONS)), content)
    other = df.withColumn("_language", files.class_language_of(ext)).filter(F.col("_language").isNotNull())
    return native.unionByName(translated_classes(other, content, "_language", backend, cache).drop("_language"))
