"""Translation by an outside backend: cache, tries, validity and confidence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import pycanon, pysource, sql
from codeweft.session import cut

#: Confidence levels; LOW is not cached.
HIGH, MEDIUM, LOW, FAILED = "HIGH", "MEDIUM", "LOW", "FAILED"
TRIES = 2

#: A backend takes a language, a code and the number of the call, and gives a raw answer or raises.
Backend = Callable[[str, str, int], str]


def confidence(valid1: Column, hash1: Column, valid2: Column, hash2: Column) -> Column:
    """Confidence from the validity and hashes of two translations; valid2 is null where there was no second one."""
    no = F.lit(False)
    second = F.coalesce(valid2, no) & hash2.isNotNull() & hash1.isNotNull()
    return F.when(~F.coalesce(valid1, no), F.lit(FAILED)).when(second & (hash1 == hash2), F.lit(HIGH)).when(second, F.lit(LOW)).otherwise(F.lit(MEDIUM))


def confidence_counts(df: DataFrame, level: str) -> DataFrame:
    """(confidence, n): rows at each level; a missing level counts as MEDIUM."""
    return df.groupBy(F.coalesce(F.col(level), F.lit(MEDIUM)).alias("confidence")).agg(F.count(F.lit(1)).alias("n"))


def recorded_backend(answers: dict[tuple[str, str], list[str]]) -> Backend:
    """A backend that repeats recorded answers, the call's own or the last, and raises where there are none."""

    def call(language: str, code: str, number: int) -> str:
        given = answers[(language, code)]
        return given[min(number, len(given) - 1)]

    return call


def available(backends: dict[str, Backend], language: str = "Java", code: str = "") -> dict[str, bool]:
    """Which backends answer at all: each is asked once."""

    def answers(backend: Backend) -> bool:
        try:
            return backend(language, code, 0) is not None
        except Exception:  # noqa: BLE001 - whatever a backend raises, it doesn't answer
            return False

    return {name: answers(b) for name, b in backends.items()}


def _translate(language: str, code: str, backend: Backend, wanted: str, check: bool) -> tuple:
    clean = pysource.clean_class_translation if wanted != "function" else pysource.clean_translation

    def digest(text: str) -> str | None:
        if wanted == "function":
            return pycanon.hash_or_none(text, pycanon.AGGRESSIVE)
        found = pysource.classes(text)
        return found[0].hash if found else None

    text, error, calls = None, "", 0
    for _ in range(TRIES):
        try:
            answer = clean(backend(language, code, calls))
            problem = pysource.translation_error(answer, wanted)
            text, error = (answer, "") if problem is None else (None, problem)
        except Exception as e:  # noqa: BLE001 - whatever a backend raises is a failed try
            error = str(e)
        calls += 1
        if text is not None:
            break
    if text is None:
        return None, FAILED, error, None, None
    first = digest(text)
    if not check or first is None:
        return text, MEDIUM, "", first, None
    try:
        answer = clean(backend(language, code, calls))
        if pysource.translation_error(answer, wanted) is None and (second := digest(answer)):
            return (text, HIGH, "", first, second) if second == first else (text, LOW, "the two translations differ", first, second)
    except Exception:  # noqa: BLE001
        pass
    return text, MEDIUM, "", first, None


RESULT = "cache_key string, language string, python_src string, confidence string, error string, hash1 string, hash2 string"


def translate(wanted_rows: DataFrame, language: str, code: str, backend: Backend, cache: DataFrame | None = None, wanted: str = "function", check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows with their translation and cache_hit, new cache rows).

    Every different (language, code) is looked up in the cache by its key; only misses go to the backend, once each.
    HIGH, MEDIUM and FAILED results are for the cache, LOW ones are not. wanted: function, class or class_with_methods.
    Rows without a language or code get no translation.
    """
    key = sql.cache_key(F.col(language), F.col(code)) if wanted == "function" else sql.class_cache_key(F.col(language), F.col(code), wanted == "class_with_methods")
    rows = wanted_rows.withColumn("cache_key", key)
    distinct = rows.filter(F.col("cache_key").isNotNull()).select("cache_key", F.col(language).alias("language"), F.col(code).alias("code")).dropDuplicates(["cache_key"])
    misses = distinct.join(cache.select("cache_key"), "cache_key", "left_anti") if cache is not None else distinct

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [(k, lang, *_translate(lang, c, backend, wanted, check)) for k, lang, c in zip(pdf.cache_key, pdf.language, pdf.code)]
            yield pd.DataFrame(got, columns=_RESULT_COLUMNS)

    # a backend is asked once, whatever is made of the answers
    fresh = cut(misses.mapInPandas(run, RESULT)).withColumn("cache_hit", F.lit(False))
    known = fresh if cache is None else cache.select(*_RESULT_COLUMNS, F.lit(True).alias("cache_hit")).unionByName(fresh)
    return rows.join(known.drop("language"), "cache_key", "left"), fresh.filter(F.col("confidence") != LOW).drop("cache_hit")


_RESULT_COLUMNS = [x.split()[0] for x in RESULT.split(", ")]


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The kept translations, each key once with its last one; an empty table where there are none."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], RESULT)
    rest = [c for c in _RESULT_COLUMNS if c != "cache_key"]
    last = rows.groupBy("cache_key").agg(F.max(F.struct("added", *rest)).alias("r"))
    return last.select("cache_key", *[F.col(f"r.{c}").alias(c) for c in rest])


def add_to_cache(fresh: DataFrame, path: str) -> None:
    """Keeps new results, but not those of LOW confidence; files that are there stay as they are."""
    rows = fresh.filter(F.coalesce("confidence", F.lit(MEDIUM)) != LOW).select(*_RESULT_COLUMNS, F.current_timestamp().alias("added"))
    rows.write.mode("append").option("compression", "zstd").parquet(path)


def clear_cache(spark: SparkSession, path: str) -> None:
    """Drops all kept translations; the table stays, empty."""
    spark.createDataFrame([], RESULT + ", added timestamp").write.mode("overwrite").parquet(path)


def usable(df: DataFrame, level: str = "confidence", text: str = "python_src") -> DataFrame:
    """Rows whose translation can be used."""
    return df.filter((F.coalesce(F.col(level), F.lit(MEDIUM)) != FAILED) & (F.length(text) > 0))
