"""Source files as tables: discovery, ignore lists, languages, remote listings, report output."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codeweft.functions import rawcode, sql

#: Directories that the walks leave out.
JS_PRUNED = ["node_modules", "__pycache__", "dist", "build", ".git"]
INDEX_PRUNED = ["__pycache__", ".git", "node_modules", "venv", ".venv", "dist", "build", ".tox"]
#: Fixed value: remote files of this size or more are left out.
REMOTE_LIMIT = 500_000


def discover(spark: SparkSession, root: str, extensions: list[str], recursive: bool = True, errors: str = "replace") -> DataFrame:
    """Files under a root with these extensions: path, rel_path, ext, lang, content, file_sha256, length.

    errors says what becomes of bytes that aren't UTF-8: replace or ignore. Names, sizes and extensions are filtered
    before any content is decoded.
    """
    glob = "*{" + ",".join(extensions) + "}"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(root)
    base = re.escape(re.sub(r"^[a-z]+:(//)?", "", root).rstrip("/"))
    rel = F.regexp_replace(F.col("path"), "^[a-z]+:(//)?" + base + "/", "")
    out = raw.select("path", rel.alias("rel_path"), sql.extension(F.col("path")).alias("ext"), decoded(F.col("content"), errors).alias("content"), F.sha2("content", 256).alias("file_sha256"), "length")
    return out.withColumn("lang", language_of(F.col("ext")))


def decoded(content: Column, errors: str = "replace") -> Column:
    """Text of UTF-8 bytes; errors says what becomes of others: replace or ignore. Null for null."""

    @F.pandas_udf("string")
    def run(b: pd.Series) -> pd.Series:
        return b.map(lambda x: None if x is None else bytes(x).decode("utf-8", errors))

    return run(content)


def from_bytes(df: DataFrame, path: str, content: str, errors: str = "replace") -> DataFrame:
    """Uploaded files, given as bytes in a column, as source files: path, rel_path, ext, lang, content, file_sha256, length."""
    ext = sql.extension(F.col(path))
    return df.select(
        F.col(path).alias("path"), F.col(path).alias("rel_path"), ext.alias("ext"), decoded(F.col(content), errors).alias("content"),
        F.sha2(content, 256).alias("file_sha256"), F.octet_length(content).cast("long").alias("length"),
    ).withColumn("lang", language_of(F.col("ext")))


class TreeListing(DataSource):
    """Repository tree listings, downloaded before, as a table: format("tree_listing").load(a JSON file or a folder of them).

    A listing is a JSON object whose tree is a list of entries (path, type, size). Every file is a partition of its own.
    Entries without a path are left out; the option repo names the repository, else it is the file's name.
    """

    @classmethod
    def name(cls) -> str:
        return "tree_listing"

    def schema(self) -> str:
        return "repo string, path string, type string, size long"

    def reader(self, schema):  # type: ignore[no-untyped-def]
        return _ListingReader(self.options)


class _ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)

    def partitions(self) -> list[InputPartition]:
        root = Path(self.options["path"].removeprefix("file:"))
        return [InputPartition(str(p)) for p in (sorted(root.glob("*.json")) if root.is_dir() else [root])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        at = Path(partition.value)
        for e in json.loads(at.read_text("utf-8")).get("tree") or []:
            if e.get("path"):
                yield self.options.get("repo", at.stem), e["path"], e.get("type"), e.get("size")


def register_sources(spark: SparkSession) -> None:
    """Makes the sources of this package known to spark.read.format."""
    spark.dataSource.register(TreeListing)


def literal_source(spark: SparkSession, text: str, name: str = "<stdin>") -> DataFrame:
    """A text given on standard input as the only file."""
    return spark.createDataFrame([(name, text)], "path string, content string")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def language_of(ext: Column) -> Column:
    """Language of a lower-cased extension, for functions; null if unknown."""
    extra = {".py": "Python", ".js": "JavaScript", ".jsx": "JavaScript", ".ts": "TypeScript", ".tsx": "TypeScript"}
    return F.element_at(_map(rawcode.FUNCTION_LANGUAGES | extra), F.lower(ext))


def class_language_of(ext: Column) -> Column:
    return F.element_at(_map(rawcode.CLASS_LANGUAGES), F.lower(ext))


def family_of(ext: Column) -> Column:
    """python, js, translated or null; as given, without lower-casing."""
    return (
        F.when(ext.isin(*rawcode.PYTHON_EXTENSIONS), F.lit("python"))
        .when(ext.isin(*rawcode.JS_EXTENSIONS), F.lit("js"))
        .when(ext.isin(*rawcode.FUNCTION_LANGUAGES), F.lit("translated"))
    )


def parse_ignore(lines: list[str]) -> list[str]:
    """Patterns of an ignore file: blank lines and those that begin with # are no patterns."""
    return [x.strip() for x in lines if x.strip() and not x.startswith("#")]


def ignore_paths(df: DataFrame, path: str, patterns: list[str]) -> DataFrame:
    """Rows whose path contains none of the patterns; a null path contains none."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(F.col(path).contains(p), F.lit(False))
    return df.filter(~hit)


def ignore_names(df: DataFrame, qualname: str, names: list[str]) -> DataFrame:
    """Rows whose full or short name isn't listed; null names stay."""
    if not names:
        return df
    full = F.col(qualname)
    listed = full.isin(*names) | F.element_at(F.split(full, r"\."), -1).isin(*names)
    return df.filter(~F.coalesce(listed, F.lit(False)))


def prune_directories(df: DataFrame, path: str, names: list[str], hidden: bool = True) -> DataFrame:
    """Rows whose directories are none of these and, with hidden, don't begin with a dot."""
    directories = F.slice(F.split(path, "/"), 1, F.greatest(F.lit(0), F.size(F.split(path, "/")) - 1))
    bad = F.exists(directories, lambda d: d.isin(*names) | (d.startswith(".") if hidden else F.lit(False)))
    return df.filter(~F.coalesce(bad, F.lit(False)))


def index_files(df: DataFrame, path: str, skipped: tuple[str, ...] = ("test_",)) -> DataFrame:
    """Python files as the resident index sees them, with indexed: false for names that begin in one of the skipped ways
    (tests, the tool's own files), which still count as scanned."""
    kept = prune_directories(df, path, INDEX_PRUNED, hidden=False).filter(F.col(path).endswith(".py"))
    name = F.element_at(F.split(path, "/"), -1)
    skip = F.lit(False)
    for prefix in skipped:
        skip = skip | name.startswith(prefix)
    return kept.withColumn("indexed", ~skip)


def remote_listing(df: DataFrame, extensions: list[str]) -> DataFrame:
    """Entries of a repository tree listing (path, type, size) that are fetched: blobs of these extensions below the size
    limit outside the pruned directories. A missing size counts as 0."""
    files = df.filter((F.col("type") == "blob") & sql.extension(F.col("path")).isin(*extensions) & (F.coalesce("size", F.lit(0)) < REMOTE_LIMIT))
    return prune_directories(files, "path", INDEX_PRUNED, hidden=False)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines without spaces; fields of all structs are in alphabetical order."""
    df.select(sql.canonical_json(df.schema).alias("value")).write.text(path)


CACHED = ["path", "file_sha256", "qualname", "lineno", "sem_hash"]


def write_cache(functions: DataFrame, path: str) -> None:
    """Keeps the hashes of scanned functions, for file_cache."""
    functions.select(*CACHED).write.mode("overwrite").option("compression", "zstd").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The kept hashes; an empty table where nothing was kept or it can't be read."""
    try:
        return spark.read.parquet(path).select(*CACHED)
    except AnalysisException:
        return spark.createDataFrame([], "path string, file_sha256 string, qualname string, lineno int, sem_hash string")


def file_cache(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(functions of unchanged files from the cache, files to scan again), by path and content digest."""
    keys = ["path", "file_sha256"]
    return cache.join(files.select(*keys), keys, "left_semi"), files.join(cache.select(*keys).distinct(), keys, "left_anti")
