"""Packs: code stored once per structure, with its occurrences and names; restoring sources from them."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import pycanon, sql
from codeweft.operators.clusters import keep_first
from codeweft.operators.extract import documents
from codeweft.session import cut


class Pack:
    """roots: one row for each occurrence; nodes: graph nodes, each once; namemaps: names by occurrence."""

    def __init__(self, roots: DataFrame, nodes: DataFrame, namemaps: DataFrame):
        self.roots, self.nodes, self.namemaps = roots, nodes, namemaps

    def meta(self) -> DataFrame:
        """functions, unique_roots, nodes, namemaps as one row."""
        return (
            self.roots.agg(F.count(F.lit(1)).alias("functions"), F.count_distinct("root").alias("unique_roots"))
            .join(F.broadcast(self.nodes.agg(F.count(F.lit(1)).alias("nodes"))))
            .join(F.broadcast(self.namemaps.agg(F.count(F.lit(1)).alias("namemaps"))))
        )

    def write(self, path: str, compression: str = "zstd") -> None:
        for name in ("roots", "nodes", "namemaps"):
            getattr(self, name).write.option("compression", compression).parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Pack:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("roots", "nodes", "namemaps")))


def pack_python(functions: DataFrame, file: str, qualname: str, line: str, source: str) -> Pack:
    """Pack of Python functions. Those that don't parse are left out; equal nodes of all functions are kept once.

    The functions are encoded once, into a checkpoint that the three tables read.
    """
    docs = documents(
        functions.select(
            F.col(file).alias("file"), F.col(qualname).alias("qualname"), F.col(line).alias("lineno"), F.col(source).alias("_code"),
            sql.occurrence_key(F.col(file), F.col(qualname), F.col(line)).alias("occurrence_key"),
        ),
        "_code",
        every_node=False,
    ).drop("_code")
    docs = cut(docs)
    roots = docs.select("root", "file", "qualname", "lineno", "sir_sha256", "source_sha256", "occurrence_key")
    nodes = docs.select(F.explode("nodes").alias("n")).select("n.*").dropDuplicates(["node_id"])
    namemaps = docs.select("occurrence_key", F.col("root").alias("root_id"), F.col("name_map").alias("functions"))
    return Pack(roots, nodes, namemaps)


def restore_python(docs: DataFrame, rehydrate: bool = True) -> DataFrame:
    """docs (root, nodes, name_map and others) with restored_src: the source of the graph, with its own names if rehydrate."""

    def one(root: str, nodes: list, name_map: list) -> str:
        table = {n["node_id"]: {"t": n["t"], "f": json.loads(n["f_json"])} for n in nodes}
        functions = [{"orig_func": f["orig_func"], "canon_to_orig": dict(f["canon_to_orig"])} for f in name_map] if rehydrate else None
        return pycanon.decode(root, table, functions)

    @F.pandas_udf("string")
    def run(root: pd.Series, nodes: pd.Series, name_map: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(root, nodes, name_map)], dtype=object)

    return docs.withColumn("restored_src", run("root", "nodes", "name_map"))


def documents_of(pack: Pack) -> DataFrame:
    """Documents of all occurrences put together again: each root's nodes are gathered by following its references.

    References are followed level by level with joins, one round for each level of the deepest tree, and a graph's nodes
    end up in one array: they are the nodes of one function.
    """
    refs = pack.nodes.select("node_id", F.explode(F.array_distinct(F.regexp_extract_all("f_json", F.lit('"([0-9a-f]{64})"'), F.lit(1)))).alias("child"))
    reached = pack.roots.select("root").distinct().select("root", F.col("root").alias("node_id"))
    refs = cut(refs.join(pack.nodes.select(F.col("node_id").alias("child")), "child", "left_semi"))
    frontier = found = cut(reached)
    while True:
        nxt = frontier.join(refs, "node_id").select("root", F.col("child").alias("node_id")).distinct()
        frontier = cut(nxt.join(found, ["root", "node_id"], "left_anti"))
        if frontier.isEmpty():
            break
        found = cut(found.unionByName(frontier))
    graphs = found.join(pack.nodes, "node_id").groupBy("root").agg(F.collect_list(F.struct("node_id", "t", "f_json")).alias("nodes"))
    maps = pack.namemaps.select("occurrence_key", F.col("functions").alias("name_map"))
    return pack.roots.join(graphs, "root").join(maps, "occurrence_key", "left")


def first_store(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The store of a pack by hash: the first occurrence of every hash gives its columns. Null hashes are left out."""
    return keep_first(df.filter(F.col(key).isNotNull()).select(key, *dict.fromkeys([*order, *columns])), [key], order).select(key, *columns)


def pack_counts(df: DataFrame, key: str) -> DataFrame:
    """total, unique and duplicates of the rows with a hash."""
    return df.agg(F.count(key).alias("total"), F.count_distinct(key).alias("unique")).withColumn("duplicates", F.col("total") - F.col("unique"))


def restore_text(df: DataFrame, file: str, line: str, text: str, separator: str = "\n\n") -> DataFrame:
    """(file, content, n_functions): the texts of each file joined in order of line. A file's texts meet in one row, as the file itself does."""
    gathered = df.groupBy(file).agg(F.sort_array(F.collect_list(F.struct(F.col(line).alias("l"), F.col(text).alias("t")))).alias("_p"))
    return gathered.select(file, F.array_join(F.transform("_p", lambda x: x["t"]), separator).alias("content"), F.size("_p").alias("n_functions"))


def bundle_size(df: DataFrame, source: str, stored: str) -> DataFrame:
    """source_bytes, stored_bytes and ratio; 0 where there is no source."""
    out = df.agg(F.coalesce(F.sum(F.octet_length(source)), F.lit(0)).alias("source_bytes"), F.coalesce(F.sum(F.octet_length(stored)), F.lit(0)).alias("stored_bytes"))
    return out.withColumn("ratio", F.when(F.col("source_bytes") == 0, F.lit(0.0)).otherwise(F.col("stored_bytes") / F.col("source_bytes")))
