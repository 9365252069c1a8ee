"""Commands over source trees: python -m codeweft scan|health|class-scan|diff|verify|pack|restore|merge-plan PATH ...

Every command prints rows as JSON lines and returns an exit status; --output writes the rows to a folder instead.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeweft.functions import sql
from codeweft.functions.rawcode import JS_EXTENSIONS, PYTHON_EXTENSIONS
from codeweft.operators import classes, clusters, diff, extract, merge, pack, reports, scan
from codeweft.sources import files

PLACE = ["rel_path", "lineno", "name"]


def _tree(spark: SparkSession, a: argparse.Namespace, extensions: tuple[str, ...]) -> DataFrame:
    found = files.discover(spark, a.path, list(extensions), not a.no_recurse, "ignore")
    return files.ignore_paths(found, "rel_path", files.parse_ignore(a.ignore or []))


def _scan(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, int]:
    """Clusters of equal functions; strict fails where there are any."""
    found = scan.mixed_functions(_tree(spark, a, PYTHON_EXTENSIONS + JS_EXTENSIONS), "content", "rel_path")
    members = reports.cluster_members(found, "sem_hash", PLACE, a.min)
    status = scan.scan_summary(found, a.min).first().strict_exit if a.strict else 0
    return reports.json_lines(members, "sem_hash", PLACE).orderBy("cluster_index", *PLACE).select("value"), status


def _health(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, int]:
    found = scan.mixed_functions(_tree(spark, a, PYTHON_EXTENSIONS), "content", "rel_path", keep_unhashed=True)
    out = clusters.health_report(found.withColumn("all", F.lit("all")), "sem_hash", ["all"], count_unhashed=True)
    return out.select("total", "dup_members", F.col("health_cli").alias("health")), 0


def _class_scan(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, int]:
    """Exact clusters of classes and, below a similarity of 1, similar pairs."""
    rows = extract.python_classes(_tree(spark, a, PYTHON_EXTENSIONS), "content").select("rel_path", "name", "lineno", "bases", "methods", "class_hash", F.monotonically_increasing_id().alias("i"))
    hashed = rows.withColumn("folded_hash", F.col("class_hash")) if a.no_inheritance else classes.fold_inheritance(rows, "i", "name", "bases", "class_hash", "i")
    exact = reports.cluster_members(hashed, "folded_hash", PLACE)
    out = reports.json_lines(exact, "folded_hash", PLACE).orderBy("cluster_index", *PLACE).select("value")
    if a.min_similarity < 1:
        pairs = classes.similar_classes(hashed.withColumn("h", F.col("methods.hash")), "i", ["rel_path", "name"], "h", "folded_hash", a.min_similarity)
        side = lambda t: rows.select(F.col("i").alias(f"index_{t}"), F.struct("rel_path", "name").alias(f"class_{t}"))
        told = classes.ordered_pairs(pairs).join(side("a"), "index_a").join(side("b"), "index_b").orderBy("position").select("class_a", "class_b", F.round("similarity", 4).alias("similarity"))
        out = out.unionByName(told.select(sql.canonical_json(told.schema).alias("value")))
    return out, int(a.strict and not out.isEmpty())


def _hashes(spark: SparkSession, a: argparse.Namespace, path: str) -> DataFrame:
    found = scan.mixed_functions(_tree(spark, argparse.Namespace(**{**vars(a), "path": path}), PYTHON_EXTENSIONS), "content", "rel_path")
    return found.withColumn("label", sql.diff_label(F.col("rel_path"), F.col("name"), F.col("lineno")))


def _diff(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, int]:
    found = diff.hash_diff(_hashes(spark, a, a.path), _hashes(spark, a, a.other), "sem_hash", "label")
    return diff.ordered_diff(found, "sem_hash").orderBy("position").select("status", "label_a", "label_b"), 0


def _verify(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, int]:
    """Hashes of a pack that the tree lacks, and the other way round."""
    functions = extract.python_functions(_tree(spark, a, PYTHON_EXTENSIONS), "content").withColumn("sir_sha256", sql.sem_hash(F.col("source")))
    out = diff.verify(pack.Pack.read(spark, a.other).roots, functions, "sir_sha256")
    return out, int(not out.isEmpty())


def _pack(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, int]:
    functions = extract.python_functions(_tree(spark, a, PYTHON_EXTENSIONS), "content")
    made = pack.pack_python(functions, "rel_path", "name", "lineno", "source")
    made.write(a.other)
    return made.meta(), 0


def _restore(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, int]:
    """All functions of a pack with their names."""
    back = pack.restore_python(pack.documents_of(pack.Pack.read(spark, a.path)))
    return back.select("occurrence_key", "file", "qualname", "lineno", "restored_src"), 0


def _merge_plan(spark: SparkSession, a: argparse.Namespace) -> tuple[DataFrame, int]:
    functions = extract.python_functions(_tree(spark, a, PYTHON_EXTENSIONS), "content", methods=False).withColumn("h", sql.sem_hash(F.col("source")))
    return merge.merge_plan(functions, "h", "rel_path", "name", "lineno").orderBy("cluster_index", "file", "lineno"), 0


COMMANDS = {"scan": _scan, "health": _health, "class-scan": _class_scan, "diff": _diff, "verify": _verify, "pack": _pack, "restore": _restore, "merge-plan": _merge_plan}


def run(spark: SparkSession, arguments: list[str]) -> tuple[DataFrame, int]:
    """Rows and exit status of a command line."""
    p = argparse.ArgumentParser(prog="codeweft")
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("path", help="a folder of sources, or a pack to restore")
    p.add_argument("other", nargs="?", help="the second folder, or the folder of a pack")
    p.add_argument("--min", type=int, default=2, help="least size of a cluster")
    p.add_argument("--min-similarity", type=float, default=1.0)
    p.add_argument("--no-inheritance", action="store_true")
    p.add_argument("--no-recurse", action="store_true")
    p.add_argument("--strict", action="store_true", help="exit with 1 where duplicates are found")
    p.add_argument("--ignore", action="append", help="leave out paths that contain this")
    p.add_argument("--output", help="folder for the rows")
    a = p.parse_args(arguments)
    rows, status = COMMANDS[a.command](spark, a)
    if a.output:
        files.write_report(rows, a.output)
    return rows, status


def main() -> int:
    from codeweft.session import get_spark

    spark = get_spark()
    rows, status = run(spark, sys.argv[1:])
    for line in rows.toJSON().toLocalIterator():
        print(line)
    return status
