"""Merging duplicates: which copy stays, which go and what replaces them, and the rewritten files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.functions import pysource, sql
from codeweft.operators.clusters import clusters, health_after_merge, health_ui, ordered_clusters
from codeweft.operators.extract import explode_text

#: Fixed value: the module that the canonical functions go to.
UTILS = "utils"


def merge_plan(df: DataFrame, key: str, file: str, name: str, line: str, keep: DataFrame | None = None) -> DataFrame:
    """One row for each copy that goes: cluster_index, key, file, name, lineno, canonical_*, module, import_statement.

    The copy first in order of file and line stays; places that are equal to it in file, line and name are it. Clusters
    are numbered by size. Copies stay rows, so that a cluster of any size is planned. keep: (key, file, name, lineno), the
    copies chosen to stay in place of the first; one that isn't in its cluster counts for nothing.
    """
    rows = df.filter(F.col(key).isNotNull()).select(F.col(key), F.col(file).alias("file"), F.col(name).alias("name"), F.col(line).alias("lineno")).distinct()
    found = ordered_clusters(clusters(rows, key, ["file", "lineno", "name"]), key, by_first=True)
    canonical = found.select(
        F.col(key), "cluster_index", F.col("first.file").alias("canonical_file"), F.col("first.name").alias("canonical_name"), F.col("first.lineno").alias("canonical_lineno")
    )
    if keep is not None:
        place = F.struct("file", "name", "lineno")
        chosen = rows.join(keep.select(F.col(key), *[F.col(c).alias(c) for c in ("file", "name", "lineno")]).distinct(), [key, "file", "name", "lineno"])
        chosen = chosen.groupBy(key).agg(F.min(place).alias("_c"))
        canonical = canonical.join(chosen, key, "left").select(
            key, "cluster_index", *[F.when(F.col("_c").isNotNull(), F.col(f"_c.{c}")).otherwise(F.col(f"canonical_{c}")).alias(f"canonical_{c}") for c in ("file", "name", "lineno")]
        )
    gone = rows.join(canonical, key).filter(
        ~(F.col("file").eqNullSafe(F.col("canonical_file")) & F.col("lineno").eqNullSafe(F.col("canonical_lineno")) & F.col("name").eqNullSafe(F.col("canonical_name")))
    )
    module = sql.module_name(F.col("canonical_file"))
    return gone.withColumn("module", module).withColumn("import_statement", sql.import_statement(module, F.col("canonical_name"), F.col("name")))


def apply_plan(files: DataFrame, plan: DataFrame, path: str = "path", content: str = "content", imports: bool = True) -> DataFrame:
    """(path, new_source, removed int, error) of the files with copies that go; nothing is written.

    The removals of a file are gathered to the file's row; there are no more of them than functions in the file. Files
    that don't parse keep their text and say why. An import is added for every copy whose canonical one is elsewhere,
    unless imports is false, as in a merge that only deletes; then none is gathered.
    """
    statements = F.sort_array(F.collect_set(F.when(F.col("file") != F.col("canonical_file"), F.col("import_statement"))))
    removals = plan.groupBy(F.col("file").alias(path)).agg(
        F.sort_array(F.collect_list(F.struct("lineno", "name"))).alias("_r"), *([statements.alias("_i")] if imports else [])
    )
    # plain arrays: a worker makes a dictionary of each struct
    gathered = removals.select(path, F.col("_r.lineno").alias("_l"), F.col("_r.name").alias("_n"), *(["_i"] if imports else []))

    def one(text: str | None, lines: list, names: list, new_imports: list | tuple = ()) -> list[tuple[str | None, int, str | None]]:
        try:
            new = pysource.remove_functions(text or "", list(zip(names, lines)))
            new = pysource.add_imports(new, [x for x in new_imports if x])
            return [(new, len(lines), None)]
        except (SyntaxError, ValueError, RecursionError) as e:
            return [(text, 0, str(e))]

    return _rewritten(files.join(gathered, path), [content, "_l", "_n", *(["_i"] if imports else [])], one, "new_source string, removed int, error string", path)


def _rewritten(df: DataFrame, inputs: list[str], make: Callable[..., list[tuple]], schema: str, path: str) -> DataFrame:
    """path and what make gives for each file. A worker takes file by file, for a file's text and members may be large."""
    return explode_text(df, inputs, make, schema, [path]).drop("walk_ord")


def apply_js(files: DataFrame, plan: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, new_source): files without their copies, calls turned to the canonical name, which utils.js gives.

    Where the plan names the canonical file, the canonical copy goes from it too.
    """
    every = plan.select("file", "name", "canonical_name")
    if "canonical_file" in plan.columns:  # the canonical copy goes to utils.js too
        every = every.unionByName(plan.select(F.col("canonical_file").alias("file"), F.col("canonical_name").alias("name"), "canonical_name").distinct())
    removals = every.groupBy(F.col("file").alias(path)).agg(F.sort_array(F.collect_set(F.struct("name", "canonical_name"))).alias("_r"))

    def one(text: str | None, wanted: list) -> list[tuple[str]]:
        names = {r["name"]: r["canonical_name"] for r in wanted}
        return [(pysource.rewrite_js(text or "", names, sorted(set(names.values()))),)]

    return _rewritten(files.join(removals, path), [content, "_r"], one, "new_source string", path)


def apply_python(files: DataFrame, plan: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, new_source, error) of the files with members of clusters: all of them go, calls turn to the canonical name,
    and the canonical functions are imported from the shared module.

    The source is written anew, as calls change inside it. A file's members are gathered to its row; there are no more of
    them than functions in the file. Files that don't parse keep their text and say why.
    """
    canonical = plan.select(F.col("canonical_file").alias("file"), F.col("canonical_name").alias("name"), F.col("canonical_lineno").alias("lineno"), "canonical_name").distinct()
    every = plan.select("file", "name", "lineno", "canonical_name").unionByName(canonical)
    wanted = every.groupBy(F.col("file").alias(path)).agg(F.sort_array(F.collect_set(F.struct("name", "lineno", "canonical_name"))).alias("_r"))

    def one(text: str | None, members: list) -> list[tuple[str | None, str | None]]:
        try:
            new = pysource.remove_functions(text or "", [(m["name"], m["lineno"]) for m in members])
            new = pysource.rename_calls(new, {m["name"]: m["canonical_name"] for m in members})
            new = pysource.add_imports(new, [f"from {UTILS} import {name}" for name in sorted({m["canonical_name"] for m in members})])
            return [(new, None)]
        except (SyntaxError, ValueError, RecursionError) as e:
            return [(text, str(e))]

    return _rewritten(files.join(wanted, path), [content, "_r"], one, "new_source string, error string", path)


def utils_module(files: DataFrame, plan: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(name, source) of the shared module: the canonical functions, of several of one name the first by file.

    Sources are taken from the files as they were. A name that its file doesn't hold gives no row.
    """
    wanted = plan.groupBy(F.col("canonical_file").alias(path)).agg(F.collect_set("canonical_name").alias("_n"))
    found = _rewritten(files.join(wanted, path), [content, "_n"], lambda text, names: list(pysource.find_functions(text, names).items()), "name string, source string", path)
    return found.groupBy("name").agg(F.min(F.struct(path, "source")).getField("source").alias("source"))


def restore_files(functions: DataFrame, key: str, file: str, name: str, line: str, source: str) -> tuple[DataFrame, DataFrame]:
    """(files, utils): whole files put together from functions, without those that have copies.

    files: (path, content, n_functions) with the unique functions of each file in order of line, behind an import of the
    canonical functions whose copies it had. utils: (name, source), one row for each cluster's first function. A file
    with copies only keeps its import; functions without a hash or a name count as unique. A file's unique functions meet
    in one row, as in the file itself. Sources go by the aggregate of their hash alone, where those of copies are left on the
    map side; no join moves them.
    """
    named = F.when(F.col(name).isNotNull(), F.col(key))
    rows = functions.select(named.alias("k"), F.col(file).alias("path"), F.col(name).alias("name"), F.col(line).alias("lineno"), F.col(source).alias("source"))
    every = clusters(rows, "k", ["path", "lineno", "name", "source"], least=1)
    found = every.filter(F.col("n_members") > 1).select("k", F.col("first.name").alias("canonical"), F.col("first.source").alias("canonical_source"))
    alone = every.filter(F.col("n_members") == 1).select("first.path", "first.lineno", "first.name", "first.source")
    own = alone.unionByName(rows.filter(F.col("k").isNull()).drop("k")).select("path", F.struct("lineno", "name", "source").alias("own"), F.lit(None).cast("string").alias("canonical"))
    shared = rows.select("k", "path").distinct().join(found.select("k", "canonical"), "k").select("path", F.lit(None).cast(own.schema["own"].dataType).alias("own"), "canonical")
    gathered = own.unionByName(shared).groupBy("path").agg(F.sort_array(F.collect_list("own")).alias("_own"), F.sort_array(F.collect_set("canonical")).alias("_shared"))
    imported = F.when(F.size("_shared") > 0, F.array(F.concat(F.lit(f"from {UTILS} import "), F.array_join("_shared", ", ")))).otherwise(F.array().cast("array<string>"))
    text = F.array_join(F.concat(imported, F.transform("_own", lambda x: x["source"])), "\n\n")
    utils = found.groupBy(F.col("canonical").alias("name")).agg(F.min(F.struct("k", "canonical_source")).getField("canonical_source").alias("source"))
    return gathered.select("path", text.alias("content"), F.size("_own").alias("n_functions")), utils


def translated_report(df: DataFrame, key: str, lang: str, file: str, name: str, line: str, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """(summary, clusters) of functions of several languages, joined by the hash of their translations.

    summary: total, duplicate_clusters, cross_language, health_before, health_after. clusters: key, n_members,
    n_languages, first struct. Rows without a hash count as failed translations and take no part.
    """
    rows = df.filter(F.col(key).isNotNull())
    found = clusters(rows, key, [file, line, name], 1, lang)
    dup = F.col("n_members") >= least
    sums = found.agg(
        F.coalesce(F.sum("n_members"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("unique"), F.count_if(dup).alias("duplicate_clusters"),
        F.count_if(dup & (F.col("n_languages") > 1)).alias("cross_language"), F.coalesce(F.sum(F.when(dup, F.col("n_members") - 1)), F.lit(0)).alias("_extra"),
    )
    total, unique = F.col("total"), F.col("unique")
    summary = sums.withColumns({"health_before": health_ui(total, unique), "health_after": health_after_merge(total, unique, F.col("_extra"))}).drop("_extra", "unique")
    return summary, found.filter(dup)


def lines_saved(files: DataFrame, rewritten: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """lines_before, lines_after, saved: lines that aren't blank, over the files that were rewritten."""
    both = files.join(rewritten, path)
    return both.agg(F.sum(sql.nonblank_lines(F.col(content))).alias("lines_before"), F.sum(sql.nonblank_lines(F.col("new_source"))).alias("lines_after")).withColumn(
        "saved", F.col("lines_before") - F.col("lines_after")
    )
