"""Reports as tables of lines: JSON, Markdown and HTML, and archives of files.

A cluster can hold a third of all rows, so no report gathers one into a row: every occurrence is a line of its own, and
lines carry their place in the report, by which they are written in order from range partitions.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.functions import sql
from codeweft.operators import clusters

#: Fixed value: a preview of code has this many characters.
PREVIEW = 500
#: The words around the places of a duplicate.
FOUND_ALREADY = "⚠️  DUPLICATE DETECTED — this function already exists semantically:"
REUSE = "Consider reusing the existing function instead of creating a new one."
#: Bytes of content from which on a new archive is begun.
ARCHIVE_BYTES = 64 << 20


def preview(text: Column, n: int = PREVIEW) -> Column:
    """The first characters of a code."""
    return F.substring(text, 1, n)


def function_message(name: Column, file: Column, line: Column) -> Column:
    """What is said of one place of a function that exists already."""
    return F.concat(F.lit("  → "), name, F.lit("() in "), file, F.lit(" at line "), line.cast("string"))


def duplicate_message(matches: Column) -> Column:
    """Message on the places (name, file, lineno) at which a probe was found; null where there are none."""
    lines = F.transform(matches, lambda m: function_message(m["name"], m["file"], m["lineno"]))
    whole = F.concat_ws("\n", F.lit(FOUND_ALREADY), lines, F.lit(REUSE))
    return F.when(F.size(matches) > 0, whole)


def cluster_members(rows: DataFrame, key: str, place: list[str], least: int = 2) -> DataFrame:
    """Members of clusters: cluster_index by size and hash, n_members, the hash, and the place columns.

    Ordered by cluster_index and place they are the listing of a scan. Rows with a null hash take no part.
    """
    found = clusters.ordered_clusters(clusters.clusters(rows, key, place, least), key)
    return rows.select(key, *place).join(found.select(key, "cluster_index", "n_members").hint("merge"), key)


def json_lines(members: DataFrame, key: str, place: list[str], shown: int = 16) -> DataFrame:
    """(cluster_index, place..., value): each member as a JSON object with its fields in alphabetical order."""
    fields = {"hash": sql.display_hash(F.col(key), shown), "count": F.col("n_members")} | {p: F.col(p) for p in place}
    return members.select("cluster_index", *place, F.to_json(F.struct(*[fields[f].alias(f) for f in sorted(fields)])).alias("value"))


def markdown_lines(members: DataFrame, key: str, name: str, file: str, line: str, lang: str) -> DataFrame:
    """(cluster_index, rank, name, file, line, value): a heading for each cluster, rank 0, and an item for each member."""
    kept = [F.col(name).alias("name"), F.col(file).alias("file"), F.col(line).alias("line")]
    heading = F.concat(F.lit("## Cluster "), sql.display_hash(F.col(key)), F.lit("... ("), F.col("n_members").cast("string"), F.lit(" duplicates)"))
    heads = members.select("cluster_index", key, "n_members").distinct().select(
        "cluster_index", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), heading.alias("value")
    )
    item = F.concat(F.lit("- `"), F.coalesce(name, F.lit("")), F.lit("` in `"), F.col(file), F.lit("` (line "), F.col(line).cast("string"), F.lit(") ["), F.coalesce(lang, F.lit("")), F.lit("]"))
    return heads.unionByName(members.select("cluster_index", F.lit(1).alias("rank"), *kept, item.alias("value")))


def html_lines(members: DataFrame, key: str, name: str, file: str, line: str) -> DataFrame:
    """(cluster_index, rank, name, file, line, value): list items of an HTML page, with texts escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    item = F.concat(F.lit("<li><code>"), safe(name), F.lit("</code> in <code>"), safe(file), F.lit("</code> line "), safe(line), F.lit("</li>"))
    head = F.concat(F.lit("<h3>"), sql.display_hash(F.col(key)), F.lit(" ("), F.col("n_members").cast("string"), F.lit(")</h3>"))
    heads = members.select("cluster_index", key, "n_members").distinct().select(
        "cluster_index", F.lit(0).alias("rank"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"), head.alias("value")
    )
    return heads.unionByName(members.select("cluster_index", F.lit(1).alias("rank"), F.col(name).alias("name"), F.col(file).alias("file"), F.col(line).alias("line"), item.alias("value")))


def write_lines(lines: DataFrame, order: list[str], path: str) -> None:
    """Writes the value column as text; read in order of file name the lines are in the given order."""
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def archives(files: DataFrame, path: str, content: str, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """(n_files, archive binary): ZIP archives of text files, each of at most limit bytes of content or of one larger file.

    Files of a partition go into archives in turn, so nothing is gathered. Null contents count as empty. A file is packed
    as it comes: a worker holds one and the packed bytes of those before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buffer, archive, held, size = io.BytesIO(), None, 0, 0

        def packed() -> pa.RecordBatch:
            archive.close()
            ends = pa.array([0, buffer.tell()], pa.int32()).buffers()[1]
            data = pa.Array.from_buffers(pa.binary(), 1, [None, ends, pa.py_buffer(buffer.getbuffer())])
            return pa.RecordBatch.from_arrays([pa.array([held], pa.int64()), data], names=["n_files", "archive"])

        for b in batches:
            for name, text in zip(b.column(0), b.column(1)):
                data = (text.as_py() or "").encode("utf-8", "replace")
                if held and size + len(data) > limit:
                    yield packed()
                    buffer, archive, held, size = io.BytesIO(), None, 0, 0
                archive = archive or zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
                archive.writestr(name.as_py() or "", data)
                held, size = held + 1, size + len(data)
        if held:
            yield packed()

    return files.select(path, content).mapInArrow(run, "n_files long, archive binary")
