"""Extraction operators: one row of source text to many rows of functions, classes or blocks."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codeweft import schemas
from codeweft.functions import jscanon, pycanon, pysource, rawcode, universal
from codeweft.functions.sql import document

log = logging.getLogger(__name__)


#: Rows, and bytes of texts and of columns that come along, after which a batch goes out.
OUT_ROWS, OUT_BYTES = 10_000, 8 << 20


def explode_text(df: DataFrame, inputs: list[str], make: Callable[..., list[tuple]], schema: str, keep: list[str] | None = None) -> DataFrame:
    """Columns of df with the rows that make gives for the input columns of each row, numbered by walk_ord from 0.

    keep: the columns that come along, all by default. Each row that make gives has a copy of them, so a text that gives
    many rows should stay behind. Rows for which make gives nothing vanish. Null inputs are passed on as None. Columns of
    df that clash with those of schema give way. A worker holds one row's input and result and one batch that goes out.
    """
    given = StructType.fromDDL(schema)
    keep = [c for c in (df.columns if keep is None else keep) if c not in given.fieldNames() and c != "walk_ord"]
    whole = StructType([f for f in df.schema.fields if f.name in keep] + [*given.fields, *StructType.fromDDL("walk_ord int").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = to_arrow_schema(given)

        def batch(b: pa.RecordBatch, rows: list[int], found: list[tuple], order: list[int]) -> pa.RecordBatch:
            taken = [b.column(c).take(pa.array(rows, pa.int64())) for c in keep]
            made = [pa.array(list(c), f.type) for c, f in zip(zip(*found), target)]
            return pa.RecordBatch.from_arrays([*taken, *made, pa.array(order, pa.int32())], names=[*keep, *target.names, "walk_ord"])

        for b in batches:
            given_columns, kept_columns = [b.column(f"_in_{c}") for c in inputs], [b.column(c) for c in keep]
            rows, found, order, size = [], [], [], 0
            for i in range(b.num_rows):
                kept = sum(c.slice(i, 1).nbytes for c in kept_columns)
                for j, x in enumerate(make(*(c[i].as_py() for c in given_columns))):
                    more = kept + sum(len(v) for v in x if isinstance(v, str))
                    if rows and (size + more > OUT_BYTES or len(rows) >= OUT_ROWS):
                        yield batch(b, rows, found, order)
                        rows, found, order, size = [], [], [], 0
                    rows.append(i)
                    found.append(x)
                    order.append(j)
                    size += more
            if rows:
                yield batch(b, rows, found, order)

    return df.select(*keep, *[F.col(c).alias(f"_in_{c}") for c in inputs]).mapInArrow(run, whole)


def _guard(make: Callable[[str], list[tuple]], on_error: str) -> Callable[[str | None], list[tuple]]:
    def run(text: str | None) -> list[tuple]:
        if text is None:
            return []
        try:
            return make(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            if on_error == "fail":
                raise
            return []

    return run


def python_functions(df: DataFrame, content: str, mode: str = "top", methods: bool = True, on_error: str = "skip", keep: list[str] | None = None) -> DataFrame:
    """Functions of Python sources: name, lineno, source.

    mode: top (module level and, with methods, one class level, as Class.method), walk_segment (any depth, source from
    def on), walk_lines (any depth, whole lines, so that indented functions don't parse alone). on_error: skip or fail
    for sources that don't parse. Null and empty sources give nothing. keep: see explode_text.
    """
    make = {
        "top": lambda t: pysource.top_functions(t, methods),
        "walk_segment": pysource.all_functions,
        "walk_lines": lambda t: pysource.all_functions(t, whole_lines=True),
    }[mode]
    return explode_text(df, [content], _guard(make, on_error), schemas.FUNCTION, keep)


def hashed_functions(df: DataFrame, content: str, variant: str = pycanon.STRICT, source: bool = True, keep: list[str] | None = None) -> DataFrame:
    """Functions of module and classes as python_functions gives them, with sem_hash, in one pass; without source that stays behind.

    One worker finds and hashes them, where a hash column behind python_functions takes a second one beside it.
    """

    def make(text: str) -> list[tuple]:
        found = pysource.top_functions(text)
        hashes = {code: pycanon.hash_or_none(code, variant) for code in {f.source for f in found}}
        return [(f.name, f.line, *([f.source] if source else []), hashes[f.source]) for f in found]

    schema = schemas.FUNCTION if source else "name string, lineno int"
    return explode_text(df, [content], _guard(make, "skip"), f"{schema}, sem_hash string", keep)


def python_classes(df: DataFrame, content: str) -> DataFrame:
    """Classes with methods of Python sources; sources that don't parse give nothing."""
    return explode_text(df, [content], _guard(lambda t: [(c.name, c.line, c.bases, c.methods, c.hash) for c in pysource.classes(t)], "skip"), schemas.CLASS)


def js_functions(df: DataFrame, content: str, typescript: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """JavaScript and TypeScript functions: name, lineno, params, body_src. typescript: a boolean column. keep: see explode_text."""

    def make(text: str | None, ts: bool | None = False) -> list[tuple]:
        return [(f.name, f.line, f.params, jscanon.source_of(f.body)) for f in jscanon.functions(text or "", bool(ts))]

    return explode_text(df, [content, *([typescript] if typescript else [])], make, schemas.JS_FUNCTION, keep)


def universal_functions(df: DataFrame, content: str, path: str) -> DataFrame:
    """Functions of .py, .js, .jsx, .ts and .tsx sources with their universal hash; other files give nothing."""

    def make(text: str | None, name: str | None) -> list[tuple]:
        low = name or ""
        if low.endswith(".py"):
            out = []
            for node in pycanon.parse(text or "").body:
                inside = [(f"{node.name}.{x.name}", x) for x in node.body] if type(node).__name__ == "ClassDef" and all(hasattr(x, "name") for x in node.body) else []
                for qualname, f in [(getattr(node, "name", ""), node), *inside]:
                    if type(f).__name__ in ("FunctionDef", "AsyncFunctionDef"):
                        out.append((qualname, f.lineno, universal.universal_hash(universal.python_tokens(f))))
            return out
        if low.endswith(rawcode.JS_EXTENSIONS):
            found = jscanon.functions(text or "", low.endswith((".ts", ".tsx")))
            return [(f.name, f.line, universal.universal_hash(universal.js_tokens(f))) for f in found]
        return []

    def guarded(text: str | None, name: str | None) -> list[tuple]:
        try:
            return make(text, name)
        except (SyntaxError, ValueError, RecursionError):
            return []

    return explode_text(df, [content, path], guarded, "name string, lineno int, universal_hash string")


def raw_functions(df: DataFrame, content: str, language: str, quirks: bool = True) -> DataFrame:
    """Function blocks of other languages; a null language counts as unknown."""
    return explode_text(df, [content, language], lambda t, lang: rawcode.raw_functions(t or "", lang or "", quirks), schemas.BLOCK)


def raw_classes(df: DataFrame, content: str, language: str, plain: bool = False) -> DataFrame:
    """Class blocks of other languages. plain: by language words alone."""
    find = rawcode.plain_classes if plain else rawcode.raw_classes
    return explode_text(df, [content, language], lambda t, lang: find(t or "", lang or ""), schemas.BLOCK)


#: Node ids that a worker remembers to have given out.
GIVEN_NODES = 1_000_000


def documents(df: DataFrame, code: str, variant: str = pycanon.STRICT, every_node: bool = True) -> DataFrame:
    """Graph documents of codes: root, digests, nodes, name map. What doesn't parse gives no row.

    every_node: each row has all nodes of its graph; else a worker may leave out nodes that it gave with an earlier row
    of the same partition, which is what a store of different nodes needs, and keeps the rows small.
    """

    given: set[str] = set()

    def make(text: str | None) -> list[tuple]:
        row = document(text, variant) if text is not None else None
        if row and not every_node:
            if len(given) > GIVEN_NODES:
                given.clear()
            new = [n for n in row[3] if n[0] not in given]
            given.update(n[0] for n in new)
            row = (*row[:3], new, row[4])
        return [row] if row else []

    return explode_text(df, [code], make, schemas.DOCUMENT).drop("walk_ord")
