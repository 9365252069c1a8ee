"""Files that no person wrote: generated, minified or bundled, vendored, or data saved as code.

Every function is lexed and emitted again in a canonical layout, and the gaps between its tokens and its line breaks are
compared with those of the original. A text that the canonical layout makes many times longer was minified; lines of one token pattern repeated at a short period were
written by a tool; literals that leave no room for code are data. Remarks at the head, well known path parts and the
token multisets of known library functions complete the picture. Features are taken per function, before any shuffle,
and only they are brought together per file.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEX = re.compile(
    r"""(?P<w>[A-Za-z_$\u0080-\U0010ffff][\w$]*)|(?P<c>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<s>"(?:[^"\\\n]|\\.)*"?|'(?:[^'\\\n]|\\.)*'?|`(?:[^`\\]|\\.)*`?)
    |(?P<n>0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<p>===|!==|\*\*=|\.\.\.|>>>|=>|&&|\|\||\?\?|\?\.|\+\+|--|[-+*/%=<>!&|^]=|<<|>>|[^\s\w])""",
    re.X | re.S,
)
_STATEMENT_WORDS = set("if for while switch catch return function let const var new try else do case default break throw".split())
_SPACED = set("= == === != !== < > <= >= + - * / % && || ?? => += -= *= /= ? : & | ^ << >> ,".split())

#: Tokens that stay on the line of the closing brace or statement before them.
_STAYS = {"else", "catch", "finally", ")", ",", ";"}
_FRAME_WORDS = {"return", "const", "let", "var", "module", "exports", "export", "default"}

#: Remarks by which tools mark their output, in a few languages, at the start of a remark.
_TOOL_REMARK = re.compile(
    r"""^[\s/*#!<\-]*(?:eslint-disable[^/\n]*\*/\s*//\s*)?(?:
    @generated\b|<?auto[- ]?generated\b|(?:this|the)\s+(?:file|code|module|class|source)\s+(?:was|is|has\s+been)\s+(?:auto(?:matically|[- ])?\s*)?(?:generated|produced|created|written)\s+(?:by|from|with|using|automatically)
    |(?:code|file|source|parser|automatically|machine)[- ](?:generated|written)\b|generated\s+(?:by|from|with|using|code|file|source|automatically|at|on)\b
    |autogenerated\b|built\s+from\s+\S+\.(?:proto|thrift|idl|graphql|xsd|wsdl|schema|ya?ml|json|xml|g4|y|tmpl)\b|compiled\s+(?:by|from|with)\s+\S+
    |automatisch\s+(?:erzeugt|generiert|erstellt)|g[ée]n[ée]r[ée]\s+(?:automatiquement|par|depuis)|generado\s+(?:autom[áa]ticamente|por|desde)
    |gerado\s+(?:automaticamente|por)|generato\s+(?:automaticamente|da)|otomatik\s+olarak|автоматически\s+(?:создан|сгенерирован)|сгенерировано|自动生成|自動生成
    )|changes\s+(?:to\s+this\s+file\s+)?will\s+be\s+(?:over-?written|lost)|(?-i:DO\s+NOT\s+(?:EDIT|MODIFY))|edit\s+\S+\.(?:tmpl|tpl|template|proto|j2)\s+instead
    |run\s+[`'"].*[`'"]\s+to\s+(?:refresh|regenerate|update)""",
    re.X | re.I,
)
_LIBRARY_REMARK = re.compile(
    r"^/\*!.*\bv?\d+\.\d+|@license\b|@preserve\b|\(c\)[^\n]*\bcontributors\b|\bcopyright\b[^\n]*\bcontributors\b|released under the \w+ licen[sc]e|\|\s*licen[sc]e:",
    re.I,
)
#: Path parts of third-party copies and of tool output.
VENDOR_PATH = (
    r"(^|/)(vendor|vendored|node_modules|third[_-]?party|bower_components|jspm_packages|external|externals|deps)/"
    r"|(^|/)[A-Za-z][A-Za-z_]*[@-]v?\d+\.\d+(\.\d+)*[^/]*/"
)
GENERATED_PATH = r"(^|/)(__generated__|generated|gen|autogenerated)/|[._](generated|pb|g|gen|designer)\.[a-z]+$|_pb2?\.[a-z]+$"
MINIFIED_PATH = r"[.-](min|bundle|packed)\.[a-z]+$|(^|/)(chunk|bundle|vendor|runtime)[.~-][0-9a-z.~-]+\.[a-z]+$"

#: A canonical layout this many times longer than the original is extreme.
EXPANSION = 2.5
TIGHT = 0.8
#: Lines of one pattern, at a period of up to PERIOD lines, in a run of at least REPEATS periods over this share of the lines.
PERIOD, REPEATS, UNIFORM = 4, 4, 0.5
DATA_CHARS, DATA_SHARE = 120, 0.8
ALIKE = 0.75


class Layout(NamedTuple):
    lines: int
    canonical_lines: int
    gaps: int
    closed_gaps: int
    code_chars: int
    data_chars: int
    uniform: bool
    tool_remark: bool
    library_remark: bool
    tokens: Counter


def _uniform(shapes: list[str]) -> bool:
    """Whether one pattern of a short period fills most of the lines."""
    n = len(shapes)
    for p in range(1, PERIOD + 1):
        run = best = 0
        for i in range(p, n):
            run = run + 1 if shapes[i] == shapes[i - p] else 0
            best = max(best, run)
        if best and best + p >= max(REPEATS * p, UNIFORM * n) and best + p >= REPEATS:
            return True
    return False


class Tok(NamedTuple):
    kind: str
    text: str
    line: int
    #: What stands before it in the original: nothing, blanks, or a line end.
    gap: int


NONE, BLANK, BREAK = range(3)


def lex(text: str) -> tuple[list[Tok], list[str]]:
    """Tokens and remarks of a source in C-like syntax; whatever stands there, lexing never fails."""
    tokens, remarks = [], []
    line = end = 0
    for m in _LEX.finditer(text):
        start, stop = m.span()
        gap = NONE
        if start > end:
            feeds = text.count("\n", end, start)
            line += feeds
            gap = BREAK if feeds else BLANK
        kind, tok, end = m.lastgroup, m.group(), stop
        if kind == "c":
            remarks.append(tok)
            line += tok.count("\n")
            continue
        tokens.append(Tok(kind, tok, line, gap))
        if kind == "s":
            line += tok.count("\n")
    return tokens, remarks


def canonical_gaps(tokens: list[Tok]) -> list[int]:
    """What the canonical layout puts before each token: a statement to a line, blocks on lines of their own, blanks round operators."""
    out: list[int] = []
    depth, last, ended = 0, None, False
    for t in tokens:
        tok = t.text
        if last is None:
            gap = BREAK
        elif (ended and tok not in _STAYS) or tok == "}":
            gap = BREAK
        elif tok in (";", ",", ")") or last.text == "(":
            gap = NONE
        elif ended or last.text in _SPACED or tok in _SPACED or tok == "{" or (last.text == ")" and t.kind == "w"):
            gap = BLANK
        else:
            gap = BLANK if last.kind in "wn" and t.kind in "wn" else NONE
        out.append(gap)
        depth = depth + 1 if tok == "(" else max(0, depth - 1) if tok == ")" else 0 if tok in "{}" else depth
        ended = tok in "{}" or (tok == ";" and depth == 0)
        last = t
    return out


def canonical(text: str) -> str:
    """The source written anew in the canonical layout, without its remarks."""
    tokens, _ = lex(text)
    lines: list[list[str]] = []
    level = 0
    for t, gap in zip(tokens, canonical_gaps(tokens)):
        level = max(0, level - (t.text == "}"))
        if gap == BREAK:
            lines.append(["  " * level])
        elif gap == BLANK:
            lines[-1].append(" ")
        lines[-1].append(t.text)
        level += t.text == "{"
    return "\n".join("".join(x) for x in lines)


def layout(text: str) -> Layout:
    """Original against canonical layout of one function or file. An empty text has zero lines."""
    tokens, remarks = lex(text)
    wanted = canonical_gaps(tokens)
    counts = Counter(t.text for t in tokens)
    # gaps that could be closed: two words always stand apart
    gaps = [t.gap for b, t, g in zip(tokens, tokens[1:], wanted[1:]) if g != NONE and not (g == BLANK and b.kind in "wn" and t.kind in "wn" and b.text not in _SPACED)]
    shapes: dict[int, list[str]] = defaultdict(list)
    code = literal = 0
    words: list[str] = []
    for i, t in enumerate(tokens):
        shapes[t.line].append({"s": "S", "n": "N"}.get(t.kind) or (t.text if t.kind == "p" or t.text in _STATEMENT_WORDS else "I"))
        code += len(t.text)
        literal += len(t.text) if t.kind in "sn" else i > 0 and t.kind == "p" and t.text in ",[]:-"
        if t.kind == "w" and t.text not in _FRAME_WORDS:
            words.append(t.text)
    lines = [re.sub(r"\[(?:-?[NS],?)+\]", "[]", "".join(x)) for _, x in sorted(shapes.items())]
    body = [s for s in lines if s not in ("{", "}", "};")]
    # a literal given back at once, or named and given back, and nothing else
    alone = counts[";"] <= 1 and len(words) <= 1 or counts[";"] == 2 and len(words) == 2 and len(set(words)) == 1
    data = literal if literal >= DATA_CHARS and literal >= DATA_SHARE * code and alone else 0
    told = any(_TOOL_REMARK.search(r) for r in remarks), any(_LIBRARY_REMARK.search(r) for r in remarks)
    return Layout(len(lines), wanted.count(BREAK), len(gaps), gaps.count(NONE), code, data, _uniform(body), *told, counts)


class LibraryIndex:
    """Token multisets of known library functions, found by their prefixes. Built from a catalogue of fixed size.

    A multiset that is alike shares at least that part of a known one's tokens, so it holds one of any prefix that is
    longer than the rest allowed to be missing; prefixes are the tokens that are rarest in the catalogue. Layout and
    common words alone are no copy: of an entry with long words one must be shared.
    """

    def __init__(self, bodies: list[str | None], least: float = ALIKE):
        self.least = least
        self.known = [c for b in bodies if b and sum((c := layout(b).tokens).values()) >= 12]
        self.sizes = [sum(c.values()) for c in self.known]
        self.long = [{t for t in c if len(t) > 6 and t[0].isalpha()} for c in self.known]
        #: Of each token, the entries that hold its k-th repetition in their prefix.
        self.by_token: dict[str, list[tuple[int, int]]] = defaultdict(list)
        often = Counter((t, k) for c in self.known for t, n in c.items() for k in range(n))
        for i, c in enumerate(self.known):
            rare = sorted(((t, k) for t, n in c.items() for k in range(n)), key=lambda x: (often[x], x))
            for t, k in rare[: self.sizes[i] - math.ceil(least * self.sizes[i]) + 1]:
                self.by_token[t].append((k, i))

    def has_like(self, tokens: Counter) -> bool:
        n, least = sum(tokens.values()), self.least
        near = {i for t, m in tokens.items() for k, i in self.by_token.get(t, ()) if k < m}
        for i in near:
            if min(n, self.sizes[i]) < least * max(n, self.sizes[i]) or self.long[i] and self.long[i].isdisjoint(tokens):
                continue
            both = sum(min(m, tokens.get(t, 0)) for t, m in self.known[i].items())
            if both >= least * (n + self.sizes[i] - both):
                return True
        return False


#: Catalogue entries that a task holds at a time; a larger catalogue is compared block by block.
CATALOG_BLOCK = 20_000


def _catalog_blocks(catalog: DataFrame | None) -> list[list[str]]:
    """Bodies of a catalogue in blocks of bounded size."""
    if catalog is None:
        return [[]]
    bodies = catalog.select("body_src").filter("body_src is not null")
    blocks = max(1, math.ceil(bodies.count() / (CATALOG_BLOCK // 2)))
    at = F.pmod(F.xxhash64("body_src"), F.lit(blocks))
    return [[r[0] for r in bodies.filter(at == i).collect()] for i in range(blocks)]


def file_features(df: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """One row for each file (repo, rel_file) with what its layout, remarks and path tell.

    df: rows fn_id, repo, rel_file, body_src, one for each function; redelivered rows count once. catalog: known library
    functions (body_src), compared in blocks of at most CATALOG_BLOCK. Null bodies count as empty.
    """
    numbers = ["lines", "canonical_lines", "gaps", "closed_gaps", "code_chars", "data_chars"]
    flags = ["uniform", "tool_remark", "library_remark", "library_like"]
    names = ["fn_id", "repo", "rel_file", *numbers, *flags]
    schema = "fn_id long, repo string, rel_file string, " + ", ".join([f"{n} long" for n in numbers] + [f"{n} boolean" for n in flags])

    def compared(bodies: list[str]):
        held: list[LibraryIndex] = []

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not held:
                held.append(LibraryIndex(bodies))
            for b in batches:
                rows = [layout(t or "") for t in b.column("body_src").to_pylist()]
                cols = [pa.array([x[i] for x in rows], pa.int64()) for i in range(6)]
                cols += [pa.array([x[i] for x in rows], pa.bool_()) for i in range(6, 9)]
                cols.append(pa.array([held[0].has_like(x.tokens) for x in rows], pa.bool_()))
                yield pa.RecordBatch.from_arrays([b.column(n) for n in ("fn_id", "repo", "rel_file")] + cols, names=names)

        return run

    rows = None
    for bodies in _catalog_blocks(catalog):
        part = df.select("fn_id", "repo", "rel_file", "body_src").mapInArrow(compared(bodies), schema)
        rows = part if rows is None else rows.unionByName(part)
    once = rows.groupBy("repo", "rel_file", "fn_id").agg(
        *[F.max(n).alias(n) for n in numbers], *[F.max(n).alias(n) for n in flags]
    )
    return once.groupBy("repo", "rel_file").agg(
        *[F.sum(n).alias(n) for n in numbers], *[F.max(n).alias(n) for n in flags], F.count(F.lit(1)).alias("functions")
    )


def reason() -> Column:
    """Why a file isn't hand-written, or null."""
    path = F.coalesce(F.col("rel_file"), F.lit(""))
    minified = (F.col("canonical_lines") >= F.col("lines") * EXPANSION) & (F.col("closed_gaps") >= F.col("gaps") * TIGHT) & (F.col("gaps") > 0)
    return (
        F.when(path.rlike(VENDOR_PATH) | F.col("library_remark") | F.col("library_like"), F.lit("vendored"))
        .when(path.rlike(MINIFIED_PATH) | minified, F.lit("minified"))
        .when(path.rlike(GENERATED_PATH) | F.col("tool_remark") | F.col("uniform"), F.lit("generated"))
        .when(F.col("data_chars") * 2 >= F.col("code_chars"), F.when(F.col("data_chars") > 0, F.lit("data")))
    )


def not_handwritten(df: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(repo, rel_file, reason) of the files that were generated, minified, copied or are data."""
    found = file_features(df, catalog).withColumn("reason", reason())
    return found.filter("reason is not null").select("repo", "rel_file", "reason")


def handwritten_rows(df: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """(fn_id, repo, rel_file, body_src) of the files that remain, each fn_id of a file once."""
    bad = not_handwritten(df, catalog).select(F.col("repo").alias("_r"), F.col("rel_file").alias("_f"))
    # one exchange by file serves the removal of repeats and the join
    rows = df.select("fn_id", "repo", "rel_file", "body_src").repartition("repo", "rel_file").groupBy("repo", "rel_file", "fn_id").agg(F.first("body_src").alias("body_src"))
    out = rows.join(bad.hint("merge"), rows.repo.eqNullSafe(bad._r) & rows.rel_file.eqNullSafe(bad._f), "left_anti")
    return out.select("fn_id", "repo", "rel_file", "body_src")
