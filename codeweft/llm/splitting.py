"""Cutting oversized texts at natural boundaries, with overlap, by pointer doubling.

A text is a sequence of atoms: lines, in long lines words, and in long words tokens that end where characters do; each
boundary has the level of what ends there, a cue, a line, a sentence or a word. Runs without spaces have sentences and
words too, by their marks and changes of script. Token counts add up over lines, for the tokenizer's
splits end where lines do. Every boundary is joined to its farthest legal successor, the best boundary within the limit, counting the
overlap that the next piece starts with. The successor table is squared until all greedy cuts of all texts of a batch
are marked, without walking any text from its start.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeweft.llm import tokens

#: Levels of a boundary, from none to the end of a cue.
CHAR, WORD, SENTENCE, LINE, CUE = range(5)
#: A cut or start at a higher level is preferred if the piece still has this share of the limit, or of the overlap.
FILL = 0.5
_WORDS = re.compile(r"\s*\S+|\s+")
_CLOSERS = r"[\"'»”’)\]」』）】》〉]*"
_SENTENCE_END = re.compile(rf"[.!?…。！？؟．｡۔।]+{_CLOSERS}\s*$")
#: Inside a run, marks that abbreviations, numbers and addresses hold too count only beside a character beyond ASCII.
_RUN_SENTENCE_END = re.compile(rf"(?:[…。！？؟．｡۔।][.!?…。！？؟．｡۔।]*|(?<=[^\x00-\x7f])[.!?]+|[.!?]+(?=[\"')\]]*[^\x00-\x7f])){_CLOSERS}")
#: Words of a run without spaces, with the openers before and the marks behind; hiragana ends the word before it.
_PARTS = regex.compile(
    r"[\p{Ps}\p{Pi}]*(?:[\p{Han}々〆]+\p{Hiragana}*|\p{Hiragana}+|[\p{Katakana}ー]+|\p{Hangul}+"
    r"|(?:(?![\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}ー])[\p{L}\p{M}\p{N}_]|(?<=\p{L})['’](?=\p{L}))+|.)[^\s\p{L}\p{N}\p{Ps}\p{Pi}_]*",
    regex.S,
)
#: Spaces to Python, but not to every tokenizer.
_SEPARATORS = re.compile(r"[\x1c-\x1f]")
#: Lines and words above this share of the limit, or above FILL of the overlap, are taken apart.
LONG_LINE = 0.25


_BYTE_LENGTHS: dict[int, np.ndarray] = {}


def _run(run: str, limit: int, ids) -> list[tuple[int, int, int]]:
    """Boundaries inside a long run with level and tokens.

    They lie where a token and a character end together: a token sequence cut between tokens is encoded to the same
    tokens again, so sizes add up. Beside an apostrophe the split pattern may see another split, and behind a leading
    space the space would be one of its own. Where that leaves a part above the limit, all characters count by bytes.
    """
    ends = np.cumsum([len(c.encode("utf-8", "replace")) for c in run])
    if id(ids) not in _BYTE_LENGTHS:
        _BYTE_LENGTHS[id(ids)] = tokens.byte_lengths(ids)
    toks = np.cumsum(_BYTE_LENGTHS[id(ids)][np.frombuffer(tokens.encode_bytes(run, ids), dtype=np.int32)])
    at, size = np.arange(1, len(run) + 1), np.diff(ends, prepend=0)
    if len(toks) and toks[-1] == ends[-1] and not _SEPARATORS.search(run):
        fits = np.isin(ends, toks)
        for i in [i for i, c in enumerate(run) if c == "'"]:
            fits[max(0, i - 1) : i + 2] = False
        fits[0] &= not run[0].isspace() or run.isspace()
        fits[-1] = True
        good = at[fits]
        n = np.diff(np.searchsorted(toks, ends[fits], side="right"), prepend=0)
        if not ((n > limit) & (np.diff(good, prepend=0) > 1)).any():
            at, size = good, n
    levels = np.full(len(run) + 1, CHAR, dtype=np.int8)
    if not run.isspace():
        levels[[m.end() for m in _PARTS.finditer(run)]] = WORD
        levels[[m.end() for m in _RUN_SENTENCE_END.finditer(run)]] = SENTENCE
    return list(zip(at.tolist(), levels[at].tolist(), size.tolist()))


def _inside(line: str, limit: int, fine: float, ids) -> list[tuple[int, int, int]]:
    """Word ends of a long line with level and an upper bound of tokens; words above fine are taken apart."""
    out = []
    for m in _WORDS.finditer(line):
        word = m.group()
        bare = word.lstrip()
        gap = len(word) - len(bare)
        space = len(word[:gap].encode("utf-8", "replace"))
        size = max(0, space - 1) + (len(ids[word[gap - 1 :] if space else bare]) // 4 if bare else 1)
        level = SENTENCE if _SENTENCE_END.search(word) else WORD
        if size <= fine:
            out.append((m.end(), level, size))
        else:
            cut = max(0, gap - 1)  # the last space is split off by what follows
            for at, part in ((0, word[:cut]), (cut, word[cut:])):
                out += [(m.start() + at + e, lv, k) for e, lv, k in (_run(part, limit, ids) if part else [])]
            out[-1] = (m.end(), level, out[-1][2])
    return out


def atoms(text: str, limit: int, fine: float, ids) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, bool]:
    """End offsets of the atoms, the level of the boundary behind each, their tokens, the text's tokens, and whether
    all atoms are lines. Lines above fine tokens are taken apart. A line's feed belongs to it, so that a cut comes behind it."""
    lines = tokens.segments(text)
    sizes = [len(x) // 4 for x in map(ids.__getitem__, lines)]
    whole = sum(sizes)
    if whole <= limit:
        return np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(0, np.int64), whole, True
    ends = np.cumsum([len(x) for x in lines])
    ends[:-1] += 1
    levels = np.array([CUE if x[-1:] in "\r\n" and x.rstrip("\r") != x.rstrip() else LINE for x in lines], dtype=np.int8)
    size = np.array(sizes, dtype=np.int64)
    if size.max() <= fine:
        return ends, levels, size, whole, True
    rows: list[tuple[int, int, int]] = []
    start = 0
    for end, level, n in zip(ends.tolist(), levels.tolist(), sizes):
        if n <= fine:
            rows.append((end, level, n))
        else:
            inner = _inside(text[start:end], limit, fine, ids)
            rows += [(start + e, lv, k) for e, lv, k in inner]
            rows[-1] = (end, level, rows[-1][2])
        start = end
    e, lv, sz = zip(*rows)
    return np.array(e, dtype=np.int64), np.array(lv, dtype=np.int8), np.array(sz, dtype=np.int64), whole, False


def successors(cum: np.ndarray, levels: np.ndarray, first: np.ndarray, last: np.ndarray, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary as the end of a piece, the end of the next piece and where that one starts.

    Boundaries of all texts lie in one array; cum: tokens before each boundary, growing over all texts; first and last:
    the boundary before and behind each boundary's text. A piece starts overlap tokens before the last cut, at the
    nearest line end inside that leaves FILL of the overlap, else sentence end, else word end, else boundary, and ends at the boundary of the highest level that leaves it at least FILL of the limit,
    the farthest of these, else at the farthest of all. The last boundary of a text is its own successor.
    """
    n = len(cum)
    here = np.arange(n)
    nearest = np.clip(np.searchsorted(cum, cum - overlap, side="left"), first, here)
    start, chosen = nearest.copy(), np.zeros(n, dtype=bool)
    for level in range(LINE, CHAR, -1):
        later = np.minimum.accumulate(np.where(levels >= level, here, n - 1)[::-1])[::-1][nearest]
        good = ~chosen & (later < here) & (cum - cum[np.minimum(later, here)] >= int(overlap * FILL))
        start[good] = later[good]
        chosen |= good
    start = np.where(here == first, here, start)
    far = np.searchsorted(cum, cum[start] + limit, side="right") - 1
    far = np.minimum(np.maximum(far, here + 1), last)
    far = np.where(here == last, here, far)
    # farther starts where the overlap would leave no room for anything new
    tight = (cum[np.minimum(here + 1, n - 1)] - cum[start] > limit) & (here < last)
    start = np.where(tight, here, start)
    far = np.where(tight, np.minimum(np.maximum(np.searchsorted(cum, cum + limit, side="right") - 1, here + 1), last), far)
    best = far.copy()
    enough = np.searchsorted(cum, cum[start] + int(limit * FILL), side="left")
    chosen = far == last
    for level in range(CUE, WORD - 1, -1):
        latest = np.maximum.accumulate(np.where(levels >= level, here, -1))[far]
        good = ~chosen & (latest > here) & (latest >= enough)
        best[good] = latest[good]
        chosen |= good
    return np.where(here == last, here, best), start


def reached(succ: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Boundaries on the paths from the roots, by squaring the successor table."""
    mark = np.zeros(len(succ), dtype=bool)
    mark[roots] = True
    jump = succ
    while True:
        new = mark.copy()
        new[jump[mark]] = True
        done = (new == mark).all() and (jump[jump] == jump).all()
        mark = new
        if done:
            return mark
        jump = jump[jump]


def split_spans(texts: list[str | None], limit: int, overlap: int, ids) -> list[list[tuple[int, int, int]]]:
    """Pieces (start, end, tokens) of each text. Texts within the limit give one piece, null and empty texts none."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ends_of, cum, levels, first, last, owner, plain = [], [], [], [], [], [], {}
    base, total = 0, 0
    inner = max(1, limit - 1)  # a feed at the end of a piece can take a token more than inside
    # a boundary is never farther from the next than the overlap must reach, except in indivisible characters
    fine = max(1, min(inner * LONG_LINE, overlap * FILL) if overlap else inner * LONG_LINE)
    for i, text in enumerate(texts):
        if not text:
            continue
        ends, lv, size, whole, plain[i] = atoms(text, inner, fine, ids)
        if not len(ends):
            out[i] = [(0, len(text), whole)]
            continue
        n = len(ends)
        ends_of.append(np.concatenate([[0], ends]))
        cum.append(total + np.concatenate([[0], np.cumsum(size)]))
        levels.append(np.concatenate([[CUE], lv]))
        first.append(np.full(n + 1, base))
        last.append(np.full(n + 1, base + n))
        owner.append(np.full(n + 1, i))
        base += n + 1
        total = int(cum[-1][-1]) + 4 * limit + overlap  # no window reaches into the next text
    if not base:
        return out
    ends, c, lv, fi, la, ow = (np.concatenate(x) for x in (ends_of, cum, levels, first, last, owner))
    succ, start = successors(c, lv, fi, la, inner, overlap)
    before = -1
    for b in np.flatnonzero(reached(succ, np.unique(fi))).tolist():
        if b == la[b]:
            continue
        i = int(ow[b])
        # behind a piece no longer than the overlap the next one still starts later
        a, z = (b if b == fi[b] else max(int(start[b]), before + 1)), int(succ[b])
        before = a
        piece = texts[i][ends[a] : ends[z]]
        if plain[i] and z - a > 1:
            # whole lines inside keep their tokens; the first lost its feed to the piece before, the last has one more
            head, tail = piece[: ends[a + 1] - ends[a] - 1], texts[i][ends[z - 1] - 1 : ends[z]]
            k = (len(ids[head]) + len(ids[tail])) // 4 + int(c[z - 1] - c[a + 1])
        else:
            k = len(tokens.encode_bytes(piece, ids)) // 4
        out[i].append((int(ends[a]), int(ends[z]), k))
    return out


def split_batch(texts: list[str | None], limit: int, overlap: int, ids) -> list[list[tuple[str, int]]]:
    """Pieces (text, tokens) of each text."""
    spans = split_spans(texts, limit, overlap, ids)
    return [[(t[a:z], k) for a, z, k in p] for t, p in zip(texts, spans)]


def split_texts(
    df: DataFrame, key: str, text: str, limit: int, overlap: int, name: str = tokens.DEFAULT_TOKENIZER, folder: str | None = None, places: bool = False
) -> DataFrame:
    """(key, piece_no int from 0, text, n_tokens long) of every row; with places also start long, the character it starts at.

    Every piece has at most limit tokens, except that a single character may have more where limit is below its own
    number. Neighbours share at most overlap tokens and at least half of that, as far as characters can be told apart;
    behind a piece no longer than the overlap it may be less. Joined without overlaps the pieces are the text. Texts within the limit are one piece; null and empty texts
    give no row; repeated rows are cut each. Whole texts are cut, of any length.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    if not isinstance(tokens.coder(name, folder), tokens.SegmentIds):
        raise ValueError("pieces are cut by byte-level vocabularies: of others, token counts don't add up over parts")
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokens.coder(name, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                texts = b.column(1).to_pylist()
                pieces = split_spans(texts, limit, overlap, ids)
                rows = [i for i, p in enumerate(pieces) for _ in p]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(rows, pa.int64())),
                        pa.array([j for p in pieces for j in range(len(p))], pa.int32()),
                        pa.array([t[a:z] for t, p in zip(texts, pieces) for a, z, _ in p], pa.string()),
                        pa.array([k for p in pieces for _, _, k in p], pa.int64()),
                        pa.array([a for p in pieces for a, _, _ in p], pa.int64()),
                    ],
                    names=["k", "piece_no", "text", "n_tokens", "start"],
                )

    out = df.select(F.col(key).alias("k"), F.col(text).alias("v")).mapInArrow(run, f"k {kind}, piece_no int, text string, n_tokens long, start long")
    return (out if places else out.drop("start")).withColumnRenamed("k", key)


def joined(pieces: DataFrame, key: str) -> DataFrame:
    """(key, text, n_pieces): the texts put together again from pieces with places. A text's pieces meet in one row, as it did."""
    gathered = pieces.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "text"))).alias("_p"))
    whole = F.expr("aggregate(_p, '', (acc, p) -> concat(acc, substring(p.text, int(length(acc) - p.start + 1))))")
    return gathered.select(key, whole.alias("text"), F.size("_p").alias("n_pieces"))
