"""Encoding with public tokenizers: byte-level ones of two file formats, and others by whole texts.

The byte-level vocabularies split a text by a fixed pattern and encode each split on its own, so a worker keeps the ids
of the splits it has met: the tokenizers library is asked once per new split, in batches. Ids are joined as raw int32
bytes, lines met before are looked up whole, and all reach Arrow without passing through Python integers.
"""

from __future__ import annotations

import base64
import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TOKENIZER = "byte_bpe_50k"
TOKENIZER_DIR = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Fixed value: the split pattern of the byte-level vocabularies.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHE = 400_000
#: Longer splits are encoded but not kept.
LONGEST_KEPT = 64


class SplitIds(dict):
    """Ids of each split, as int32 bytes."""

    def __init__(self, encode: Callable[[str], list[int]]):
        self.encode = encode

    def __missing__(self, split: str) -> bytes:
        ids = np.array(self.encode(split), dtype=np.int32).tobytes()
        if len(split) <= LONGEST_KEPT:
            if len(self) >= CACHE:
                self.clear()
            self[split] = ids
        return ids


#: A text may be cut before a line feed that a visible character follows: the split pattern always ends a split there.
_SEGMENTS = re.compile(r"(?=\n\S)").split
#: Cue times are nearly all different; their parts are not, and each ends where a split ends.
_TIMES = re.compile(r"(\n?\d\d:\d\d:\d\d[,.])(\d{3} -->)( \d\d:\d\d:\d\d[,.])(\d{3}[\r\n]*)").fullmatch
_FIND = regex.compile(SPLIT).findall
_FIND_ASCII = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+", re.ASCII).findall
LONGEST_SEGMENT = 256


class SegmentIds(dict):
    """Ids of whole lines met before; other lines are put together from their splits. For byte-level vocabularies."""

    def __init__(self, path: str):
        encode, self.table, self.tokenizer = (_from_ranks if path.endswith(".tiktoken") else _from_json)(path)
        self.splits = SplitIds(encode)

    def __missing__(self, line: str) -> bytes:
        if len(line) > 24 and (m := _TIMES(line)):
            a, b, c, d = m.groups()
            return self[a] + self[b] + self[c] + self[d]
        find = _FIND_ASCII if line.isascii() else _FIND
        ids = b"".join(map(self.splits.__getitem__, find(line)))
        if len(line) <= LONGEST_SEGMENT:
            if len(self) >= CACHE:
                self.clear()
            self[line] = ids
        return ids


class WholeTexts:
    """Ids of whole texts, for vocabularies that see more than a split: nothing can be cut or kept."""

    def __init__(self, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str], tokenizer: object):
        self.encode, self.decode, self.tokenizer = encode, decode, tokenizer

    def __getitem__(self, text: str) -> bytes:
        return np.array(self.encode(text), dtype=np.int32).tobytes()


Coder = SegmentIds | WholeTexts
_CODERS: dict[str, Coder] = {}


def _library(path: str):  # type: ignore[no-untyped-def]
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer, lambda s: tokenizer.encode(s, add_special_tokens=False).ids


def _from_json(path: str) -> tuple[Callable[[str], list[int]], list[bytes], object]:
    """Encoder, bytes of each id, and tokenizer of a byte-level vocabulary."""
    tokenizer, encode = _library(path)
    alphabet, vocab = byte_alphabet(), tokenizer.get_vocab()
    table = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return encode, table, tokenizer


def _from_ranks(path: str) -> tuple[Callable[[str], list[int]], list[bytes], object]:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    table = [b""] * (max(ranks.values()) + 1)
    for raw, i in ranks.items():
        table[i] = raw
    return encoding.encode_ordinary, table, encoding


def _json_coder(path: str) -> Coder:
    """Byte-level vocabularies with the known split and no normalising are cut and kept, others encode whole texts."""
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    before = made.get("pre_tokenizer") or {}
    if not made.get("normalizer") and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space"):
        return SegmentIds(path)
    tokenizer, encode = _library(path)
    return WholeTexts(encode, lambda ids: tokenizer.decode(ids, skip_special_tokens=False), tokenizer)


def _piece_coder(path: str) -> Coder:
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    return WholeTexts(lambda s: processor.encode(s, num_threads=1), processor.decode, processor)


#: By the ending of a vocabulary file.
_MAKERS = {".json": _json_coder, ".tiktoken": SegmentIds, ".model": _piece_coder}


def coder(name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> Coder:
    """The coder of a vocabulary file, by its name with or without ending. Unknown kinds are refused."""
    for ending, make in _MAKERS.items():
        path = f"{folder or TOKENIZER_DIR}/{name.removesuffix(ending)}{ending}"
        if (name.endswith(ending) or not name.endswith(tuple(_MAKERS))) and os.path.exists(path):
            if path not in _CODERS:
                _CODERS[path] = make(path)
            return _CODERS[path]
    raise ValueError(f"no vocabulary file of a known kind: {folder or TOKENIZER_DIR}/{name}")


def segments(text: str) -> list[str]:
    """Parts of a text whose byte-level ids are the text's ids when joined; all but the first begin with a line feed."""
    return _SEGMENTS(text)


def encode_bytes(text: str, ids: Coder) -> bytes:
    """Ids of a text as int32 bytes."""
    return b"".join(map(ids.__getitem__, _SEGMENTS(text))) if isinstance(ids, SegmentIds) else ids[text]


def encode(text: str | None, ids: Coder) -> np.ndarray:
    return np.frombuffer(encode_bytes(text, ids), dtype=np.int32) if text else np.zeros(0, np.int32)


def encode_offsets(text: str, ids: SegmentIds) -> tuple[np.ndarray, np.ndarray]:
    """Ids and, for each, the character its first byte belongs to; a character split over ids is given by each."""
    table = byte_lengths(ids)
    toks = encode(text, ids)
    starts = np.concatenate([[0], np.cumsum(table[toks])])[:-1]
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    chars = np.cumsum((raw & 0xC0) != 0x80) - 1  # byte to character
    return toks, chars[starts] if len(toks) else starts.astype(np.int64)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the rest moves up from U+0100."""
    keep = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(keep)]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_lengths(ids: SegmentIds) -> np.ndarray:
    return np.array([len(b) for b in ids.table], dtype=np.int64)


def decode(token_ids, ids: Coder) -> str:  # type: ignore[no-untyped-def]
    """The text of a list of ids; byte-level characters split over ids are joined from their bytes."""
    if isinstance(ids, WholeTexts):
        return ids.decode([int(i) for i in token_ids])
    return b"".join(ids.table[i] for i in token_ids).decode("utf-8", "replace")


def int_lists(chunks: list[bytes]) -> pa.ListArray:
    sizes = np.fromiter((len(c) for c in chunks), dtype=np.int64, count=len(chunks)) // 4
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(chunks))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def _map_text(df: DataFrame, key: str, text: str, schema: str, make: Callable, name: str, folder: str | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = coder(name, folder)
        for b in batches:
            n = b.num_rows
            for at in range(0, n, 2000):  # the list offsets of one batch stay within int32
                part = b.slice(at, 2000)
                chunks = [encode_bytes(t, ids) if t else b"" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), make(chunks)], names=["k", "v"])

    return df.select(F.col(key).alias("k"), F.col(text).alias("v")).mapInArrow(run, schema)


def encode_table(df: DataFrame, key: str, text: str, name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    """(key, ids array<int>) of every row, without special tokens; texts that look like one are ordinary text.

    Null and empty texts give an empty list. Every row gives a row, repeated ones too. No length limit.
    """
    kind = dict(df.dtypes)[key]
    out = _map_text(df, key, text, f"k {kind}, v array<int>", int_lists, name, folder)
    return out.select(F.col("k").alias(key), F.col("v").alias("ids"))


def count_tokens(df: DataFrame, key: str, text: str, name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    """(key, n_tokens long); null and empty texts have 0."""
    kind = dict(df.dtypes)[key]
    make = lambda chunks: pa.array([len(c) // 4 for c in chunks], pa.int64())
    out = _map_text(df, key, text, f"k {kind}, v long", make, name, folder)
    return out.select(F.col("k").alias(key), F.col("v").alias("n_tokens"))


def decode_table(df: DataFrame, key: str, ids: str, name: str = DEFAULT_TOKENIZER, folder: str | None = None) -> DataFrame:
    """(key, text) of every row of ids; an empty list gives an empty text, null gives null."""
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = coder(name, folder)
        for b in batches:
            texts = [None if x is None else decode(x, known) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["k", "v"])

    out = df.select(F.col(key).alias("k"), F.col(ids).alias("v")).mapInArrow(run, f"k {kind}, v string")
    return out.select(F.col("k").alias(key), F.col("v").alias("text"))
