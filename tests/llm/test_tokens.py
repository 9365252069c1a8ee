import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codeweft.llm import mixing, splitting, tokens

pytestmark = pytest.mark.skipif(not os.path.exists(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json"), reason="no tokenizer files")
HARD = ["", " ", "\n", "\n\n x", "a\r\n\r\n b\r\n", "1\n00:00:51,439 --> 00:00:55,664\nHi\n\n", "<|endoftext|>", "日本語のテキスト。\n次", "e\u0301 👩‍👩‍👧 \u200b", "\x1c\n\x1cx", "\u2028a\u00a0b\n", "x" * 5000, "it's we'll I'd", "\ufeffa\ufffd", "\n 00:01:02.345 --> 00:01:03.000 X1:0\n", "\t\n\t\n  z  "]


@pytest.fixture(scope="module")
def ids():
    return tokens.coder()


def whole(ids, text):
    return ids.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", HARD)
def test_hard_texts(ids, text):
    assert tokens.encode(text, ids).tolist() == whole(ids, text)
    assert tokens.decode(tokens.encode(text, ids), ids) == text


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("\n\r\t  ab12.,:->'"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    ids = tokens.coder()
    assert tokens.encode(text, ids).tolist() == whole(ids, text)
    assert tokens.decode(tokens.encode(text, ids), ids) == text


def test_offsets(ids):
    text = "héllo 日本 👍x"
    got, at = tokens.encode_offsets(text, ids)
    want = ids.tokenizer.encode(text, add_special_tokens=False)
    assert got.tolist() == want.ids and len(at) == len(got)
    assert at[0] == 0 and at[-1] == len(text) - 1 and all(a <= b for a, b in zip(at, at[1:]))


OTHERS = ["word_bpe_49k", "piece_bpe_32k", "byte_bpe_multi_50k", "byte_bpe_50k.tiktoken"]


@pytest.mark.parametrize("name", OTHERS)
def test_other_vocabularies_as_their_libraries(name):
    import base64

    import sentencepiece
    import tiktoken
    from tokenizers import Tokenizer

    where = tokens.TOKENIZER_DIR
    if name.startswith("word"):
        t = Tokenizer.from_file(f"{where}/{name}.json")
        t.encode_special_tokens = True
        right = lambda s: t.encode(s, add_special_tokens=False).ids
    elif name.startswith("piece"):
        p = sentencepiece.SentencePieceProcessor(model_file=f"{where}/{name}.model")
        right = p.encode
    else:
        at = f"{where}/{name}" if name.endswith(".tiktoken") else f"{where}/{name}.tiktoken"
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(at, "rb"))}
        right = tiktoken.Encoding("own", pat_str=tokens.SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    ids = tokens.coder(name)
    for text in [*HARD, "Ünï CÖDE\n\nMixed\tCase  123,456.78\n"]:
        assert tokens.encode(text, ids).tolist() == list(right(text)), text
        if not name.startswith(("word", "piece")):
            assert tokens.decode(tokens.encode(text, ids), ids) == text


def test_unknown_vocabularies_are_refused(spark):
    with pytest.raises(ValueError):
        tokens.coder("nothing_like_it")
    with pytest.raises(ValueError):
        splitting.split_texts(spark.createDataFrame([(1, "a")], "i long, t string"), "i", "t", 10, 2, name="word_bpe_49k")


def test_cache_limit_changes_nothing(ids, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE", 3)
    small = tokens.SegmentIds(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    text = "one two three four\nfive six\nseven"
    assert [tokens.encode(text, small).tolist() for _ in range(3)] == [whole(ids, text)] * 3


def test_encode_table(spark, ids):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "", "x"), (3, None, "x"), (1, "a b", "y"), (4, HARD[5] * 300, "x")], "doc_id long, text string, ids string")
    out = tokens.encode_table(df, "doc_id", "text")
    assert out.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted((r.doc_id, r.ids) for r in out.collect())
    assert got == sorted([(1, whole(ids, "a b")), (1, whole(ids, "a b")), (2, []), (3, []), (4, whole(ids, HARD[5] * 300))])
    assert tokens.encode_table(df.limit(0), "doc_id", "text").collect() == []
    assert sorted(r.n_tokens for r in tokens.count_tokens(df, "doc_id", "text").collect())[:2] == [0, 0]


def spans_hold(text, spans, limit, overlap, ids):
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for a, z, k in spans:
        assert k == len(whole(ids, text[a:z])) and (k <= limit or z - a == 1)
    for (a, b, _), (c, d, _) in zip(spans, spans[1:]):
        assert a < c <= b < d
        assert len(whole(ids, text[c:b])) <= overlap + 1


@pytest.mark.parametrize("limit, overlap", [(16, 0), (16, 5), (40, 10), (200, 50), (3, 1)])
def test_pieces(ids, limit, overlap):
    rng = random.Random(limit)
    words = ["alpha", "beta.", "über!", "日本語", "x" * 40, "1,234", "👍"]
    texts = [None, ""] + HARD[1:]
    for _ in range(40):
        texts.append("".join(rng.choice(words) + rng.choice([" ", " ", "\n", "\n\n", "\r\n", "  "]) for _ in range(rng.randrange(1, 120))))
    for text, spans in zip(texts, splitting.split_spans(texts, limit, overlap, ids)):
        if not text:
            assert spans == []
        else:
            spans_hold(text, spans, limit, overlap, ids)


def test_natural_boundaries(ids):
    text = "".join(f"{i}\n00:00:{i:02d},000 --> 00:00:{i:02d},900\nSome words here.\n\n" for i in range(50))
    spans = splitting.split_spans([text], 120, 0, ids)[0]
    assert len(spans) > 3 and all(text[:z].endswith("\n\n") for _, z, _ in spans)
    prose = "One sentence here. " * 80
    assert all(prose[:z].endswith((". ", ".")) for _, z, _ in splitting.split_spans([prose], 50, 0, ids)[0])


@pytest.mark.parametrize("end", ["。", "！", "?", "。」"])
def test_sentences_without_spaces(ids, end):
    text = "".join(f"我们今天讨论{'数据系统的问题' * (i % 3 + 1)}和framework{i}的用法{end}" for i in range(120))
    spans = splitting.split_spans([text], 512, 0, ids)[0]
    spans_hold(text, spans, 512, 0, ids)
    assert len(spans) > 3 and all(text[:z].endswith(end) for _, z, _ in spans)
    assert min(k for _, _, k in spans[:-1]) > 256


def test_words_without_spaces(ids):
    text = "".join(f"数据系统framework{i}的用法" for i in range(300))
    spans = splitting.split_spans([text], 200, 0, ids)[0]
    spans_hold(text, spans, 200, 0, ids)
    assert not any((text[z - 1] + text[z]).isascii() for _, z, _ in spans[:-1])
    assert min(k for _, _, k in spans[:-1]) > 150  # tokens, not bytes, fill a piece
    text = "数据系统的问题" * 400
    spans = splitting.split_spans([text], 200, 0, ids)[0]
    spans_hold(text, spans, 200, 0, ids)
    assert min(k for _, _, k in spans[:-1]) > 190


@pytest.mark.parametrize("unit", ["数据系统的问题", "我们今天讨论数据系统的问题。", "Слово за слово и так далее, ", "plain words without any mark ", "several words in one line that is long enough to hold more than sixty four tokens " * 5 + "of the overlap\n", "数据系统的问题" * 8 + " ", "x1Y2", "one short line\n"])
def test_overlap_is_kept(ids, unit):
    text = unit * (12000 // len(unit))
    spans = splitting.split_spans([text], 512, 64, ids)[0]
    spans_hold(text, spans, 512, 64, ids)
    assert len(spans) > 2
    for (_, b, _), (c, _, _) in zip(spans, spans[1:]):
        assert len(whole(ids, text[c:b])) >= 31


def test_pointer_doubling_marks_paths():
    succ = np.array([2, 2, 5, 4, 5, 5, 8, 8, 8])
    assert np.flatnonzero(splitting.reached(succ, np.array([0, 6]))).tolist() == [0, 2, 5, 6, 8]
    long = np.minimum(np.arange(1000) + 1, 999)
    assert splitting.reached(long, np.array([0])).all()


def test_split_table(spark, ids):
    df = spark.createDataFrame([(1, "a b c d e f g h", 1), (2, None, 1), (3, "", 1)], "doc_id long, text string, piece_no int")
    out = splitting.split_texts(df, "doc_id", "text", 3, 1)
    assert out.columns == ["doc_id", "piece_no", "text", "n_tokens"]
    got = sorted(map(tuple, out.collect()))
    assert {r[0] for r in got} == {1} and [r[1] for r in got] == list(range(len(got))) and all(r[3] <= 3 for r in got)
    with pytest.raises(ValueError):
        splitting.split_texts(df, "doc_id", "text", 3, 3)


def test_rates():
    plan = {p.source: p for p in mixing.plan_rates([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.2, 2), ("d", 0.0, 3), ("e", 0.1, 5)], {"a": 1000, "b": 50, "c": 1000}, 1000)}
    assert plan["b"].rate == 4 and plan["d"].rate == 0 and plan["e"].rate == 0
    total = sum(p.rate * p.tokens for p in plan.values())
    assert abs(total - 1000) < 1e-6
    assert abs(plan["a"].rate * 1000 / (plan["c"].rate * 1000) - 2.5) < 1e-6
    assert all(p.rate == 0 for p in mixing.plan_rates([("a", 1.0, 1)], {}))


def test_mix(spark):
    docs = spark.createDataFrame([(i, "word " * 40, "big", 7) for i in range(400)] + [(1000 + i, "word " * 40, "small", 7) for i in range(10)] + [(2000, "x", None, 7), (2001, None, "big", 7), (2002, "", "small", 7), (2003, "x", "other", 7)], "doc_id long, text string, source string, rate int")
    targets = spark.createDataFrame([("big", 0.9, 1), ("small", 0.1, 3), ("none", 0.0, 2)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(docs, targets, "doc_id", "text", "source", total=8000)
    rows = chosen.collect()
    assert {r.source for r in rows} == {"big", "small"} and max(r.repeats for r in rows if r.source == "big") == 1
    assert max(r.repeats for r in rows) <= 3 and min(r.repeats for r in rows) >= 1
    shares = {r.source: r for r in report.collect()}
    assert abs(shares["big"].actual_share - 0.9) < 0.04 and shares["none"].mixed_tokens == 0
    assert abs(sum(r.actual_share for r in shares.values()) - 1) < 1e-9
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs, targets, "doc_id", "text", "source", total=8000)[0].collect()))
    made = mixing.copies(chosen, "doc_id").collect()
    assert {(r.doc_id, r.copy_no) for r in made} == {(r.doc_id, i) for r in rows for i in range(r.repeats)}
    assert mixing.emit(docs, chosen, "doc_id", "text").count() == len(made)
    empty, report = mixing.mix(docs.limit(0), targets, "doc_id", "text", "source")
    assert empty.collect() == [] and all(r.actual_share == 0 for r in report.collect())
