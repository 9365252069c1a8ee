import random
import re

import numpy as np
import pytest

from codeweft.llm import history, setjoin


def test_plan():
    assert setjoin.least_jaccard(0.75) == pytest.approx(0.6)
    width, count = setjoin.plan_segments(50_000, 0.6, 0.9999)
    assert setjoin.expected_recall(width, count, 0.6) >= 0.9999 > setjoin.expected_recall(width, count // 2, 0.6)
    assert 25 <= setjoin.radius(128, 0.6, 0.5) <= 26 and setjoin.radius(128, 1.0, 0.9) == 0


def test_code_bits_follow_similarity():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    other = np.concatenate([base[:30], rng.integers(0, 1 << 63, 10, dtype=np.uint64)])
    bits = setjoin.codes(np.concatenate([base, other]), np.array([0, 40, 80]))
    agree = (bits[0] == bits[1]).mean()
    assert abs(agree - (1 + 30 / 50) / 2) < 0.09 and 0.4 < bits.mean() < 0.6


def brute(records, threshold):
    out = {}
    for i, (a, ga, va, oa) in enumerate(records):
        for b, gb, vb, ob in records[i + 1 :]:
            x, y = ({v for v in s or [] if v is not None} for s in (va, vb))
            if a != b and x and y and ga != gb and (oa or ob):
                s = len(x & y) / max(len(x), len(y))
                if s >= threshold:
                    out[(min(a, b), max(a, b))] = round(s, 9)
    return out


def test_similar_records(spark):
    rng = random.Random(5)
    records, i = [], 0
    for _ in range(60):
        base = [f"v{rng.randrange(400)}" for _ in range(rng.randrange(1, 14))]
        for _ in range(rng.randrange(1, 5)):
            i += 1
            mine = [x if rng.random() > 0.08 else f"v{rng.randrange(400)}" for x in base]
            records.append((i, rng.choice([f"g{i}", f"g{i}", "same", None]), mine + ([None, mine[0]] if rng.random() < 0.3 else []), rng.random() < 0.8))
    records += [(1000, "z", None, True), (1001, "y", [], True), (1002, "x", [None], True)]
    df = spark.createDataFrame([(*r, "clash") for r in records + records[:20]], "id long, grp string, vs array<string>, own boolean, set_id string")
    from pyspark.sql import functions as F

    got = {(r.id_a, r.id_b): round(r.similarity, 9) for r in setjoin.similar_records(df, "id", "vs", "grp", 0.75, F.col("own")).collect()}
    want = brute(records, 0.75)
    assert set(got) <= set(want) and len(got) >= 0.999 * len(want) and all(got[k] == want[k] for k in got)
    assert setjoin.similar_records(df.limit(0), "id", "vs", "grp", 0.75).collect() == []


def test_links_count_pairs_and_no_join_is_broadcast(spark):
    rng = random.Random(8)
    bases = [[f"v{rng.randrange(300)}" for _ in range(rng.randrange(3, 9))] for _ in range(12)]
    records = []
    for i in range(150):
        base = rng.choice(bases)
        records.append((i, rng.choice(["g1", "g2", None, f"g{i}"]), base if rng.random() < 0.6 else [*base[1:], f"v{rng.randrange(300)}"], rng.random() < 0.7))
    df = spark.createDataFrame(records, "id long, grp string, vs array<string>, own boolean")
    from pyspark.sql import functions as F

    found = setjoin.similar_classes(df, "id", "vs", "grp", 0.75, F.col("own"))
    want = dict.fromkeys((r[0] for r in records), 0)
    for a, b in brute(records, 0.75):
        want[a] += 1
        want[b] += 1
    assert {r.id: r.n_links for r in setjoin.record_links(found).collect()} == want
    same = {}
    for r in found.members.collect():
        same.setdefault(r.set_id, set()).add(frozenset(records[r.id][2]))
    assert all(len(s) == 1 for s in same.values()) and found.pairs.filter("set_a >= set_b").count() == 0
    for out in (setjoin.record_pairs(found), setjoin.record_links(found)):
        assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_copies_of_one_group_do_not_meet(spark):
    df = spark.createDataFrame([(i, "same", ["a", "b", "c", "d"]) for i in range(300)] + [(900, "other", ["a", "b", "c", "d"])], "id long, grp string, vs array<string>")
    got = setjoin.similar_records(df, "id", "vs", "grp", 0.75)
    assert got.count() == 300 and got.filter("id_b = 900").count() == 300


WORDS = re.compile(r"[A-Za-z0-9_]+")


def brute_repeats(incoming, texts, hashes):
    seen_hashes, seen = {h for h in hashes if h is not None}, [set(WORDS.findall(t)) for t in texts if t]
    out = set()
    for row_id, batch, h, text in sorted({r[:4] for r in incoming}, key=lambda r: (r[1], r[0])):
        w = set(WORDS.findall(text)) if text else set()
        if h is not None and h in seen_hashes or w and any(o and len(w & o) / len(w | o) >= 0.8 - 1e-12 for o in seen):
            out.add(row_id)
        if h is not None:
            seen_hashes.add(h)
        if w:
            seen.append(w)
    return out


def make_texts(rng, n, copies):
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    while len(out) < n:
        base = rng.sample(vocabulary, rng.randrange(5, 40))
        for _ in range(rng.randrange(1, copies)):
            text = [w if rng.random() > 0.04 else rng.choice(vocabulary) for w in base]
            out.append(" ".join(text))
    return out[:n]


@pytest.mark.parametrize("copies", [3, 60])
def test_repeats_against_brute_force(spark, copies):
    rng = random.Random(copies)
    texts = make_texts(rng, 500, copies)
    rng.shuffle(texts)
    known, new = texts[:150], texts[150:]
    incoming = [(i, rng.randrange(1, 9), rng.choice([None, f"h{rng.randrange(2000)}"]), rng.choice([None, "", "()"]) if rng.random() < 0.04 else t, "x") for i, t in enumerate(new)]
    hashes = [f"h{i}" for i in range(0, 300)] + [None]
    df = spark.createDataFrame(incoming + incoming[:30], "row_id long, batch int, hash string, text string, words string")
    kt = spark.createDataFrame([(t,) for t in known + [None, "", known[0]]], "text string")
    kh = spark.createDataFrame([(h,) for h in hashes], "hash string")
    got = {r.row_id for r in history.repeats_of_known(df, kt, kh, 0.8).collect()}
    want = brute_repeats(incoming, known, hashes)
    assert got <= want and len(got) >= 0.99 * len(want)
    none = df.limit(0)
    assert history.repeats_of_known(none, kt, kh, 0.8).collect() == []
    assert {r.row_id for r in history.repeats_of_known(df, kt.limit(0), kh.limit(0), 0.8).collect()} == brute_repeats(incoming, [], [])


def test_graph_recall_against_exhaustive_search():
    """The beam alone, without the exhaustive pass, on queries that have a similar set in the shard."""
    rng = random.Random(7)
    base = [sorted(rng.sample(range(3000), rng.randrange(12, 60))) for _ in range(4000)]
    queries, ages = [], []
    for i in rng.sample(range(4000), 400):
        s = set(base[i])
        drop = max(1, int(len(s) * 0.1))
        s = s - set(rng.sample(sorted(s), drop)) | set(rng.sample(range(3000, 4000), drop // 2))
        if len(s & set(base[i])) / len(s | set(base[i])) >= 0.8:
            queries.append(sorted(s))
    flat = lambda sets: (np.array([x * 2654435761 % (1 << 31) for s in sets for x in s], dtype=np.int32), np.concatenate([[0], np.cumsum([len(s) for s in sets])]))
    shard = history.Shard.build(*flat(base), np.full(len(base), -1), np.zeros(len(base), np.int64))
    told = shard.tune(0.8)
    ages = np.arange(len(queries))
    found = shard.older_like(*flat(queries), ages, ages, 0.8, exhaustive=False)
    assert len(queries) > 200 and found.mean() >= 0.97 and told >= 0.97
    again = history.Shard.load({**shard.stored(), "width": shard.width})
    assert (again.older_like(*flat(queries), ages, ages, 0.8, exhaustive=False) == found).all()


def test_batches_one_by_one_read_no_earlier_text(spark, tmp_path):
    """The same repeats batch by batch as at once, over compactions, with an index that is opened anew each time."""
    rng = random.Random(3)
    texts = make_texts(rng, 400, 8)
    rng.shuffle(texts)
    known, new = texts[:120], texts[120:]
    big = 1 << 41
    incoming = [(big + i, i * 9 // len(new), rng.choice([None, f"h{rng.randrange(300)}"]), t) for i, t in enumerate(new)]
    hashes = [f"h{i}" for i in range(20)]
    schema = "row_id long, batch int, hash string, text string"
    where = str(tmp_path / "index")
    first = history.HistoryIndex(spark, where, 0.8)
    first.add_history(spark.createDataFrame([(t,) for t in known], "text string"), spark.createDataFrame([(h,) for h in hashes], "hash string"))
    got = set()
    for b in range(9):
        index = history.HistoryIndex(spark, where)
        got |= {r.row_id for r in index.check(spark.createDataFrame([r for r in incoming if r[1] == b], schema)).collect()}
    want = brute_repeats(incoming, known, hashes)
    assert got <= want and len(got) >= 0.99 * len(want)
    assert len(index.segments) < 6 and max(level for _, level in index.segments) >= 1
    assert index.report().agg({"n": "sum"}).first()[0] > 0 and index.report().filter("recall < 0.9").count() == 0
    at_once = history.repeats_of_known(spark.createDataFrame(incoming, schema), spark.createDataFrame([(t,) for t in known], "text string"), spark.createDataFrame([(h,) for h in hashes], "hash string"), 0.8)
    assert {r.row_id for r in at_once.collect()} == got
