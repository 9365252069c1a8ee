"""Relational operators on small tables with nulls, repeats, ties, empty inputs and clashing columns."""

import random

import pytest
from pyspark.sql import functions as F

from codeweft.functions import pycanon, sql
from codeweft.operators import classes, clusters, diff, extract, merge, pack, reconcile, translate
from codeweft.operators.ranking import global_rank
from codeweft.operators.skew import heavy_keys, skewed_key_stats
from codeweft.sources import files
from codeweft.streaming import counts


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_skewed_stats_against_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice(["f1", "f2", "f3", None]), rng.choice([None, 1, 2, 3]), "x") for _ in range(500)]
    df = spark.createDataFrame(data, "k string, f string, t int, n_occurrences string")
    got = {r[0]: (r[1], r[2], tuple(r[3])) for r in skewed_key_stats(df, "k", "f", ["t", "f"], partitions=7).collect()}
    key = lambda t: tuple((x is not None, x) for x in t)
    for k in {x[0] for x in data} - {None}:
        mine = [x for x in data if x[0] == k]
        assert got[k] == (len(mine), len({x[1] for x in mine if x[1]}), min(((x[2], x[1]) for x in mine), key=key))
    assert None not in got


def test_skewed_stats_empty_and_heavy(spark):
    empty = spark.createDataFrame([], "k string, f string, t int")
    assert skewed_key_stats(empty, "k", "f", ["t"]).collect() == []
    df = spark.createDataFrame([("t", "a", "f", 1)] * 2 + [("t", f"k{i}", "f", 1) for i in range(98)], "s string, k string, f string, t int")
    stats = skewed_key_stats(df, "k", "f", ["t"], ("s",))
    totals = spark.createDataFrame([("t", 100)], "s string, n_rows long")
    assert [r.k for r in heavy_keys(stats, totals, 0.02, "s").collect()] == ["a"]


def test_field_arithmetic():
    import numpy as np

    rng = random.Random(1)
    a = [rng.randrange(reconcile.P) for _ in range(200)] + [0, 1, reconcile.P - 1]
    b = [rng.randrange(reconcile.P) for _ in range(200)] + [reconcile.P - 1] * 3
    got = reconcile.mulmod(np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)).tolist()
    assert got == [x * y % reconcile.P for x, y in zip(a, b)]


@pytest.mark.parametrize("na, nb, bound", [(0, 0, 4), (3, 0, 4), (0, 4, 4), (2, 2, 4), (5, 3, 8), (1, 2, 16)])
def test_polynomials_give_the_differences(na, nb, bound):
    import numpy as np

    rng = random.Random(na * 10 + nb)
    common = [rng.randrange(1 << 60) for _ in range(50)]
    a, b = [rng.randrange(1 << 60) for _ in range(na)], [rng.randrange(1 << 60) for _ in range(nb)]
    zs = reconcile.points(bound + reconcile.CHECKS)
    ev = lambda s: reconcile.evaluate_segments(np.array(s, dtype=np.uint64), np.array([0, len(s)]), zs)[0].tolist()
    num, den = reconcile.solve_bucket(ev(common + a), ev(common + b), 50 + na, 50 + nb, bound)
    assert len(num) == na + 1 and len(den) == nb + 1
    assert all(reconcile._value(num, x) == 0 for x in a) and all(reconcile._value(den, x) == 0 for x in b)


def test_polynomials_notice_a_low_bound():
    import numpy as np

    rng = random.Random(9)
    a, b = [rng.randrange(1 << 60) for _ in range(40)], [rng.randrange(1 << 60) for _ in range(40)]
    zs = reconcile.points(8 + reconcile.CHECKS)
    ev = lambda s: reconcile.evaluate_segments(np.array(s, dtype=np.uint64), np.array([0, len(s)]), zs)[0].tolist()
    assert reconcile.solve_bucket(ev(a), ev(b), 40, 40, 8) is None


@pytest.mark.parametrize("share", [0.0, 0.05, 0.6, 1.0])
def test_reconcile_against_brute_force(spark, share):
    rng = random.Random(5)
    a = {f"k{i}": (rng.choice([None, "x", "y"]), rng.choice([None, 1, 2])) for i in range(700)}
    b = {}
    for k, v in a.items():
        if rng.random() >= share:
            b[k] = v
        elif rng.random() < 0.7:
            b[k] = (rng.choice([None, "x", "y", "z"]), rng.choice([None, 1, 2]))
    b |= {f"n{i}": ("q", i) for i in range(int(60 * share))}
    make = lambda d, extra: spark.createDataFrame([(k, *v, extra) for k, v in d.items()] * 2, "id string, s string, n int, diff string")
    got = {(r[0], r[1]) for r in reconcile.reconcile(make(a, "1"), make(b, "2"), "id", {"s": "string", "n": "long"}, rows_per_bucket=64).collect()}
    want = {(k, "missing_in_b") for k in a.keys() - b.keys()} | {(k, "missing_in_a") for k in b.keys() - a.keys()}
    want |= {(k, f) for k in a.keys() & b.keys() for i, f in enumerate(("s", "n")) if a[k][i] != b[k][i]}
    assert got == want


def test_reconcile_keys_of_two_types(spark):
    a = spark.createDataFrame([(i, "x") for i in range(300)], "id int, s string")
    b = spark.createDataFrame([(i, "y" if i == 7 else "x") for i in range(299)], "id long, s string")
    got = {(r.id, r["diff"]) for r in reconcile.reconcile(a, b, "id", {"s": "string"}).collect()}
    assert got == {(7, "s"), (299, "missing_in_b")}


def test_reconcile_wrong_roots_are_compared_exactly(spark, monkeypatch):
    a = spark.createDataFrame([(i % 4, [i * 1000 + j for j in range(30)]) for i in range(4)], "bucket long, elements array<long>")
    b = spark.createDataFrame([(i % 4, [i * 1000 + j for j in range(3, 31)]) for i in range(4)], "bucket long, elements array<long>")
    right = [sorted((r.bucket, r.element) for r in x.collect()) for x in reconcile.differing_elements(a, b)]
    honest = reconcile._solver

    def lying(bound):
        inner = honest(bound)

        def run(frames):
            for pdf in inner(frames):
                pdf["num"] = [[5, 1] if k == 2 else n for k, n in zip(pdf.bucket, pdf.num)]  # a root that no side has
                yield pdf

        return run

    monkeypatch.setattr(reconcile, "_solver", lying)
    assert [sorted((r.bucket, r.element) for r in x.collect()) for x in reconcile.differing_elements(a, b)] == right


def test_one_key_in_one_file_is_one_state(spark):
    df = spark.createDataFrame([("h", "f", i) for i in range(5000)] + [("h", None, -1), (None, "f", 0)], "k string, f string, i long").repartition(8)
    r = skewed_key_stats(df, "k", "f", ["i"]).collect()
    assert [(x.k, x.n_occurrences, x.n_distinct, x["first"].i) for x in r] == [("h", 5001, 1, -1)]


def test_reconcile_empty_side(spark):
    one = spark.createDataFrame([("a", 1)], "id string, n int")
    none = one.limit(0)
    assert rows(reconcile.reconcile(one, none, "id", {"n": "int"}).select("id", "diff")) == [("a", "missing_in_b")]
    assert reconcile.reconcile(none, none, "id", {"n": "int"}).collect() == []


def test_global_rank(spark):
    rng = random.Random(2)
    values = [rng.choice([None, *range(50)]) for _ in range(400)]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v int, i int")
    got = global_rank(df, [F.col("v"), F.col("i")]).orderBy("position").collect()
    assert [(r.v, r.i) for r in got] == sorted(((v, i) for i, v in enumerate(values)), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    assert [r.position for r in got] == list(range(400))
    assert global_rank(df.limit(0), [F.col("v")]).collect() == []


def test_clusters_and_health(spark):
    data = [("h1", "a", 1, "py"), ("h1", "b", 2, "js"), ("h2", "c", 3, "py"), (None, "d", 4, "py")]
    df = spark.createDataFrame(data, "h string, file string, lineno int, lang string")
    assert [(r.h, r.n_members, r["first"].file) for r in clusters.clusters(df, "h", ["file"]).collect()] == [("h1", 2, "a")]
    assert clusters.cross_language(df, "h", "lang", ["file"]).count() == 1
    assert rows(clusters.after_first(df, ["h"], ["file"]).select("file")) == [("b",)]
    assert rows(clusters.keep_first(df, ["h"], ["file"]).select("file")) == [("a",), ("c",), ("d",)]
    report = clusters.health_report(df, "h", ["lang"], count_unhashed=True).collect()
    assert {r.lang: r.total for r in report} == {"py": 3, "js": 1}
    assert clusters.clusters(df.limit(0), "h", ["file"]).collect() == []


@pytest.mark.parametrize(
    "groups, cli, ui, mcp", [([2, 2], 0, 50, 50), ([500], 0, 0, 1), ([1, 1, 1], 100, 100, 100), ([2, 1, 1, 1, 1, 1, 1], 75, 87, 88)]
)
def test_health_formulas(spark, groups, cli, ui, mcp):
    data = [(f"h{i}", "all") for i, n in enumerate(groups) for _ in range(n)]
    r = clusters.health_report(spark.createDataFrame(data, "h string, g string"), "h", ["g"]).first()
    assert (r.health_cli, r.health_ui, r.health_mcp) == (cli, ui, mcp)


def test_metrics(spark):
    df = spark.createDataFrame([(True, True), (True, False), (False, None), (False, True)], "e boolean, a boolean")
    r = clusters.classification_metrics(df, "e", "a").first()
    assert (r.tp, r.fn, r.tn, r.fp, r.precision, r.recall, r.f1, r.accuracy) == (1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5)
    r = clusters.classification_metrics(df.limit(0), "e", "a").first()
    assert r.precision == 0.0 and r.f1 == 0.0
    s = clusters.stability(spark.createDataFrame([("a", "a"), ("a", "b"), (None, "a")], "x string, y string"), "x", "y").first()
    assert (s.stable, s.unstable, s.stability) == (1, 1, 50)


def test_diff_and_verify(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4)], "h string, i int")
    b = spark.createDataFrame([("x", 9), ("z", 8)], "h string, i int")
    got = {r.h: (r.status, r.label_a, r.label_b) for r in diff.hash_diff(a, b, "h", "i", "i").collect()}
    assert got == {"x": ("common", 2, 9), "y": ("only_a", 3, None), "z": ("only_b", None, 8)}
    assert rows(diff.verify(a, b, "h")) == [("y", "missing"), ("z", "extra")]
    assert rows(diff.verify(a, b, "h", both_ways=False)) == [("y", "missing")]
    probe = {r.h: (r.found, r.n_places) for r in diff.probe_index(b.unionByName(a.filter("h is null")), a, "h", ["i"]).collect()}
    assert probe == {"x": (True, 2), "z": (False, 0), None: (False, 0)}
    hits, misses = diff.cache_probe(b, a.select("h").distinct().withColumn("cached", F.lit(1)), ["h"])
    assert rows(hits.select("h")) == [("x",)] and rows(misses.select("h")) == [("z",)]


CLASS_SCHEMA = "i long, name string, bases array<string>, h string, hs array<string>, o int"


def test_inheritance(spark):
    data = [(1, "A", [], "ha", ["m"], 1), (2, "B", ["A"], "hb", ["m"], 2), (3, "C", ["A", "B"], "hc", ["m"], 3), (4, "D", ["Unknown"], "hd", ["m"], 4), (5, "E", None, "he", ["m"], 5), (6, "A", [], "ha2", ["m"], 6)]
    out = {r.i: (r.parent_hash, r.folded_hash) for r in classes.fold_inheritance(spark.createDataFrame(data, CLASS_SCHEMA), "i", "name", "bases", "h", "o").collect()}
    assert out[1] == (None, "ha") and out[4] == (None, "hd") and out[5] == (None, "he")
    assert out[2] == ("ha2", pycanon.folded("hb", ["ha2"]))  # the last A counts
    assert out[3] == (pycanon.merkle(["ha2", "hb"]), pycanon.folded("hc", ["ha2", "hb"]))


def test_class_similarity_brute_force(spark):
    rng = random.Random(8)
    data = [(i, f"c{i}", None, f"h{rng.randrange(60)}", [rng.choice("abcdefgh") for _ in range(rng.randrange(0, 7))] + ([None] if rng.random() < 0.2 else []), i) for i in range(90)]
    df = spark.createDataFrame(data, CLASS_SCHEMA)
    for t in (0.3, 0.5, 0.75):
        got = {(r.index_a, r.index_b): (r.n_shared, round(r.similarity, 9)) for r in classes.similar_classes(df, "i", ["name"], "hs", "h", t).collect()}
        want = {}
        for x in data:
            for y in data:
                if x[0] < y[0] and x[3] != y[3] and x[4] and y[4]:
                    s = len((set(x[4]) & set(y[4])) - {None})
                    sim = s / max(len(x[4]), len(y[4]))
                    if sim >= t:
                        want[(x[0], y[0])] = (s, round(sim, 9))
        assert got == want
    assert classes.similar_classes(df, "i", ["name"], "hs", "h", 1.0).collect() == []
    n = sum(1 for x in data for y in data if x[0] < y[0] and x[3] != y[3] and x[4] and y[4])
    assert classes.similar_classes(df, "i", ["name"], "hs", "h", 0.0).count() == n
    with pytest.raises(ValueError):
        classes.similar_classes(df, "i", ["name"], "hs", "h", 0.0, most_rows=5)


def test_shopping_cart_example(spark):
    cart = "class Cart:\n    def __init__(self):\n        self.items = []\n    def add(self, x):\n        self.items.append(x)\n    def total(self):\n        return sum(self.items)\n    def clear(self):\n        self.items = []\n"
    stock = "class Stock:\n    def __init__(self):\n        self.goods = []\n    def put(self, g):\n        self.goods.append(g)\n    def amount(self):\n        return sum(self.goods)\n"
    df = spark.createDataFrame([(0, cart), (1, stock)], "i long, code string")
    found = extract.python_classes(df, "code").withColumn("hs", F.col("methods.hash"))
    pair = classes.similar_classes(found, "i", ["name"], "hs", "class_hash", 0.5)
    assert [(r.n_shared, r.similarity) for r in pair.collect()] == [(3, 0.75)]
    d = classes.pair_details(pair, found, "i", "methods").first()
    assert d.only_in_a == [] and sorted(d.shared) == ["add", "clear", "total"]


def test_extraction_keeps_rows_whole(spark):
    df = spark.createDataFrame([(1, "def a(x):\n    return x\n", "clash"), (2, None, "n"), (3, "", "e"), (4, "def broken(:", "b")], "id int, code string, name string")
    out = extract.python_functions(df, "code").collect()
    assert [(r.id, r.name, r.lineno, r.walk_ord) for r in out] == [(1, "a", 1, 0)]
    with pytest.raises(Exception):  # noqa: B017
        extract.python_functions(df, "code", on_error="fail").collect()
    assert extract.js_functions(spark.createDataFrame([("const f = x => x;",)], "code string"), "code").first().body_src == "{ x }"


def test_sql_registration(spark):
    sql.register(spark)
    assert spark.sql("SELECT sem_hash('def f(a): return a') = sem_hash('def g(b): return b') AS same").first().same
    assert spark.sql("SELECT name FROM extract_functions('def q(): pass')").first().name == "q"
    assert spark.sql("SELECT sem_hash(CAST(NULL AS STRING)) AS h").first().h is None


def test_column_functions(spark):
    r = spark.createDataFrame([("a b/ü.py", "C.m", 3, "x\r\n \n\ty")], "f string, q string, n int, t string").select(
        sql.safe_slug(F.col("f")).alias("slug"), sql.module_name(F.col("f")).alias("module"), sql.nonblank_lines(F.col("t")).alias("lines"),
        sql.extension(F.col("f")).alias("ext"), sql.extension(F.lit("dir.x/none")).alias("no_ext"), sql.extension(F.lit(".bashrc")).alias("dot"),
        sql.occurrence_filename(F.lit(7), F.col("f"), F.col("n"), F.col("q"), F.lit("0123456789")).alias("name"),
    ).first()
    assert tuple(r) == ("a_b_ü.py", "a b.ü", 2, ".py", "", "", "0007_a_b_ü.py_L3_C.m_01234567.py")


def test_pack_round_trip(spark, tmp_path):
    data = [("m.py", "f", 1, "def f(a):\n    return a + 1"), ("m.py", "g", 5, "def g(b):\n    return b + 1"), ("n.py", "h", 1, "def h(c, d=2):\n    x = c * d\n    return x"), ("n.py", "bad", 9, "def (")]
    df = spark.createDataFrame(data, "file string, q string, line int, code string")
    made = pack.pack_python(df, "file", "q", "line", "code")
    made.write(str(tmp_path / "p"))
    read = pack.Pack.read(spark, str(tmp_path / "p"))
    meta = read.meta().first()
    assert (meta.functions, meta.unique_roots, meta.namemaps) == (3, 2, 3)
    back = pack.restore_python(pack.documents_of(read)).collect()
    assert {r.qualname: r.restored_src for r in back} == {q: c for _, q, _, c in data[:3]}
    assert read.nodes.count() == read.nodes.select("node_id").distinct().count()


def test_stores_and_restored_text(spark):
    df = spark.createDataFrame([("h", 2, "b"), ("h", 1, "a"), (None, 3, "c")], "k string, o int, t string")
    assert rows(pack.first_store(df, "k", ["o"], ["t"])) == [("h", "a")]
    assert tuple(pack.pack_counts(df, "k").first()) == (2, 1, 1)
    text = pack.restore_text(spark.createDataFrame([("f", 2, "y"), ("f", 1, "x")], "file string, line int, t string"), "file", "line", "t").first()
    assert text.content == "x\n\ny"
    assert pack.bundle_size(df.limit(0), "t", "t").first().ratio == 0.0


def test_merge(spark):
    a, b = "def f(x):\n    return x\n\ndef other():\n    return 1\n", "import os\n\ndef g(y):\n    return y\n"
    src = spark.createDataFrame([("a.py", a), ("pkg/b.py", b), ("bad.py", "def (")], "path string, content string")
    found = extract.python_functions(src, "content").withColumn("h", sql.sem_hash(F.col("source")))
    plan = merge.merge_plan(found, "h", "path", "name", "lineno")
    assert [(r.file, r.name, r.module, r.import_statement) for r in plan.collect()] == [("pkg/b.py", "g", "a", "from a import f as g")]
    new = merge.apply_plan(src, plan).collect()
    assert [(r.path, r.new_source, r.error) for r in new] == [("pkg/b.py", "import os\nfrom a import f as g\n\n", None)]
    saved = merge.lines_saved(src, merge.apply_plan(src, plan)).first()
    assert saved.saved == 1
    js = spark.createDataFrame([("a.js", "function f(a) { return a; }"), ("b.js", "function g(b) { return b; }\ng(1);")], "path string, content string")
    jplan = spark.createDataFrame([("b.js", "g", "f")], "file string, name string, canonical_name string")
    out = merge.apply_js(js, jplan).first().new_source
    assert "function g" not in out and "f(1)" in out and "utils.js" in out
    assert merge.merge_plan(found.limit(0), "h", "path", "name", "lineno").collect() == []


def test_translation(spark):
    ok, other = "def f(a):\n    return a + 1", "def f(a):\n    return a - 1"
    backend = translate.recorded_backend({("Java", "one"): [ok, ok], ("Java", "two"): ["nonsense (", ok, other], ("Java", "three"): ["no", "no"], ("Go", "four"): [ok, "("]})
    df = spark.createDataFrame([(1, "Java", "one"), (2, "Java", "two"), (3, "Java", "three"), (4, "Go", "four"), (5, "Java", "one"), (6, None, "x"), (7, "C", "missing")], "id int, lang string, code string")
    out, fresh = translate.translate(df, "lang", "code", backend)
    got = {r.id: r.confidence for r in out.collect()}
    assert got == {1: "HIGH", 2: "LOW", 3: "FAILED", 4: "MEDIUM", 5: "HIGH", 6: None, 7: "FAILED"}
    assert fresh.filter("confidence = 'LOW'").count() == 0 and fresh.count() == 4
    again, more = translate.translate(df, "lang", "code", translate.recorded_backend({}), cache=fresh)
    assert {r.id: (r.confidence, r.cache_hit) for r in again.collect()}[1] == ("HIGH", True)
    assert translate.usable(out).count() == 4
    counts_ = {r.confidence: r.n for r in translate.confidence_counts(out, "confidence").collect()}
    assert counts_["MEDIUM"] == 2


def test_file_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_bytes(b"x = 1\n")
    (tmp_path / "sub" / "b.js").write_bytes(b"\xff let y;")
    (tmp_path / "sub" / "c.txt").write_text("no")
    got = {r.rel_path: (r.ext, r.lang, r.content) for r in files.discover(spark, str(tmp_path), [".py", ".js"]).collect()}
    assert got == {"a.py": (".py", "Python", "x = 1\n"), "sub/b.js": (".js", "JavaScript", "� let y;")}
    assert files.discover(spark, str(tmp_path), [".js"], errors="ignore").first().content == " let y;"
    assert files.discover(spark, str(tmp_path), [".js"], recursive=False).count() == 0
    assert files.parse_ignore(["a", "", "#x", " #y "]) == ["a", "#y"]
    listing = spark.createDataFrame([("a.py", "blob", None), ("b.py", "blob", 500000), ("dist/c.py", "blob", 1), ("d.py", "tree", 1)], "path string, type string, size long")
    assert rows(files.remote_listing(listing, [".py"]).select("path")) == [("a.py",)]
    files.write_report(listing, str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).count() == 4
    fs = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, file_sha256 string")
    cache = spark.createDataFrame([("a", "1", "f"), ("b", "old", "g")], "path string, file_sha256 string, qualname string")
    kept, todo = files.file_cache(fs, cache)
    assert rows(kept.select("qualname")) == [("f",)] and rows(todo.select("path")) == [("b",)]


def test_stream_counts(spark, tmp_path):
    data = spark.createDataFrame([("a", 5), ("a", 2), ("b", 1), (None, 0)], "k string, o long")
    data.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    counts.upsert_counts(stream, "k", "o", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    data.write.mode("append").parquet(str(tmp_path / "in"))
    counts.upsert_counts(stream, "k", "o", str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    assert rows(counts.current_counts(spark, str(tmp_path / "out"), "k")) == [("a", 4, 2), ("b", 2, 1)]
    assert rows(counts.merged_counts(counts.batch_counts(data, "k", "o"), counts.batch_counts(data, "k", "o"), "k")) == [("a", 4, 2), ("b", 2, 1)]


def test_entry_points_are_complete():
    import __spark_entry__ as e

    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and {"p4_found", "p6_found"} <= set(q)
