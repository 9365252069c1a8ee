import io
import json
import zipfile

import pytest

from codeweft import commands
from codeweft.functions import pysource, rawcode
from codeweft.operators import classes, clusters, extract, merge, pack, reports, scan, translate
from codeweft.sources import files
from codeweft.streaming import counts

PY = "import os\n\n\ndef a(x):\n    return x + 1\n\n\ndef b(y):\n    return y + 1\n\n\nclass C:\n    def m(self):\n        return a(2)\n"


def test_listing_source(spark, tmp_path):
    files.register_sources(spark)
    tree = [{"path": "src/a.py", "type": "blob", "size": 10}, {"path": "src", "type": "tree"}, {"type": "blob"}, {"path": "dist/b.py", "type": "blob", "size": 5}, {"path": "c.py", "type": "blob"}]
    (tmp_path / "one.json").write_text(json.dumps({"tree": tree}))
    (tmp_path / "two.json").write_text(json.dumps({"message": "not found"}))
    found = spark.read.format("tree_listing").load(str(tmp_path))
    assert found.count() == 4 and {r.repo for r in found.collect()} == {"one"}
    assert {r.path for r in files.remote_listing(found, [".py"]).collect()} == {"src/a.py", "c.py"}
    assert spark.read.format("tree_listing").option("repo", "x").load(str(tmp_path / "one.json")).first().repo == "x"


def test_discovery_modes(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "sub" / "b.py").write_text("y = 1\n")
    (tmp_path / "c.PY").write_text("z = 1\n")
    root = str(tmp_path)
    rows = {r.rel_path: r for r in files.discover(spark, root, [".py"]).collect()}
    assert set(rows) == {"a.py", "sub/b.py"} and "\ufffd" in rows["a.py"].content
    assert "\ufffd" not in files.discover(spark, root, [".py"], False, "ignore").collect()[0].content
    assert files.discover(spark, root, [".py"], False).count() == 1


def test_mixed_functions(spark):
    rows = [("a.py", PY, "n"), ("a.js", "function f(a) { return a; }", "n"), ("B.TSX", "function g(q: number) { return q; }", "n"), ("c.txt", PY, "n"), ("d.py", None, "n"), (None, PY, "n"), ("e.py", "def (", "n"), ("f.py", "", "n")]
    df = spark.createDataFrame(rows, "path string, content string, lang string")
    found = scan.mixed_functions(df, "content", "path").collect()
    assert sorted((r.path, r.name, r.lang) for r in found) == [("B.TSX", "g", "TypeScript"), ("a.js", "f", "JavaScript"), ("a.py", "a", "Python"), ("a.py", "b", "Python")]
    every = scan.mixed_functions(df, "content", "path", keep_unhashed=True)
    assert every.filter("name = 'm' and sem_hash is null").count() == 1
    one = scan.scan_summary(scan.mixed_functions(df, "content", "path")).first()
    assert (one.total_functions, one.duplicate_clusters, one.health_score, one.strict_exit) == (4, 2, 0, 1)
    none = scan.scan_summary(scan.mixed_functions(df.limit(0), "content", "path")).first()
    assert (none.total_functions, none.health_score, none.strict_exit) == (0, 100, 0)


def test_mixed_classes_with_failed_translation(spark):
    java = "class T { int f() { return 1; } }\nclass U { }"
    backend = translate.recorded_backend({("Java", "class T { int f() { return 1; } }"): ["class X:\n    def f(self):\n        return 1", "class Y:\n    def f(self):\n        return 2"], ("Java", "class U { }"): ["nothing", "nothing"]})
    df = spark.createDataFrame([("t.java", java), ("p.py", PY), ("x.md", java), ("q.kt", None)], "path string, content string")
    found = scan.mixed_classes(df, "content", "path", backend).collect()
    assert sorted((r.path, r.name, r.ai_translated, r.ai_confidence, r.original_language) for r in found) == [("p.py", "C", False, None, "Python"), ("t.java", "T", True, "LOW", "Java")]


def test_archives(spark):
    df = spark.createDataFrame([(f"d/{i}.py", "é" * 40) for i in range(30)] + [("n.py", None)], "path string, content string").repartition(2)
    got = reports.archives(df, "path", "content", 400).collect()
    names = [n for r in got for n in zipfile.ZipFile(io.BytesIO(bytes(r.archive))).namelist()]
    assert sorted(names) == sorted([f"d/{i}.py" for i in range(30)] + ["n.py"]) and len(got) > 5
    assert reports.archives(df.limit(0), "path", "content").collect() == []


def test_reports_of_nothing(spark):
    df = spark.createDataFrame([("h", "f", 1, "n")], "h string, file string, line int, name string")
    members = reports.cluster_members(df, "h", ["file", "line", "name"])
    assert members.collect() == [] and reports.markdown_lines(members, "h", "name", "file", "line", "file").collect() == []


def test_pairs_against_truth(spark):
    rows = spark.createDataFrame([("h", "f", "a"), ("h", "f", "b"), ("h", "f", "b"), ("h", "g", "c"), ("k", "g", "d"), (None, "g", "e")], "h string, file string, name string")
    truth = spark.createDataFrame([("f", "b", "f", "a"), ("f", "a", "f", "b"), ("g", "d", "g", "e")], "file_a string, name_a string, file_b string, name_b string")
    r = clusters.pairs_against_truth(rows, "h", "file", "name", truth).first()
    assert (r.tp, r.fp, r.fn) == (1, 2, 1) and r.precision == pytest.approx(1 / 3) and r.recall == 0.5
    r = clusters.pairs_against_truth(rows.limit(0), "h", "file", "name", truth.limit(0)).first()
    assert (r.tp, r.fp, r.fn, r.precision, r.recall) == (0, 0, 0, 1.0, 1.0)


def test_shared_module_merge(spark):
    df = spark.createDataFrame([("m.py", PY), ("bad.py", "def (")], "path string, content string")
    plan = spark.createDataFrame([("m.py", "b", 8, "m.py", "a", 4), ("bad.py", "z", 1, "m.py", "a", 4)], "file string, name string, lineno int, canonical_file string, canonical_name string, canonical_lineno int")
    out = {r.path: r for r in merge.apply_python(df, plan).collect()}
    assert "def a" not in out["m.py"].new_source and "def b" not in out["m.py"].new_source and "from utils import a" in out["m.py"].new_source
    assert out["bad.py"].new_source == "def (" and out["bad.py"].error
    assert [(r.name, r.source) for r in merge.utils_module(df, plan).collect()] == [("a", "def a(x):\n    return x + 1")]


def test_restored_files_without_hashes(spark):
    df = spark.createDataFrame([(None, "f", "a", 1, "A"), (None, "f", "b", 0, "B"), ("h", "g", "c", 1, "C"), ("h", "g", "d", 2, "D")], "h string, file string, name string, line int, src string")
    out, utils = merge.restore_files(df, "h", "file", "name", "line", "src")
    assert {r.path: r.content for r in out.collect()} == {"f": "B\n\nA", "g": "from utils import c"}
    assert [tuple(r) for r in utils.collect()] == [("c", "C")]


def test_script_rewriting():
    js = "import { q } from './q.js';\n// function f() {}\nconst s = 'f(1)';\nasync function f(a, b = (1)) { return { a }; }\nconst g = async (x) => { return f(x); };\no.f(2); f (3);"
    out = pysource.remove_js_function(js, "f")
    assert "async function f" not in out and "// function f" in out and "const g" in out
    assert "const g" not in pysource.remove_js_function(js, "g") and pysource.remove_js_function(js, "h") == js
    out = pysource.rename_js_calls(js, "f", "k")
    assert "return k(x)" in out and "'f(1)'" in out and "o.f(2); k(3)" in out and "function f(a" in out
    assert pysource.add_js_import(js, "q", "q.js") == js and pysource.add_js_import(js, "z").splitlines()[1] == "import { z } from './utils.js';"
    assert pysource.add_js_import("x();", "z").startswith("import { z }") and pysource.remove_js_function("", "f") == ""


def test_own_heads():
    cpp = "template <class T>\nvoid A::run(T *x, int y) const {\n  if (y) { go(); }\n}\n"
    assert [(b.name, b.line) for b in rawcode.raw_functions(cpp, "C++", quirks=False)] == [("run", 1)]
    cs = "[Test]\npublic async Task<int> Run<T>(int a) where T : X {\n  return 1;\n}\n"
    assert [b.name for b in rawcode.raw_functions(cs, "C#", quirks=False)] == ["Run"]


def test_classes_inside_methods_hash_alike():
    inner = "    class I:\n        def k(self):\n            return self.z\n"
    nested = "class O:\n    def m(self, x):\n        class I:\n            def k(self):\n                return self.z\n        return I\n"
    found = {c.name: c.hash for c in pysource.classes(nested)}
    alone = pysource.classes("if 1:\n" + inner)[0]
    assert found["I"] == alone.hash and len(found) == 2


def test_segments_of_odd_lines():
    source = "def f():\r\n    return 'é'\r\n\x0c\ndef g(): return '''\n\x0c'''\n"
    assert [f.source for f in pysource.top_functions(source)] == ["def f():\r\n    return 'é'", "def g(): return '''\n\x0c'''"]


def test_store_nodes_are_all_there(spark):
    code = "def f{0}(a):\n    return a + {1}\n"
    df = spark.createDataFrame([(f"f{i}", f"n{i}", 1, code.format(i, i % 3)) for i in range(40)], "file string, name string, line int, code string")
    made = pack.pack_python(df, "file", "name", "line", "code")
    docs = extract.documents(df, "code")
    assert {r.node_id for r in made.nodes.collect()} == {n.node_id for r in docs.collect() for n in r.nodes}


def test_namesakes(spark):
    df = spark.createDataFrame([(1, "A", ["x", "y"], "1"), (2, "A", ["x", "z"], "2"), (3, "A", ["x"], "3"), (4, "B", ["x", "y"], "4")], "i long, name string, hs array<string>, ch string")
    got = {(r.index_a, r.index_b) for r in classes.similar_classes(df, "i", ["name"], "hs", "ch", 0.5).collect()}
    assert got == {(1, 2), (1, 4)}


def test_compacted_counts_go_on(spark, tmp_path):
    src, out, folded = (str(tmp_path / x) for x in ("src", "out", "folded"))
    spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, o long").write.parquet(src)
    stream = lambda: spark.readStream.schema("k string, o long").parquet(src)
    counts.upsert_counts(stream(), "k", "o", out, str(tmp_path / "ckpt")).awaitTermination()
    counts.compact_counts(spark, out, "k", folded)
    spark.createDataFrame([("a", 0)], "k string, o long").write.mode("append").parquet(src)
    counts.upsert_counts(stream(), "k", "o", folded, str(tmp_path / "ckpt")).awaitTermination()
    assert {(r.k, r.n, r.first) for r in counts.current_counts(spark, folded, "k").collect()} == {("a", 2, 0), ("b", 1, 2)}


def test_commands(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    (tmp_path / "a" / "m.py").write_text(PY)
    (tmp_path / "b" / "n.py").write_text("def q(w):\n    return w + 1\n\n\ndef r():\n    return 9\n")
    a, b, store = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "pack")
    rows, status = commands.run(spark, ["scan", a, "--strict"])
    assert status == 1 and [json.loads(r.value)["name"] for r in rows.collect()] == ["a", "b"]
    assert commands.run(spark, ["scan", b, "--strict"])[1] == 0
    r = commands.run(spark, ["health", a])[0].first()
    assert (r.total, r.dup_members, r.health) == (3, 2, 33)
    rows, _ = commands.run(spark, ["diff", a, b])
    assert sorted(r.status for r in rows.collect()) == ["common", "only_b"]
    assert commands.run(spark, ["pack", a, store])[0].first().functions == 3
    assert commands.run(spark, ["verify", a, store])[1] == 0 and commands.run(spark, ["verify", b, store])[1] == 1
    assert commands.run(spark, ["restore", store])[0].count() == 3
    assert [r.name for r in commands.run(spark, ["merge-plan", a])[0].collect()] == ["b"]
    assert commands.run(spark, ["class-scan", a, "--min-similarity", "0.5"])[0].collect() == []
