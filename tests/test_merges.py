import io
import tracemalloc
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeweft.functions import jscanon, pysource, sql
from codeweft.operators import extract, merge, reports
from codeweft.plans import rewrite_plans
from codeweft.session import cut

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query", ["merge_chosen", "merge_lines_saved", "merge_shared_module", "merge_delete_only", "merge_utils", "merge_apply", "js_merge", "restored_archives", "restored_utils", "restored_whole_files"])
def test_functions_come_without_their_file(spark, monkeypatch, query):
    """A file's text beside each of its functions grows with the square of the file."""
    made, explode = [], extract.explode_text

    def recorded(*args, **more):
        made.append(explode(*args, **more))
        return made[-1]

    monkeypatch.setattr(extract, "explode_text", recorded)
    rewrite_plans.QUERIES[query](spark, DATA)
    assert made and all("content" not in df.columns for df in made)


def test_wide_columns_go_out_in_small_batches(spark, monkeypatch):
    """What comes along with many rows of one text is copied for few of them at a time."""
    sizes = []
    df = spark.createDataFrame([(1, "x" * 300_000), (2, "y"), (3, None)], "k int, t string").coalesce(1)
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: sizes.extend(b.nbytes for b in run(iter(self.toArrow().to_batches()))))
    extract.explode_text(df, ["t"], lambda t: [(str(i),) for i in range(200 if t and len(t) > 1 else 0 if t is None else 1)], "n string")
    assert sum(sizes) > 60_000_000 and max(sizes) < 2 * (8 << 20)
    monkeypatch.undo()
    out = extract.explode_text(df, ["t"], lambda t: [(str(i),) for i in range(3)], "n string", keep=["k"])
    assert [tuple(r) for r in out.orderBy("k", "n").collect()] == [(k, str(i), i) for k in (1, 2, 3) for i in range(3)]


def test_many_imports_come_in_one_pass(monkeypatch):
    parses, parse = [], pysource.parse
    monkeypatch.setattr(pysource, "parse", lambda text: parses.append(text) or parse(text))
    imports = [f"from m{i % 7} import f{i} as g{i}" for i in range(50)]
    for text in ("", "x = 1", "x = 1\n", '"""doc"""\nx = 1\n', "import os\n\nx = 1\n# from z import q\nfrom m3 import f3 as g3\ny = 2\n", "# remark\n\ndef f():\n    import a\n"):
        want = text
        for statement in imports:
            want = pysource.add_import(want, statement)
        parses.clear()
        assert pysource.add_imports(text, imports) == want and len(parses) == 2
    with pytest.raises(SyntaxError):
        pysource.add_imports("x = 1\n", ["from a-b import c", "from d import e"])


def test_functions_of_a_file_are_found_in_one_pass(monkeypatch):
    parses, parse = [], pysource.parse
    monkeypatch.setattr(pysource, "parse", lambda text: parses.append(text) or parse(text))
    text = "def a():\n    return 1\n\ndef b(): pass\n\ndef a():\n    return 2\n"
    assert pysource.find_functions(text, ["a", "b", "c", None]) == {"a": "def a():\n    return 1", "b": "def b(): pass"} and len(parses) == 1
    assert pysource.find_functions("def (", ["a"]) == {} == pysource.find_functions(None, ["a"])


def test_script_tokens_share_their_texts():
    js = "\n".join(f"function f{i}(abc) {{ return abc + {i}; }}" for i in range(300))
    toks = jscanon.lex(js)
    assert len({id(t.text) for t in toks}) == len({t.text for t in toks}) and [t.line for t in toks if t.text == "function"] == list(range(1, 301))


@pytest.mark.parametrize("query", ["merge_shared_module", "merge_apply", "merge_delete_only", "restored_whole_files", "restored_archives", "restored_utils"])
def test_functions_are_found_and_hashed_by_one_worker(spark, monkeypatch, query):
    """A hash column behind the extraction takes a second Python worker for each core."""
    made, explode = [], extract.explode_text

    def recorded(*args, **more):
        made.append(explode(*args, **more))
        return made[-1]

    monkeypatch.setattr(extract, "explode_text", recorded)
    rewrite_plans.QUERIES[query](spark, DATA)
    assert len(made) == 1 and "sem_hash" in made[0].columns and ("source" in made[0].columns) == query.startswith("restored")


def test_hashed_functions_are_those_found_alone(spark):
    df = spark.createDataFrame([(1, "def a(x):\n    return x\n\nclass C:\n    def m(self): pass\n\ndef b(y):\n    return y\n"), (2, "def ("), (3, None), (4, "")], "k int, t string")
    want = extract.python_functions(df, "t", keep=["k"]).withColumn("sem_hash", sql.sem_hash(F.col("source")))
    cols = ["k", "walk_ord", "name", "lineno", "source", "sem_hash"]
    got = extract.hashed_functions(df, "t", keep=["k"])
    rows = sorted(map(tuple, got.select(cols).collect()))
    assert rows == sorted(map(tuple, want.select(cols).collect())) and len(rows) == 3
    assert extract.hashed_functions(df, "t", source=False, keep=["k"]).columns == ["k", "name", "lineno", "sem_hash", "walk_ord"]


def test_large_sources_are_parsed_in_pieces(monkeypatch):
    """The tree of a whole source takes 100 times its size."""
    sizes, parse = [], pysource.parse
    monkeypatch.setattr(pysource, "parse", lambda text: sizes.append(len(text)) or parse(text))
    large = '"""doc"""\n' + "".join(f"def f{i}(a):\n    return g{i}(a)\n\n" for i in range(12_000))
    found = pysource.top_functions(large)
    assert len(found) == 12_000 and found[-1] == ("f11999", 2 + 3 * 11_999, "def f11999(a):\n    return g11999(a)")
    left = pysource.remove_functions(large, [(f.name, f.line) for f in found[1:]])
    assert left == '"""doc"""\ndef f0(a):\n    return g0(a)\n\n'
    assert pysource.rename_calls(large, {"g11999": "h"}).endswith("\n\ndef f11999(a):\n    return h(a)")
    assert pysource.add_imports(large, ["import x", "import y"]).startswith('"""doc"""\nimport x\nimport y\ndef f0(a)')
    assert max(sizes) < len(large) / 4


def test_pieces_end_where_statements_end(monkeypatch):
    good = [
        '"""doc\ndef no(): pass\n"""\nx = 1\nimport os\ndef a():\n    return (1,\n2)\n@d(\n)\ndef b(): c(1)\nx = [\n"""\nclass N: pass\n"""]\nfrom q \\\nimport z\nclass C:\n    """doc"""\n    @e\n    def m(self): c(2)\nasync def f(): pass\nif x:\n    c(3)\nelse:\n    pass\n',
        "# remark\nimport os\n'text'\ndef a(): return c('é\\x0c')\n\x0c\ndef b(): pass", "", "x = 1", "'doc'\nx = c(1)\ndef a(): pass\n",
    ]
    bad = ["def a(): pass\ndef b(\ndef c(): pass\n", "x = 1\n@d\n", "def a(): pass\nimport os\n\x00", "def a(): pass\nimport \ud800\n"]
    for text in [*good, *(x.replace("\n", "\r\n") for x in good), *bad]:
        seen = []
        for size in (1 << 30, 1, 20):
            monkeypatch.setattr(pysource, "PIECE", size)
            try:
                found = pysource.top_functions(text)
                seen.append((found, pysource.remove_functions(text, [f[:2] for f in found[::2]]), pysource.rename_calls(text, {"c": "k"}), pysource.add_imports(text, ["import k", "from k import q"])))
            except (SyntaxError, ValueError) as e:
                seen.append((type(e), str(e)))
        assert seen[0] == seen[1] == seen[2]


def _columns(kind):
    return [*kind.fieldNames(), *(c for f in kind.fields for c in _inside(f.dataType))]


def _inside(kind):
    kind = getattr(kind, "elementType", kind)
    return _columns(kind) if hasattr(kind, "fieldNames") else []


PLAN = "file string, name string, lineno int, canonical_file string, canonical_name string, canonical_lineno int, import_statement string"
COPIES = [("m.py", "b", 4, "a.py", "a", 1, "from a import a as b"), ("m.py", "c", 7, "a.py", "a", 1, "from a import a as c"), ("m.py", "d", 10, "m.py", "x", 1, "from m import x as d")]
SOURCE = "def x():\n    pass\n\ndef b():\n    return 1\n\ndef c():\n    return 2\n\ndef d():\n    return 3\n"


def _given(monkeypatch):
    """Types of what the workers get."""
    given, rewritten = [], merge._rewritten
    monkeypatch.setattr(merge, "_rewritten", lambda df, inputs, *more: given.append([df.schema[c].dataType for c in inputs]) or rewritten(df, inputs, *more))
    return given


def test_removals_go_to_the_worker_as_plain_arrays(spark, monkeypatch):
    """An array of structs becomes a dictionary for each removal, with a text for each import."""
    given = _given(monkeypatch)
    out = merge.apply_plan(spark.createDataFrame([("m.py", SOURCE), ("n.py", SOURCE)], "path string, content string"), spark.createDataFrame(COPIES + [("n.py", "b", 4, "a.py", "a", 1, None)], PLAN))
    assert given and not any(_inside(kind) for kind in given[0])
    rows = {r.path: r for r in out.collect()}
    assert rows["m.py"].new_source == "from a import a as b\nfrom a import a as c\ndef x():\n    pass\n\n" and (rows["m.py"].removed, rows["m.py"].error) == (3, None)
    assert rows["n.py"].new_source == SOURCE.replace("def b():\n    return 1\n\n", "") and rows["n.py"].removed == 1


def test_a_merge_that_only_deletes_gathers_no_imports(spark, monkeypatch):
    given = _given(monkeypatch)
    plan = spark.createDataFrame(COPIES, PLAN)
    out = merge.apply_plan(spark.createDataFrame([("m.py", SOURCE)], "path string, content string"), plan, imports=False)
    assert [kind.simpleString() for kind in given[0]] == ["string", "array<int>", "array<string>"]
    assert "import_statement" not in out._jdf.queryExecution().optimizedPlan().toString().split("Aggregate", 1)[1].splitlines()[0]
    assert [tuple(r) for r in out.collect()] == [("m.py", "def x():\n    pass\n\n", 3, None)]


def test_the_utils_module_is_restored_without_writing_the_functions(spark, monkeypatch):
    """One aggregate reads them; written and read again they take a share of every executor."""
    written = []
    monkeypatch.setattr(rewrite_plans, "cut", lambda df: written.append(df) or cut(df))
    got = rewrite_plans.restored_utils(spark, DATA)
    assert not written
    hashed = spark.createDataFrame(rewrite_plans._functions(spark, DATA).collect())
    _, utils = merge.restore_files(hashed, "sem_hash", "path", "name", "lineno", "source")
    want = utils.select("name", sql.source_hash(F.col("source")).alias("source_sha256"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()


def _archives(spark, monkeypatch, texts, limit):
    """What archives gives for texts in batches of ten, and the most memory that Python takes for it."""
    runs, df = [], spark.createDataFrame([], "path string, content string")
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run))
    reports.archives(df, "path", "content", limit)
    names = [f"f{i}" for i in range(len(texts))]
    batches = [pa.RecordBatch.from_arrays([pa.array(names[i : i + 10]), pa.array(texts[i : i + 10], pa.string())], names=["path", "content"]) for i in range(0, len(texts), 10)]
    tracemalloc.start()
    out = [r for b in runs[0](iter(batches)) for r in b.to_pylist()]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_files_are_packed_as_they_come(spark, monkeypatch):
    """A worker held the texts of a whole archive, and the files of a batch twice."""
    out, most = _archives(spark, monkeypatch, ["x" * 1_000_000] * 40, 64 << 20)
    assert [r["n_files"] for r in out] == [40] and most < 8_000_000
    out, _ = _archives(spark, monkeypatch, ["a" * 60, None, "b" * 60, "é" * 200, "", "c"], 100)
    assert [r["n_files"] for r in out] == [2, 1, 1, 2]
    held = [{n: z.read(n).decode() for n in z.namelist()} for z in (zipfile.ZipFile(io.BytesIO(r["archive"])) for r in out)]
    assert held == [{"f0": "a" * 60, "f1": ""}, {"f2": "b" * 60}, {"f3": "é" * 200}, {"f4": "", "f5": "c"}]
    assert _archives(spark, monkeypatch, [], 100)[0] == []


FUNCTIONS = "h string, file string, name string, line int, src string"


def test_no_join_moves_the_sources_of_restored_files(spark):
    rows = [("h", "f", "a", 9, "A"), ("h", "g", "b", 1, "B"), ("h", "g", "c", 5, "C"), ("u", "g", "d", 3, "D"), (None, "g", "e", 2, "E"), ("h", "g", None, 4, "N"), ("v", None, "z", 1, "Z"), ("w", "k", "p", 1, "P"), ("w", "k", "p", 1, "P")]
    files, utils = merge.restore_files(spark.createDataFrame(rows, FUNCTIONS).cache(), "h", "file", "name", "line", "src")
    assert {r.path: (r.content, r.n_functions) for r in files.collect()} == {"f": ("from utils import a", 0), "g": ("from utils import a\n\nE\n\nD\n\nN", 3), "k": ("from utils import p", 0), None: ("Z", 1)}
    assert sorted(map(tuple, utils.collect())) == [("a", "A"), ("p", "P")]
    plan, joins = files._jdf.queryExecution().optimizedPlan(), 0
    left = [plan]
    while left:
        node = left.pop()
        below = [node.children().apply(i) for i in range(node.children().size())]
        left += below
        if node.nodeName() == "Join":
            joins += 1
            names = [x.output().apply(i).name() for x in below for i in range(x.output().size())]
            assert not {"src", "source", "own"} & set(names), names
    assert joins
