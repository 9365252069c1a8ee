"""Code generated from rows of plain tables, so that the structure of each piece is known from its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.session import shuffle_partitions


def _text(template: str, **parts: Column) -> Column:
    pieces, out = template.split("~"), []
    for i, p in enumerate(pieces):
        out.append(parts[p].cast("string") if i % 2 else F.lit(p))
    return F.concat(*out)


def _wide(df: DataFrame) -> int:
    """Partitions for rows whose parsing costs much more than their size tells."""
    return max(df.sparkSession.sparkContext.defaultParallelism, shuffle_partitions(df.sparkSession))


def python_parts(part: DataFrame) -> DataFrame:
    """part with a Python function: names vary by key, the only kept literal is p_size."""
    k = F.col("p_partkey")
    code = _text("def part_~k~(a~k~, b~k~):\n    r~k~ = a~k~ * ~n~\n    if r~k~ > b~k~:\n        return r~k~\n    return b~k~ + r~k~\n", k=k, n=F.col("p_size"))
    path = F.concat(F.lit("src/"), F.translate("p_brand", "#", "_"), F.lit("/m"), (k % 7).cast("string"), F.lit(".py"))
    return part.select("p_partkey", "p_brand", "p_type", "p_size", path.alias("file"), F.concat(F.lit("part_"), k.cast("string")).alias("name"), code.alias("code"))


#: Builtins by order priority.
BUILTINS = {"1": "len", "2": "sum", "3": "max", "4": "min", "5": "sorted"}


def python_orders(orders: DataFrame) -> DataFrame:
    """orders with a Python function that calls one builtin, chosen by the priority's first character."""
    chosen = F.element_at(F.create_map(*[F.lit(x) for kv in BUILTINS.items() for x in kv]), F.substring("o_orderpriority", 1, 1))
    code = _text("def order_~k~(xs~k~):\n    y~k~ = ~f~(xs~k~)\n    return y~k~\n", k=F.col("o_orderkey"), f=F.coalesce(chosen, F.lit("abs")))
    return orders.select("o_orderkey", "o_custkey", "o_orderpriority", code.alias("code"))


#: Operators by the rank of a part type among all types' lengths: only the operator survives hashing.
OPERATORS = ["+", "-", "*", "/", "%", "&"]


def type_operator(kind: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in OPERATORS]), (F.length(kind) % 6 + 1).cast("int"))


def js_parts(part: DataFrame) -> DataFrame:
    """part with a JavaScript function: operator by type, a number literal that must vanish."""
    code = _text("function part~k~(a~k~, b~k~) { const r~k~ = a~k~ ~o~ b~k~; return r~k~ + ~n~; }", k=F.col("p_partkey"), o=type_operator(F.col("p_type")), n=F.col("p_size"))
    return part.select("p_partkey", "p_type", "p_size", type_operator(F.col("p_type")).alias("operator"), code.alias("code"))


def python_operator_parts(part: DataFrame) -> DataFrame:
    """The same function as js_parts in Python."""
    code = _text("def part~k~(a~k~, b~k~):\n    r~k~ = a~k~ ~o~ b~k~\n    return r~k~ + ~n~\n", k=F.col("p_partkey"), o=type_operator(F.col("p_type")), n=F.col("p_size"))
    return part.select("p_partkey", type_operator(F.col("p_type")).alias("operator"), code.alias("code"))


def ts_suppliers(supplier: DataFrame) -> DataFrame:
    """supplier with a TypeScript function, annotated at parameters and result only, of the structure of js_parts."""
    op = F.element_at(F.array(*[F.lit(x) for x in OPERATORS]), (F.col("s_suppkey") % 6 + 1).cast("int"))
    code = _text("function sup~k~(p~k~: number, q~k~: number): number { const t~k~ = p~k~ ~o~ q~k~; return t~k~ + ~k~; }", k=F.col("s_suppkey"), o=op)
    return supplier.select("s_suppkey", op.alias("operator"), code.alias("code"))


def python_classes(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """One Python class for each order with lines: a method for each line, its quantity as literal.

    Lines of an order are few by nature; they are joined to one text in order of line number.
    """
    method = _text("    def m~l~(self, x~k~):\n        return x~k~ * ~q~\n", k=F.col("l_orderkey"), l=F.col("l_linenumber"), q=F.col("l_quantity").cast("int"))
    # the partitions are set here once, for grouping, joining and the costly parsing that follows
    body = lineitem.repartition(_wide(lineitem), "l_orderkey").groupBy("l_orderkey").agg(
        F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity", method.alias("m")))).alias("_m")
    )
    joined = orders.join(body, orders.o_orderkey == body.l_orderkey)
    code = F.concat(_text("class Order~k~:\n", k=F.col("o_orderkey")), F.array_join(F.transform("_m", lambda x: x["m"]), ""))
    backwards = F.concat(_text("class Order~k~:\n", k=F.col("o_orderkey")), F.array_join(F.transform(F.reverse("_m"), lambda x: x["m"]), ""))
    return joined.select("o_orderkey", "o_custkey", code.alias("code"), backwards.alias("reversed_code"))


EXTENSIONS = [".py", ".js", ".tsx", ".java", ".rs", ".H", ".txt", ".cpp", ".fsx", ""]
FOLDERS = ["src", "node_modules", "lib/dist", ".cache", "tests", "app/build/x", "vendor", "pkg"]


def customer_files(customer: DataFrame) -> DataFrame:
    """customer as file rows: path by key, content a small text, size in bytes."""
    k = F.col("c_custkey")
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (k % len(EXTENSIONS) + 1).cast("int"))
    folder = F.element_at(F.array(*[F.lit(x) for x in FOLDERS]), (F.col("c_nationkey") % len(FOLDERS) + 1).cast("int"))
    name = F.concat(F.when(k % 11 == 0, F.lit("test_")).otherwise(F.lit("c")), k.cast("string"))
    return customer.select(
        "c_custkey", F.concat(folder, F.lit("/"), name, ext).alias("path"), F.concat(F.lit("x = "), k.cast("string")).alias("content"), (k * 97).cast("long").alias("size"), F.when(k % 13 == 0, F.lit("tree")).otherwise(F.lit("blob")).alias("type")
    )


#: Function blocks of languages without a parser here: language, code, and name, line and text of the block that is found
#: (line as the quirky finder gives it), or None. ~k~ stands for the row's key, ~n~ for a number of the row.
FUNCTION_BLOCKS: list[tuple[str, str, tuple[str, int, str] | None]] = [
    ("Java", "public class J~k~ {\n  public static int f~k~(int a) {\n    return a + ~n~;\n  }\n}\n", ("f~k~", 1, "\n  public static int f~k~(int a) {\n    return a + ~n~;\n  }")),
    ("C", "int c~k~(int a) {\n  return a * ~n~;\n}\n", ("c~k~", 1, "int c~k~(int a) {\n  return a * ~n~;\n}")),
    ("C++", "// ~n~\nint p~k~(int a) {\n  return a - ~n~;\n}\n", ("p~k~", 1, "~n~\nint p~k~(int a) {\n  return a - ~n~;\n}")),
    ("Rust", "fn r~k~(a: i32) -> i32 {\n    if a > ~n~ { a } else { ~n~ }\n}\n", ("r~k~", 1, "fn r~k~(a: i32) -> i32 {\n    if a > ~n~ { a } else { ~n~ }\n}")),
    ("Go", "package m\nfunc (s *S) g~k~(a int) int {\n\treturn a + ~n~\n}\n", ("g~k~", 2, "func (s *S) g~k~(a int) int {\n\treturn a + ~n~\n}")),
    ("Kotlin", "fun k~k~(a: Int): Int {\n    return a + ~n~\n}\n", ("k~k~", 1, "fun k~k~(a: Int): Int {\n    return a + ~n~\n}")),
    ("Swift", "func s~k~(a: Int) -> Int {\n    return a + ~n~\n}\n", ("s~k~", 1, "func s~k~(a: Int) -> Int {\n    return a + ~n~\n}")),
    ("Ruby", "# ~k~\n\ndef u~k~?(a)\n  a + ~n~\nend\n", ("u~k~?", 1, "def u~k~?(a)\n  a + ~n~\nend")),
    ("PHP", "<?php\nfunction h~k~($a) {\n  return $a + ~n~;\n}\n", ("h~k~", 2, "function h~k~($a) {\n  return $a + ~n~;\n}")),
    ("Dart", "int d~k~(int a) async {\n  return a + ~n~;\n}\n", ("d~k~", 1, "int d~k~(int a) async {\n  return a + ~n~;\n}")),
    ("Scala", "def x~k~(a: Int): Int = {\n  a + ~n~\n}\n", None),
    ("Elixir", "# ~n~\ndef e~k~(a) do\n  a + ~n~\nend\n", ("e~k~", 2, "def e~k~(a) do\n  a + ~n~\nend")),
    ("Lua", "function l~k~(a)\n  return a + ~n~\nend\n", None),
]
#: Class blocks likewise, with what the first and the plain finder give.
CLASS_BLOCKS: list[tuple[str, str, tuple[str, int, str] | None, tuple[str, int, str] | None]] = [
    ("Java", "public class J~k~ {\n  int f(int a) { return a + ~n~; }\n}\n", ("J~k~", 1, "class J~k~ {\n  int f(int a) { return a + ~n~; }\n}"), ("J~k~", 1, "public class J~k~ {\n  int f(int a) { return a + ~n~; }\n}")),
    ("Kotlin", "// class X\nopen class K~k~(val a: Int) {\n  fun f(b: Int): Int { return b + ~n~ }\n}\n", ("K~k~", 2, "class K~k~(val a: Int) {\n  fun f(b: Int): Int { return b + ~n~ }\n}"), ("K~k~", 2, "open class K~k~(val a: Int) {\n  fun f(b: Int): Int { return b + ~n~ }\n}")),
    ("C++", "class P~k~ {\n  int f(int a) { return a + ~n~; }\n};\n", ("P~k~", 1, "class P~k~ {\n  int f(int a) { return a + ~n~; }\n}"), ("P~k~", 1, "class P~k~ {\n  int f(int a) { return a + ~n~; }\n}")),
    ("Ruby", "# ~n~\nclass R~k~\n  def f(a)\n    a + ~n~\n  end\nend\n", ("R~k~", 2, "class R~k~\n  def f(a)\n    a + ~n~\n  end\nend"), ("R~k~", 2, "class R~k~\n  def f(a)\n    a + ~n~\n  end\nend")),
    ("Rust", "struct S~k~ {\n  v: i32,\n}\nimpl S~k~ {\n  fn f(&self) -> i32 { self.v + ~n~ }\n}\n", ("S~k~", 1, "// struct S~k~\nstruct S~k~ {\n  v: i32,\n}\n// impl S~k~\nimpl S~k~ {\n  fn f(&self) -> i32 { self.v + ~n~ }\n}"), None),
    ("Go", "type G~k~ struct {\n\tv int\n}\nfunc (g *G~k~) F() int {\n\treturn g.v + ~n~\n}\n", ("G~k~", 1, "// type G~k~ struct\ntype G~k~ struct {\n\tv int\n}\n// method\nfunc (g *G~k~) F() int {\n\treturn g.v + ~n~\n}"), None),
    ("Lua", "-- class L~k~\nlocal x = ~n~\n", None, ("L~k~", 1, "-- class L~k~\nlocal x = ~n~")),
]


def customer_blocks(customer: DataFrame, blocks: list[tuple]) -> DataFrame:
    """customer with a language and a code, one block after the other by key."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    at = k % len(blocks)
    pick = lambda f: F.coalesce(*[F.when(at == i, f(b)) for i, b in enumerate(blocks)])
    return customer.select("c_custkey", "c_nationkey", pick(lambda b: F.lit(b[0])).alias("language"), pick(lambda b: _text(b[1], k=k, n=n)).alias("code"))


#: Partitions of whole files for each one of rows: those of a partition go to a worker in one batch.
FILE_PARTS = 4


def part_files(part: DataFrame) -> DataFrame:
    """Python files of the functions of python_parts: path, content with an import and the functions in order of key, five lines and a blank one each."""
    rows = python_parts(part).repartition(FILE_PARTS * _wide(part), "file")
    joined = rows.groupBy(F.col("file").alias("path")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "code"))).alias("_f"))
    return joined.select("path", F.concat(F.lit("import os\n\n"), F.array_join(F.transform("_f", lambda x: x["code"]), "\n")).alias("content"))


def js_files(part: DataFrame) -> DataFrame:
    """JavaScript files of the functions of js_parts, one to a line."""
    path = F.concat(F.lit("js/"), F.translate("p_brand", "#", "_"), F.lit(".js"))
    rows = js_parts(part).join(part.select("p_partkey", path.alias("path")), "p_partkey").repartition(_wide(part), "path")
    joined = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "code"))).alias("_f"))
    return joined.select("path", F.array_join(F.transform("_f", lambda x: x["code"]), "\n").alias("content"))
