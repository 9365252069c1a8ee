"""One token language for simple Python, JavaScript and TypeScript functions, and its hash."""

from __future__ import annotations

import ast
from typing import Any

from codeweft.functions.jscanon import JsFunction, Token, renames
from codeweft.functions.pycanon import compact, sha256

#: Common names of keywords and operators.
JS_WORDS = {
    "const": "", "let": "", "var": "", "function": "FUNC", "null": "NULL", "undefined": "NULL", "this": "SELF",
}
JS_OPERATORS = {
    "+": "ADD", "-": "SUB", "*": "MULT", "/": "DIV", "%": "MOD", "**": "POW", "//": "FLOORDIV", "==": "EQ", "!=": "NOTEQ",
    "<": "LT", ">": "GT", "<=": "LTE", ">=": "GTE", "===": "EQ", "!==": "NOTEQ", "&&": "AND", "||": "OR", "!": "NOT",
    "+=": "ADD=", "-=": "SUB=", "=>": "ARROW",
}


class _Teller:
    """Tells a Python function as tokens. What the common language has no word for is left out."""

    def __init__(self, function: Any):
        self.names: dict[str, str] = {}
        self.out: list[str] = []
        for a in function.args.args:
            self.bind(a.arg)
        self.define("v_func", function)

    def bind(self, name: str) -> str:
        return self.names.setdefault(name, f"v{len(self.names)}")

    def say(self, *parts: Any) -> None:
        for p in parts:
            if isinstance(p, str):
                self.out.append(p)
            elif isinstance(p, list):
                self.say(*p)
            elif p is not None:
                tell = getattr(self, f"on_{type(p).__name__}", None)
                if tell:
                    tell(p)

    def block(self, body: list) -> None:
        self.say("{", body, "}")

    def define(self, name: str, f: Any) -> None:
        self.say("FUNC", name, "(", [self.bind(a.arg) for a in f.args.args], ")")
        self.block(f.body)

    def on_FunctionDef(self, f: Any) -> None:
        self.define(self.bind(f.name), f)

    on_AsyncFunctionDef = on_FunctionDef

    def on_Return(self, x: ast.Return) -> None:
        self.say("RETURN", x.value)

    def on_Assign(self, x: ast.Assign) -> None:
        for t in x.targets:
            if isinstance(t, ast.Name):
                self.bind(t.id)
            self.say(t)
        self.say("=", x.value)

    def on_AugAssign(self, x: ast.AugAssign) -> None:
        self.say(x.target, type(x.op).__name__.upper() + "=", x.value)

    def on_AnnAssign(self, x: ast.AnnAssign) -> None:
        self.say(x.target, ["=", x.value] if x.value else [])

    def on_Name(self, x: ast.Name) -> None:
        self.say(self.names.get(x.id, x.id))

    def on_Constant(self, x: ast.Constant) -> None:
        v = x.value
        self.say("STR" if isinstance(v, str) else "NUM" if isinstance(v, (int, float)) else "NULL" if v is None else "CONST")

    def on_BinOp(self, x: ast.BinOp) -> None:
        self.say(x.left, type(x.op).__name__.upper(), x.right)

    def on_UnaryOp(self, x: ast.UnaryOp) -> None:
        self.say(type(x.op).__name__.upper(), x.operand)

    def on_BoolOp(self, x: ast.BoolOp) -> None:
        for i, v in enumerate(x.values):
            self.say([type(x.op).__name__.upper()] if i else [], v)

    def on_Compare(self, x: ast.Compare) -> None:
        self.say(x.left)
        for op, y in zip(x.ops, x.comparators):
            self.say(type(op).__name__.upper(), y)

    def on_Call(self, x: ast.Call) -> None:
        self.say(x.func, "(", x.args, ")")

    def on_If(self, x: ast.If) -> None:
        self.say("IF", "(", x.test, ")")
        self.block(x.body)
        if x.orelse:
            self.say("ELSE")
            self.block(x.orelse)

    def on_While(self, x: ast.While) -> None:
        self.say("WHILE", "(", x.test, ")")
        self.block(x.body)

    def on_For(self, x: ast.For) -> None:
        self.say("FOR", "(", x.target, "IN", x.iter, ")")
        self.block(x.body)

    def on_Expr(self, x: ast.Expr) -> None:
        self.say(x.value)

    def on_Attribute(self, x: ast.Attribute) -> None:
        self.say(x.value, ".", x.attr)

    def on_Subscript(self, x: ast.Subscript) -> None:
        self.say(x.value, "[", x.slice, "]")

    def on_List(self, x: ast.List) -> None:
        self.say("[", x.elts, "]")

    def on_Tuple(self, x: ast.Tuple) -> None:
        self.say("(", x.elts, ")")

    def on_Dict(self, x: ast.Dict) -> None:
        self.say("{", [[k, ":", v] for k, v in zip(x.keys, x.values)], "}")

    def on_IfExp(self, x: ast.IfExp) -> None:
        self.say(x.body, "IF", x.test, "ELSE", x.orelse)

    def on_Pass(self, x: ast.AST) -> None:
        self.say(type(x).__name__.upper())

    on_Break = on_Continue = on_Pass

    def on_Raise(self, x: ast.Raise) -> None:
        self.say("THROW", x.exc)

    def on_Try(self, x: ast.Try) -> None:
        self.say("TRY")
        self.block(x.body)
        for h in x.handlers:
            self.say("CATCH")
            self.block(h.body)


def python_tokens(function: ast.FunctionDef | ast.AsyncFunctionDef) -> list[str]:
    return _Teller(function).out


def js_tokens(function: JsFunction) -> list[str]:
    names = renames(function.params, function.body, declared=True)
    out = ["FUNC", "v_func", "(", *(names[p] for p in function.params), ")"]
    body = function.body
    i = 0
    while i < len(body):
        t: Token = body[i]
        if t.text == ":" and t.kind == "PUNCT" and i + 1 < len(body) and body[i + 1].kind in ("WORD", "KW"):
            i += 2  # a type left over
            continue
        i += 1
        if t.kind == "KW":
            word = JS_WORDS.get(t.text, t.text.upper())
            out += [word] if word else []
        elif t.kind == "WORD":
            out.append(names.get(t.text, t.text))
        elif t.kind in ("STRING", "NUMBER"):
            out.append(t.kind[:3])
        elif t.kind in ("OP", "ARROW"):
            out.append(JS_OPERATORS.get(t.text, t.text))
        elif t.text != ";":
            out.append(t.text)
    return out


def universal_hash(tokens: list[str]) -> str:
    return sha256(compact({"universal_sir": " ".join(tokens)}, ascii_only=True))
