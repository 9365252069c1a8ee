"""JavaScript and TypeScript: lexing, erasing types, finding functions, name-independent hashes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

from codeweft.functions.pycanon import compact, sha256

#: The words that are never renamed.
KEYWORDS = set(
    "function return const let var async await if else for while do switch case break continue new this class extends "
    "import export default try catch finally throw typeof instanceof in of true false null undefined void delete static "
    "get set yield from as super interface type enum namespace declare abstract implements readonly keyof infer never unknown".split()
)


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    at: int = 0


class JsFunction(NamedTuple):
    name: str
    line: int
    params: list[str]
    body: list[Token]


_LEXER = re.compile(
    r"(?P<skip>[ \t\r\n]+|//[^\n]*|/\*(?:(?!\*/).)*\*/)"
    r"|(?P<STRING>(?P<q>[\"'`])(?:\\.|(?!(?P=q))[^\\])*(?P=q))|(?P<NUMBER>\d+(?:\.\d+)?)|(?P<ARROW>=>)"
    r"|(?P<PUNCT>[][{}();,.:])|(?P<OP>[-+*/%=!<>&|^~?]+)|(?P<WORD>[A-Za-z_$][\w$]*)|(?P<AT>@)",
    re.S | re.A,
)


def lex(source: str, keep_at: bool = False) -> list[Token]:
    """Tokens with their lines; spaces, remarks and characters of no token are left out."""
    return list(tokens_of(source, keep_at))


def tokens_of(source: str, keep_at: bool = False) -> Iterator[Token]:
    """The tokens of lex, one by one; equal texts are one object, and so are the lines of neighbours, as files may be large."""
    line, at, texts = 1, 0, {}
    for m in _LEXER.finditer(source):
        kind = m.lastgroup if m.lastgroup != "q" else "STRING"
        if m.group("STRING") is not None:
            kind = "STRING"
        if n := source.count("\n", at, m.start()):
            line += n
        at = m.start()
        if kind == "skip" or (kind == "AT" and not keep_at):
            continue
        text = m.group()
        yield Token("KW" if kind == "WORD" and text in KEYWORDS else kind, texts.setdefault(text, text), line, at)


def closing(tokens: list[Token], at: int) -> int:
    """The token that closes the bracket at a place; the last token where none does."""
    pair = {"(": ")", "{": "}", "[": "]"}[tokens[at].text]
    depth = 0
    for i in range(at, len(tokens)):
        if tokens[i].kind == "PUNCT":
            if tokens[i].text == tokens[at].text:
                depth += 1
            elif tokens[i].text == pair:
                depth -= 1
                if not depth:
                    return i
    return len(tokens) - 1


# --- TypeScript -------------------------------------------------------------------------------------------------

_TYPE_OPS = {"|", "&", "<", ">", ">>", ">>>", "?", "|=", "[", "]", ".", ","}
_GENERIC = {",", "|", "&", "[", "]", ".", "=", "?"}
_MODIFIERS = {"public", "private", "protected", "readonly"}


def _type_end(tokens: list[Token], at: int) -> int:
    """Where a run of type tokens ends."""
    while at < len(tokens):
        t = tokens[at]
        if t.kind in ("WORD", "KW", "NUMBER") or t.text in ("|", "&", "<", ">", ">>", "[", "]", ".", ",", "?"):
            at += 1
        else:
            break
    return at


def _is(tokens: list[Token], at: int, *texts: str) -> bool:
    return at < len(tokens) and tokens[at].text in texts


def erase_types(tokens: list[Token]) -> list[Token]:
    """Leaves out decorators, interfaces, type aliases, generics, return and parameter types, modifiers, casts and non-null marks.

    A type of a local declaration stays, for only a comma or a closing parenthesis ends a parameter's type.
    """
    out: list[Token] = []
    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i]
        if t.kind == "AT":
            i += 2
            if _is(tokens, i, "("):
                i = closing(tokens, i) + 1
        elif t.text == "interface" and i + 2 < n and tokens[i + 1].kind == "WORD" and _is(tokens, i + 2, "{"):
            while i < n and tokens[i].text != "}":
                i += 1
            i += 1
        elif t.text == "type" and i + 2 < n and tokens[i + 1].kind == "WORD" and _is(tokens, i + 2, "="):
            while i < n and tokens[i].text != ";":
                i += 1
            i += 1
        elif t.text == "<" and (end := _generic_end(tokens, i)):
            i = end
        elif t.text == ")" and _is(tokens, i + 1, ":") and (end := _type_end(tokens, i + 2)) > i + 2 and _is(tokens, end, "{", "=", "=>"):
            out.append(t)
            i = end
        elif t.text == ":" and out and (out[-1].kind in ("WORD", "KW") or out[-1].text == "?") and (end := _parameter_end(tokens, i)):
            if out[-1].text == "?":
                out.pop()
            i = end
        elif t.text in _MODIFIERS or t.text == "abstract":
            i += 1
        elif t.text == "!" and out and out[-1].kind in ("WORD", "KW") and out[-1].at + len(out[-1].text) == t.at and (_is(tokens, i + 1, ".", ",", ")", ";") or (i + 1 < n and tokens[i + 1].at > t.at + 1)):
            i += 1
        elif t.text == "as" and i + 1 < n and tokens[i + 1].kind in ("WORD", "KW"):
            i = _type_end(tokens, i + 1)
        else:
            out.append(t)
            i += 1
    return out


def _generic_end(tokens: list[Token], at: int) -> int:
    """Behind the closing bracket of type arguments, or 0 if these tokens can't be any."""
    depth = 0
    for i in range(at, len(tokens)):
        t = tokens[i]
        if t.kind == "OP" and set(t.text) <= {"<", ">"}:
            depth += t.text.count("<") - t.text.count(">")
            if depth <= 0:
                return i + 1 if i > at + 1 else 0
        elif not (t.kind in ("WORD", "KW", "STRING") or t.text in _GENERIC):
            return 0
    return 0


def _parameter_end(tokens: list[Token], at: int) -> int:
    """Where the type behind a colon ends if a comma or parenthesis follows, or 0."""
    i = at + 1
    depth = 0
    while i < len(tokens):
        t = tokens[i]
        if t.text == "," and depth == 0 or t.text == ")":
            return i if i > at + 1 else 0
        if t.kind == "OP" and set(t.text) <= {"<", ">"}:
            depth += t.text.count("<") - t.text.count(">")
        elif not (t.kind in ("WORD", "KW", "NUMBER") or t.text in ("|", "&", "[", "]", ".", "?", ",")):
            return 0
        i += 1
    return 0


# --- functions --------------------------------------------------------------------------------------------------


def _expression_end(tokens: list[Token], at: int) -> int:
    """Where an arrow function's expression ends: at a semicolon or a bracket that closes something outside it."""
    depth = 0
    while at < len(tokens):
        text = tokens[at].text
        if text in ("(", "[", "{"):
            depth += 1
        elif text in (")", "]", "}"):
            if not depth:
                break
            depth -= 1
        elif text == ";" and not depth:
            break
        at += 1
    return at


def _words(tokens: list[Token]) -> list[str]:
    return [t.text for t in tokens if t.kind == "WORD"]


def _arrow(tokens: list[Token], at: int, name: str, line: int) -> tuple[JsFunction, int] | None:
    """An arrow function whose parameters start at a place, and where to go on."""
    if _is(tokens, at, "(") and tokens[at].kind == "PUNCT":
        close = closing(tokens, at)
        params, at = _words(tokens[at + 1 : close]), close + 1
        block = True
    elif at < len(tokens) and tokens[at].kind == "WORD":
        params, at, block = [tokens[at].text], at + 1, False
    else:
        return None
    if not (at < len(tokens) and tokens[at].kind == "ARROW"):
        return None
    at += 1
    if block and _is(tokens, at, "{"):
        end = closing(tokens, at)
        return JsFunction(name, line, params, tokens[at : end + 1]), end + 1
    end = _expression_end(tokens, at)
    body = [Token("PUNCT", "{", line), *tokens[at:end], Token("PUNCT", "}", line)]
    return JsFunction(name, line, params, body), end + 1


def functions(source: str, typescript: bool = False) -> list[JsFunction]:
    """Function declarations and arrow functions bound by const, let or var, outermost only.

    Expression bodies of arrows are put in braces. Methods and generators are not found.
    """
    tokens = erase_types(lex(source, keep_at=True)) if typescript else lex(source)
    out: list[JsFunction] = []
    i, n = 0, len(tokens)
    while i < n:
        t = tokens[i]
        at = i + 1 if t.text == "async" and t.kind == "KW" and i + 1 < n else i
        found = None
        if tokens[at].kind == "KW" and tokens[at].text == "function":
            j, name = at + 1, "anonymous"
            if j < n and tokens[j].kind == "WORD":
                name, j = tokens[j].text, j + 1
            if _is(tokens, j, "("):
                close = closing(tokens, j)
                if _is(tokens, close + 1, "{"):
                    end = closing(tokens, close + 1)
                    found = JsFunction(name, tokens[at].line, _words(tokens[j + 1 : close]), tokens[close + 1 : end + 1]), end + 1
        elif t.kind == "KW" and t.text in ("const", "let", "var") and i + 2 < n and tokens[i + 1].kind == "WORD" and tokens[i + 2].text == "=":
            j = i + 3
            asynchronous = j < n and tokens[j].text == "async"
            found = _arrow(tokens, j + asynchronous, tokens[i + 1].text, t.line)
        if found:
            out.append(found[0])
            i = found[1]
        else:
            i += 1
    return out


def renames(params: list[str], body: list[Token], declared: bool = False) -> dict[str, str]:
    """New names of the parameters and of the words that are assigned; with declared also of those that are declared."""
    found: dict[str, str] = {}
    for p in params:
        found.setdefault(p, f"v{len(found)}")
    for a, b in zip(body, [*body[1:], Token("", "", 0)]):
        if a.kind == "WORD" and b.kind == "OP" and b.text == "=":
            found.setdefault(a.text, f"v{len(found)}")
        if declared and a.kind == "KW" and a.text in ("const", "let", "var") and b.kind == "WORD":
            found.setdefault(b.text, f"v{len(found)}")
    return found


def source_of(tokens: list[Token]) -> str:
    return " ".join(t.text for t in tokens)


def canonical_body(params: list[str], body: list[Token]) -> str:
    names = renames(params, body)
    swap = {"STRING": "STR", "NUMBER": "NUM"}
    return " ".join(names.get(t.text, t.text) if t.kind == "WORD" else swap.get(t.kind, t.text) for t in body)


def js_hash(params: list[str], body: list[Token]) -> str:
    """Hash of a function without its name, its literals and the names it binds."""
    node = {"type": "JSFunction", "params": [f"v{i}" for i in range(len(params))], "body": canonical_body(params, body), "lang": "javascript"}
    root = sha256(compact(node, ascii_only=True))
    return sha256(compact({"root": root, "nodes": {root: node}}, ascii_only=True))


def js_hash_of_text(params: list[str], body: str) -> str:
    return js_hash(params, lex(body))
