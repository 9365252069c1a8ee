"""Literal credentials in source text: where they begin, and the text with their values blanked out.

A text is scanned by context rules (names, headers, addresses, command lines, calls, remarks) and by the forms of well
known tokens. Literals that are base64, hex, percent- or backslash-encoded are decoded and scanned again, layer by layer
as long as anything decodes, for every layer is shorter than the one around it; binary results are read by the grammar
of key containers (DER and the OpenSSH container). A finding inside a decoded layer stands for the enclosing literal,
which is what gets blanked.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

class Finding(NamedTuple):
    start: int
    end: int
    kind: str


# --- names and values -------------------------------------------------------------------------------------------

#: Words that make a name secret, and last words that make it only talk about a secret.
SECRET_WORDS = set(
    "password passwd passwort passphrase pwd pass pw kennwort contrasena contraseña senha secret secrets token apikey "
    "bearer credential credentials motdepasse parola sifre wachtwoord".split()
)
KEY_OWNERS = set(
    "api secret signing sign enc encryption hmac service cert private access auth crypto master deploy session client "
    "account storage shared aes rsa ssh webhook root admin app license server encrypt cipher jwt".split()
)
HARMLESS_LAST = set(
    "count label hint field name id ids type kind url uri path file length len size ttl expiry regex rule policy prompt "
    "placeholder text title message msg error help env var index list limit min max info ref header param column col "
    "input form page link version status state required enabled visible hash format pattern validator reset".split()
)
PLACEHOLDER_WORDS = set(
    "password passwd pwd pass secret token key apikey example changeme change-me dummy placeholder none null nil undefined "
    "true false todo tbd xxx redacted masked hidden empty unset default user username login test string value".split()
)
_CAMEL = re.compile(r"[A-Z]+(?![a-zñ])|[A-Z]?[a-zñ]+|\d+")


def secret_name(name: str) -> bool:
    words = [w.lower() for w in _CAMEL.findall(name)]
    while words and words[-1].isdigit():
        words.pop()
    if not words or words[-1] in HARMLESS_LAST or words[0] in ("public", "pub", "no", "has", "is", "max", "min"):
        return False
    if any(w in SECRET_WORDS for w in words[-2:]):
        return True
    if words[-1] == "key" and len(words) > 1 and words[-2] in KEY_OWNERS:
        return True
    joined = "".join(words)
    return any(joined.endswith(w) for w in ("motdepasse", "passphrase", "apikey", "password", "passwort"))


_PLACEHOLDER = re.compile(
    r"""[<\[({].*[>\])}]|\$\{?.*|%\w*%|%[sdv]|\{\{.*|[*•.xX#_\-?]+|.*\*{3,}.*|.*\.{3,}.*|.*x{6,}.*|.*X{6,}.*
    |(?i:.*(?:your|replace|change|insert|enter|fill|put)[_\- ]?(?:me|this|your|here|it|in|api|the|own|password|token|secret|key).*)
    |(?i:.*(?:example|placeholder|redacted|dummy|changeit).*)|(?i:(?:process\.)?env[.(\[].*)|(?i:vault[:./].*)|@.*@|[A-Z][A-Z_]*""",
    re.X | re.S,
)
#: Words as people write them, alone, in camel case or joined; letters in a random order of cases aren't.
_WORD = r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]{2,})*|[A-Z]+)"
_WORDY = re.compile(rf"{_WORD}(?:[._/ :,]{_WORD})*[.:!?]?")
_SYMBOL = re.compile(r"[^A-Za-z\s]")


def placeholder(v: str) -> bool:
    return not v or v.lower().strip("<>[]{}()\"' ") in PLACEHOLDER_WORDS or bool(_PLACEHOLDER.fullmatch(v))


def looks_secret(v: str, least: int = 6, named: bool = False) -> bool:
    """A literal that can be a password or key: no sentence, name path, mask or reference."""
    if len(v) < least or placeholder(v) or any(c.isspace() for c in v):
        return False
    if _WORDY.fullmatch(v):
        # where a name says that this is the secret, inner capitals are enough
        return named and len(v) >= 8 and v.isalpha() and v[1:] != v[1:].lower() and v != v.upper()
    return bool(_SYMBOL.search(v)) or len(v) >= 8


_HEX = re.compile(r"[0-9a-fA-F]{16,}")


def looks_token(v: str) -> bool:
    """A machine-made value: long, and letters mixed with digits."""
    if len(v) < 16 or not looks_secret(v):
        return False
    digits, letters = sum(c.isdigit() for c in v), sum(c.isalpha() for c in v)
    return digits >= 2 and letters >= 4 and not re.search(r"[a-z]{4,}[-_][a-z]{4,}[-_]", v)


# --- key containers -----------------------------------------------------------------------------------------------


def _der(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the element at a place."""
    if at + 2 > len(data):
        return None
    tag, n = data[at], data[at + 1]
    at += 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4 or at + k > len(data):
            return None
        n = int.from_bytes(data[at : at + k], "big")
        at += k
    return (tag, at, at + n) if at + n <= len(data) else None


def private_container(data: bytes) -> str | None:
    """Kind of private key that a binary value holds: PKCS#1, PKCS#8 plain or encrypted, SEC 1, or OpenSSH."""
    if data.startswith(b"openssh-key-v1\0"):
        return "openssh"
    top = _der(data, 0)
    if not top or top[0] != 0x30 or top[2] < len(data) - 2:
        return None
    parts, at = [], top[1]
    while at < top[2] and len(parts) < 10:
        e = _der(data, at)
        if not e:
            return None
        parts.append((e[0], data[e[1] : e[2]]))
        at = e[2]
    tags = [t for t, _ in parts]
    if tags[:1] == [2] and len(parts[0][1]) == 1:
        if len(tags) >= 9 and all(t == 2 for t in tags[:9]):
            return "pkcs1"
        if tags[1:3] == [0x30, 4]:
            return "pkcs8"
        if tags[1:2] == [4] and parts[0][1] == b"\x01":
            return "sec1"
    if tags == [0x30, 4] and parts[0][1][:1] == b"\x06":
        # An algorithm and an octet string: encrypted PKCS#8 where the algorithm is of PKCS#5 or PKCS#12
        oid = parts[0][1]
        if oid[2:].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01\x05") or oid[2:].startswith(b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c"):
            return "pkcs8-encrypted"
    return None


# --- rules --------------------------------------------------------------------------------------------------------

_Q = r"""\\*["'`]"""
_STR = r"""(?P<q>\\*["'`])(?P<v>(?:(?!(?P=q)).)*?)(?P=q)"""
_PEM = re.compile(r"-----BEGIN (?P<what>[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----(?P<body>.*?)(?:-----END (?P=what)-----|[\"'`]|$)", re.S)
_JWT = re.compile(r"\beyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{4,}\.[A-Za-z0-9_\-]*")
#: Forms of widely used tokens.
_FORMS = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{40,}"
    r"|glpat-[A-Za-z0-9_\-]{20}|[sr]k_live_[A-Za-z0-9]{16,}|xox[abeoprs]-[0-9A-Za-z\-]{16,}|AIza[0-9A-Za-z_\-]{35}"
    r"|SG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}|npm_[A-Za-z0-9]{36}|hf_[A-Za-z0-9]{30,})"
)
_NAMED = re.compile(
    rf"""(?P<name>[A-Za-z_$][\w$\-ñ]*)(?:\\*["'`])?\s*\]?\s*(?::\s*[A-Za-z][\w<>\[\]?.]*\s*)?(?::=|=>|=(?!=)|:(?!:)|,(?=\s*\\*["'`]))\s*[bruf]?{_STR}""",
    re.X,
)
_NEXT = re.compile(r"""["'`](?P<v>[^"'`\n]*)["'`]""")
_JOIN = re.compile(r"""[ \t]*[+.]?[ \t]*\\?\r?\n[ \t]*[+.]?[ \t]*(?=["'`])|[ \t]*[+.][ \t]*(?=["'`])""")
_SCHEME = re.compile(r"\b(?P<s>Basic|Bearer|Token|ApiKey|Negotiate)\s+(?P<v>[A-Za-z0-9+/=_.\-~]{6,})")
_URL = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://(?P<u>[^\s:/@\"'`]*):(?P<v>[^\s\"'`/]+)@(?=[\w\[.\-])")
_URL_WIDE = re.compile(r"\b[a-zA-Z][a-zA-Z0-9+.\-]*://(?P<u>[^\s:/@\"'`]*):(?P<v>[^\s\"'`]+)@(?=[a-zA-Z][\w\-]*\.[\w.\-]+(?::\d+)?/)")
_QUERY = re.compile(
    r"[?&;](?:[\w\-]*(?:api_?key|token|secret|passw(?:or)?d|pwd|signature|credential)|key|sig|auth)=(?P<v>[^&\s\"'`;#]+)", re.I
)
_CONN = re.compile(r"(?:^|[;\"'`\s])(?:pwd|password)\s*=\s*(?P<v>[^;\"'`\s]+)(?=;|[\"'`])", re.I)
_FLAG = re.compile(r"--?(?:[a-z\-]*(?:token|api-?key|password|passwd|secret|pwd)|auth|pass)[= ](?P<v>[^\s\"'`]+)", re.I)
_CLI = re.compile(
    r"\b(?:PGPASSWORD|MYSQL_PWD|SSHPASS|REDISCLI_AUTH)=(?P<a>[^\s\"'`]+)|\bsshpass\s+-p\s*(?P<b>[^\s\"'`]+)"
    r"|\bmysql\w*\b[^\n\"'`]*?\s-p(?P<c>[^\s\"'`]+)|\b(?:curl|wget|http)\b[^\n\"'`]*?\s(?:-u|--user)[ =]?[^\s:\"'`]+:(?P<d>[^\s\"'`]+)"
)
_LOGIN = re.compile(
    rf"""\b(?:auth\w*|log_?in|log_?on|sign_?in|connect\w*|bind\w*|set_?credentials|basic_?auth|open_?session)\s*\(\s*["'`](?P<u>[^"'`\n]+)["'`]\s*,\s*{_STR}""",
    re.I | re.X,
)
_CRYPTO = re.compile(
    rf"""[.>]\s*(?:sign|hmac|seal|unseal|unlock|decrypt|encrypt|cipher|decipher|authenticate|auth|open_?vault|digest_?with_?key|verify_?with_?key|set_?key|derive_?key|unwrap|login|hmac_?sha\d+|sign_?with\w*)\s*\(\s*[\w$.\[\]]+\s*,\s*{_STR}\s*[,)]""",
    re.I | re.X,
)
_ENV_LINE = re.compile(r"^[ \t]*(?:export[ \t]+|//[ \t]*|\#[ \t]*|\*[ \t]*)?(?P<name>[A-Z][A-Z0-9_]*)=(?P<v>[^\s\"'`;]+)[ \t]*\r?$", re.M)
_SETTING = re.compile(
    r"^[ \t]*(?://+|\#+|\*|--|;|/\*+)?[ \t]*(?P<name>[A-Za-zñç][\w\- ñç]{1,30}?)[ \t]*[:=][ \t]*(?P<v>[^\s,;]+)(?P<tail>[^\n]*)$", re.M
)
_COMMENT = re.compile(r"(?://+|/\*+|(?:^|\s)\#+|^\s*\*|<!--|(?:^|\s)--\s)(?P<t>[^\n]*)", re.M)
_REMARK = re.compile(
    r"(?:\b(?:pass(?:word|wd|phrase|wort)?|pwd|pw|kennwort|contrase(?:ñ|n)a|mot de passe|secret|(?:api[ _-]?|access[ _-]?|secret[ _-]?)?(?:key|token)|credentials?)"
    r"(?:\s+(?:still|is|was|for\s+\w+\s+is|now|remains|stays))?\s*[:=]?\s+|\b(?:used to be|formerly|previously)\s+)(?P<v>[^\s,;]+)",
    re.I,
)
_PAIR = re.compile(
    r"\b(?:log[ -]?in|account|access|credentials?|creds|sign[ -]?in|user)\b[^:\n]{0,40}:\s*(?P<u>[\w.@\-]+)\s*(?:/|:|\|)\s*(?P<v>[^\s,;]+)", re.I
)
#: The shortest encoded text: eight bytes, the least that a decoded layer is scanned from.
_RUN = re.compile(r"[A-Za-z0-9+/_\-]{11,}={0,2}")
#: Parts of an encoded literal that is written over several lines or put together from several literals.
_GLUE = r"""(?:\\*["'`](?:[ \t]*[+.]?[ \t]*\\?\r?\n[ \t]*[+.]?[ \t]*|[ \t]*[+.][ \t]*|[ \t]+)\\*["'`]|(?:\\[rn]|\\?\r?\n[ \t]*)+)"""
_CHAIN = re.compile(rf"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]++(?:{_GLUE}[A-Za-z0-9+/_\-]++)+={{0,2}}")
_GLUED = re.compile(_GLUE)
#: First characters of hex, and of base64 whose first byte begins a printable text or a key container.
_FIRST = frozenset("ABCDEFIJKLMNOPQRSTUVWXYZabcdefwxyz0123456789")
#: Backslash and percent codes, and what can enclose them: a quoted literal, or a run without blanks and quotes.
_ESCAPE = re.compile(r"\\+(?:x([0-9a-fA-F]{2})|u([0-9a-fA-F]{4})|u\{([0-9a-fA-F]{1,5})\}|([0-3][0-7]{2}))")
_PERCENT = re.compile(r"%[0-9a-fA-F]{2}")
#: A percent sign that is encoded once or many times and begins a code.
_PERCENTS = re.compile(r"%(?:25)+(?=[0-9a-fA-F]{2})")
_LITERALS = (re.compile(r"""(?P<q>["'`])(?P<v>(?:(?!(?P=q))(?:\\.|[^\\\n]))*)(?P=q)""", re.S), re.compile(r"""(?P<v>[^\s"'`]+)"""))
#: Word parts without which a group of rules can't apply, so that most texts are passed over quickly.
_TALK = re.compile(r"pass|pwd|pw|kennwort|contrase|secret|token|key|bearer|credential|senha|parola|sifre|wachtwoord|used to be|formerly|previously").search
_ACCOUNT = re.compile(r"log[ -]?in|account|access|cred|sign[ -]?in|user").search
_CALLS = re.compile(r"(?:auth\w*|log_?in|log_?on|sign_?in|connect\w*|bind\w*|credentials|session)\s*\(\s*[\"'`]").search
_USER = re.compile(r"[A-Za-z][\w.@\-]{1,40}")


def _printable(data: bytes) -> str | None:
    try:
        s = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    return s if s and sum(c.isprintable() or c in "\r\n\t" for c in s) == len(s) else None


def _decodings(run: str) -> Iterator[bytes]:
    if _HEX.fullmatch(run) and len(run) % 2 == 0:
        yield bytes.fromhex(run)
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 != 1:
        try:
            yield base64.b64decode(body + "=" * (-len(body) % 4))
        except (binascii.Error, ValueError):
            pass


def _runs(text: str) -> Iterator[tuple[int, int, str]]:
    """Start, end and value of runs that can be encoded, alone and joined; a name may stand before or behind joined ones."""
    for m in _RUN.finditer(text):
        if text[m.start()] in _FIRST:
            yield m.start(), m.end(), m.group()
    for m in _CHAIN.finditer(text):
        if m.end() - m.start() < 12:
            continue
        links, at = [], m.start()
        for g in _GLUED.finditer(text, m.start(), m.end()):
            links.append((at, g.start()))
            at = g.end()
        links.append((at, m.end()))
        for part in (links, links[1:], links[:-1], links[1:-1]):
            if len(part) > 1 and text[part[0][0]] in _FIRST:
                yield part[0][0], part[-1][1], "".join(text[a:z] for a, z in part)


def _unescaped(text: str) -> str:
    """Backslash codes decoded, again and again until none is left."""
    while True:
        new = _ESCAPE.sub(lambda m: chr(int(m.group(4), 8) if m.group(4) else int(m.group(1) or m.group(2) or m.group(3), 16)), text)
        if new == text:
            return text
        text = new


def _unquoted(text: str) -> str:
    """Percent codes decoded, again and again until none is left; codes of no UTF-8 text stay."""
    while _PERCENT.search(text):
        try:
            new = unquote(_PERCENTS.sub("%", text), errors="strict")
        except UnicodeDecodeError:
            return text
        if new == text:
            return text
        text = new
    return text


def _nested(text: str, seen: set[str]) -> Iterator[Finding]:
    """Encoded literals whose decoded layer holds a credential. seen: layers that were scanned before, each once."""

    def holds(inner: str | None) -> bool:
        if not inner or len(inner) < 8 or inner in seen:
            return False
        seen.add(inner)
        return any(True for _ in scan(inner, seen))

    signed = [m.span() for m in _JWT.finditer(text)] if "eyJ" in text else []
    for start, end, run in _runs(text):
        if any(a < end and start < z for a, z in signed):
            continue
        for data in _decodings(run):
            if kind := private_container(data):
                yield Finding(start, end, f"container:{kind}")
                break
            if holds(_printable(data)):
                yield Finding(start, end, "encoded")
                break
    for code, decode in ((_ESCAPE, _unescaped), (_PERCENT, _unquoted)):
        if not code.search(text):
            continue
        for m in (m for rx in _LITERALS for m in rx.finditer(text)):
            if code.search(m.group("v")):
                inner = decode(m.group("v"))
                if inner != m.group("v") and holds(_printable(inner.encode("utf-8", "replace"))):
                    yield Finding(m.start("v"), m.end("v"), "encoded")


def _joined(text: str, m: re.Match) -> tuple[str, int]:
    """A literal with those it is concatenated with, and where the last one ends."""
    value, end = m.group("v"), m.end("v")
    at = end + len(m.group("q"))
    while (j := _JOIN.match(text, at)) and (n := _NEXT.match(text, j.end())) and n.start("v") == j.end() + 1:
        value, end, at = value + n.group("v"), n.end("v"), n.end()
    return value, end


def scan(text: str, seen: set[str] | None = None) -> Iterator[Finding]:
    """Credentials of a text, in no order; one may be found by several rules. seen: given for a decoded layer."""
    low = text.lower()
    talk = _TALK(low)
    if "PRIVATE KEY" in text:
        for m in _PEM.finditer(text):
            body = re.sub(r"\\n|\\r|[\s\"'+.]", "", m.group("body"))
            if len(re.sub(r"[^A-Za-z0-9+/=]", "", body)) >= 32 and "..." not in m.group("body"):
                end = m.end("body")
                # what the armour says is read by its grammar where it decodes; a damaged or made-up body is still a key block
                inner = next((k for d in _decodings(re.sub(r"[^A-Za-z0-9+/=]", "", body)) if (k := private_container(d))), None)
                yield Finding(m.start(), max(end, m.end() if m.group(0).endswith("-----") else end), f"private key:{inner}" if inner else "private key")
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            if m.group().split(".")[2]:
                yield Finding(m.start(), m.end(), "jwt")
    for m in _FORMS.finditer(text):
        if len(set(m.group()[4:])) > 4 and "EXAMPLE" not in m.group().upper():
            yield Finding(m.start(), m.end(), "token form")
    if " " in text and ("basic " in low or "bearer " in low or "token " in low or "apikey " in low):
        for m in _SCHEME.finditer(text):
            v = m.group("v")
            if m.group("s") == "Basic":
                inner = next((s for d in _decodings(v) if (s := _printable(d))), "")
                user, colon, word = inner.partition(":")
                if colon and user and not placeholder(word):
                    yield Finding(m.start("v"), m.end("v"), "basic login")
            elif looks_token(v) or (len(v) >= 12 and any(c.isdigit() for c in v) and looks_secret(v)):
                yield Finding(m.start("v"), m.end("v"), "header token")
    if "://" in text and "@" in text:
        for rx in (_URL, _URL_WIDE):
            for m in rx.finditer(text):
                v = m.group("v")
                if not placeholder(v) and not any(c in v for c in "{}<>") and not m.group("u").startswith(("<", "{", "$")):
                    yield Finding(m.start("v"), m.end("v"), "address login")
    if "=" in text and ("?" in text or "&" in text):
        for m in _QUERY.finditer(text):
            v = unquote(m.group("v"))
            if looks_secret(v, 8) and any(c.isdigit() for c in v):
                yield Finding(m.start("v"), m.end("v"), "query key")
    if " -" in text or talk:
        for m in _CLI.finditer(text):
            g = m.lastgroup
            if not placeholder(m.group(g)) and not m.group(g).startswith("$"):
                yield Finding(m.start(g), m.end(g), "command line")
        for m in _FLAG.finditer(text):
            if looks_secret(m.group("v")):
                yield Finding(m.start("v"), m.end("v"), "option")
    if _CALLS(low):
        for m in _LOGIN.finditer(text):
            if looks_secret(m.group("v")) and not m.group("u").count(" "):
                yield Finding(m.start("v"), m.end("v"), "login call")
    for m in _CRYPTO.finditer(text):
        if looks_secret(m.group("v")):
            yield Finding(m.start("v"), m.end("v"), "key argument")
    if talk:
        yield from _by_name(text)
    comments = list(_COMMENT.finditer(text)) if talk or _ACCOUNT(low) else ()
    for c in comments:
        at, said = c.start("t"), c.group("t")
        for m in _REMARK.finditer(said):
            v = m.group("v").rstrip(".)")
            if looks_secret(v) and (looks_token(v) or any(x.isdigit() for x in v) or re.search(r"[^\w\-./:]", v) or v.isalpha()):
                yield Finding(at + m.start("v"), at + m.start("v") + len(v), "remark")
        for m in _PAIR.finditer(said):
            if looks_secret(m.group("v")):
                yield Finding(at + m.start("v"), at + m.end("v"), "login remark")
    if seen is not None and re.fullmatch(r"[\w.\-]+:\S{6,}", text):
        user, _, word = text.partition(":")
        if _USER.fullmatch(user) and looks_secret(word):
            yield Finding(0, len(text), "decoded login")
    yield from _nested(text, set() if seen is None else seen)


def _by_name(text: str) -> Iterator[Finding]:
    """Values given to a name that says they are secret: literals, connection strings, settings, environment lines."""
    for m in _NAMED.finditer(text):
        if not secret_name(m.group("name")):
            continue
        value, end = _joined(text, m)
        bare = value.removeprefix("Bearer ").removeprefix("Basic ")
        joined = m.group("v") != value and re.fullmatch(r"[\w+/=.\-]{12,}", value)  # nobody puts a placeholder together
        if joined or looks_secret(bare, 4, True):
            yield Finding(m.start("v"), end, "named literal")
    for m in _CONN.finditer(text):
        if not placeholder(m.group("v")):
            yield Finding(m.start("v"), m.end("v"), "connection string")
    for m in _ENV_LINE.finditer(text):
        if secret_name(m.group("name")) and looks_secret(m.group("v"), 4, True):
            yield Finding(m.start("v"), m.end("v"), "environment line")
    for m in _SETTING.finditer(text):
        v, tail = m.group("v"), m.group("tail").strip()
        if v[:1] in "\"'`([{<$":
            continue
        line = m.group(0).lstrip()
        remark = line.startswith(("//", "#", "*", "--", "/*"))
        if not remark and (
            line.rstrip().endswith((";", ",", "{", "("))
            or "(" in v
            or re.fullmatch(r"[A-Za-z_$][\w$]*(\.[\w$()]+)+", v)
            or "=" in line[: line.index(v)]
            or tail
        ):
            continue  # code, not a setting
        if tail and not (tail.startswith("(") or re.match(r"(?:until|on|for|but|till|bis|jusqu|,)", tail)):
            continue
        name = m.group("name")
        if secret_name(name.replace(" ", "_")) or name.lower().replace(" ", "") in SECRET_WORDS:
            if looks_secret(v, 4, remark):
                yield Finding(m.start("v"), m.end("v"), "setting")


def findings(text: str | None) -> list[Finding]:
    """Non-overlapping findings in order of place; of overlapping ones, all that they cover counts as one. An enclosing
    literal counts for what only its decoded layer shows: where it holds a finding of its own, that one stands."""
    found = sorted(scan(text)) if text else []
    plain = [f for f in found if f.kind != "encoded"]
    found = [f for f in found if f.kind != "encoded" or not any(f.start <= p.start and p.end <= f.end for p in plain)]
    out: list[Finding] = []
    for f in found:
        if out and f.start < out[-1].end:
            out[-1] = out[-1]._replace(end=max(out[-1].end, f.end))
        else:
            out.append(f)
    return out


def line_of(text: str, places: list[int]) -> list[int]:
    feeds = [m.start() for m in re.finditer("\n", text)]
    return [bisect.bisect_left(feeds, p) + 1 for p in places]


def blank(text: str, found: list[Finding]) -> str:
    """The text with every value replaced by asterisks, keeping quotes, line ends, key markers and length."""
    out, at = [], 0
    for f in found:
        value = text[f.start : f.end]
        out.append(text[at : f.start])
        keep = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]+-----|\\[nr]|[\r\n]|[\"'`]\s*[+.]?\s*\\?\s*[+.]?\s*[\"'`]")
        pos = 0
        for m in keep.finditer(value):
            out.append("*" * (m.start() - pos) + m.group())
            pos = m.end()
        out.append("*" * (len(value) - pos))
        at = f.end
    return "".join(out) + text[at:]


def find_credentials(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, line_no int, kind): one row for each line of a row on which a credential begins.

    Lines are counted from 1 at line feeds. Null and empty texts give nothing; repeated rows count once. Texts of any
    length are scanned whole. Columns besides the two named are ignored.
    """
    kind = dict(df.dtypes)[row_id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, lines, kinds = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                found = findings(t)
                if found:
                    seen = set()
                    for f, n in zip(found, line_of(t, [f.start for f in found])):
                        if n not in seen:
                            seen.add(n)
                            rows.append(i)
                            lines.append(n)
                            kinds.append(f.kind)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(rows, pa.int64())), pa.array(lines, pa.int32()), pa.array(kinds, pa.string())],
                names=["k", "line_no", "kind"],
            )

    found = df.select(F.col(row_id).alias("k"), F.col(text).alias("t")).filter("t is not null")
    found = found.mapInArrow(run, f"k {kind}, line_no int, kind string")
    return found.groupBy("k", "line_no").agg(F.min("kind").alias("kind")).withColumnRenamed("k", row_id)


def scan_table(df: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, text redacted, found array<struct<line_no int, kind string>>) of every row, from one pass over the texts.

    Null and empty texts stay as they are and have no findings; repeated rows stay.
    """
    kind = dict(df.dtypes)[row_id]
    told = pa.list_(pa.struct([("line_no", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, lines = [], []
            for t in b.column(1).to_pylist():
                found = findings(t)
                texts.append(blank(t, found) if found else t)
                lines.append([{"line_no": n, "kind": f.kind} for f, n in zip(found, line_of(t, [f.start for f in found]))] if found else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(lines, told)], names=["k", "t", "found"])

    out = df.select(F.col(row_id).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, t string, found array<struct<line_no int, kind string>>")
    return out.select(F.col("k").alias(row_id), F.col("t").alias(text), "found")


def redact(df: DataFrame, text: str) -> DataFrame:
    """df with the values of all credentials in one text column blanked out; every other character stays in place.

    Null and empty texts stay as they are; rows, other columns and their order in a row are kept.
    """

    @F.pandas_udf("string")
    def cover(s):  # type: ignore[no-untyped-def]
        return s.map(lambda t: t if not t else blank(t, findings(t)))

    return df.withColumn(text, cover(F.col(text)))
