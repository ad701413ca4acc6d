"""Secrets in texts: fixed credential shapes, and literals that source or configuration syntax gives a sensitive name.

The lexer reads lines that hold an assignment sign: names, quoted strings, bare values, operators. A parser turns them
into name-literal pairs: ``name = "x"``, ``name: type = "x"``, ``"name": "x"``, ``name := x``, ``"name" => "x"``,
``cfg["name"] = "x"``, keyword arguments, and sums of literals. A name assigned a literal is a constant of its text; a
later assignment of that name to another target gives the literal this target's name too. Each pair is scored by the
words of the target name and by how much the literal looks like a made-up value; pairs of ``THRESHOLD`` or more are
spans of kind ``literal``. Shapes are reported whatever the lexer finds.

Defined cases: null and empty text have no spans. Spans count code points, the end exclusive. Equal spans of one kind are
reported once. Rows are independent of each other: repeated ids, extra columns, empty tables pass through.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame

from skeinlog.llm.shared import sliced

#: Fixed patterns of the three shapes, in the order in which spans of equal start are listed. A shape must reach its
#: least length: of group 2 for an assignment, else of the match.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # runs of 32 and more: a shorter run is dropped, and no run starts inside another
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ["assign", "access", "hex", "literal"]

#: What each word of a target name adds to its sensitivity, up to 1.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.6, "secret": 1.0, "credential": 0.9,
    "credentials": 0.9, "token": 0.8, "apikey": 1.0, "bearer": 0.8, "auth": 0.6, "authorization": 0.8, "private": 0.5,
    "key": 0.4, "api": 0.3, "access": 0.3, "signing": 0.3, "encryption": 0.3, "salt": 0.4, "session": 0.2, "client": 0.1,
}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|<.*>|\$\{.*\}|\$\w+|%\w+%|\{\{.*\}\}|null|none|true|false|undefined|change_?me|your.*|example.*|placeholder|todo)$")
THRESHOLD = 0.5

TOKEN = re.compile(r"""
    (?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)
  | (?P<op>:=|=>|==|!=|<=|>=|[=:])
  | (?P<name>[A-Za-z_]\w*(?:[.\-]\w+)*)
  | (?P<plus>[+]|\.\.)
  | (?P<mark>[^\s\w])
  | (?P<number>\d\w*)
""", re.X)
BARE = re.compile(r"""[ \t]*([^\s"'`#,;(){}\[\]]+)""")
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
SIGN = re.compile(r"[:=]")


def name_score(name: str) -> float:
    return min(1.0, sum(SENSITIVE.get(w.lower(), 0.0) for w in WORDS.findall(name)))


def literal_score(value: str) -> float:
    """Long, of one piece and of mixed characters: likely made up."""
    if not value or PLACEHOLDER.match(value):
        return 0.0
    n = len(value)
    bits = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    return min(1.0, n / 8) * min(1.0, bits / 2.5) * (0.3 if re.search(r"\s", value) else 1.0)


def lines(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of each line that holds an assignment sign."""
    at = 0
    while sign := SIGN.search(text, at):
        start = text.rfind("\n", 0, sign.start()) + 1
        at = text.find("\n", sign.end())
        at = len(text) if at < 0 else at
        yield start, at


def pairs(text: str, spans: list[tuple[int, int]] | None = None) -> Iterator[tuple[str, int, int]]:
    """(target name, start, end) of every literal that is assigned to a name, directly or through constants."""
    constants: dict[str, list[tuple[int, int]]] = {}
    for start, end in lines(text) if spans is None else spans:
        at, name, annotated, closes = start, None, None, False
        while token := TOKEN.search(text, at, end):
            at, kind, word = token.end(), token.lastgroup, token.group()
            if kind in ("name", "string"):
                name, closes = (word if kind == "name" else word[1:-1]), False
            elif kind == "op" and word in ("=", ":", ":=", "=>") and name:
                target = annotated if annotated and word == "=" else name
                found, at, reference = _value(text, at, end, constants)
                if found:
                    constants[target.rpartition(".")[2]] = found
                    for a, b in found:
                        yield target, a, b
                annotated, name = (name if word == ":" and reference else None), reference
            elif kind == "mark" and word == "]" and name and not closes:
                closes = True  # cfg["name"] = ...: the key stays the target
            else:
                name = annotated = None


def _value(text: str, at: int, end: int, constants: dict) -> tuple[list[tuple[int, int]], int, str | None]:
    """Literals of the expression at ``at``, where it ends, and the name it was, if it was one without a value."""
    found: list[tuple[int, int]] = []
    while token := TOKEN.match(text, _blank(text, at, end), end):
        kind = token.lastgroup
        if kind == "string":
            found.append((token.start() + 1, token.end() - 1))
            at = token.end()
        elif kind == "name" and (known := constants.get(token.group().rpartition(".")[2])):
            found += known
            at = token.end()
        elif kind in ("name", "number", "mark") and not found:
            bare = BARE.match(text, at, end)
            if bare is None:
                return [], at, None
            follows = TOKEN.match(text, _blank(text, token.end(), end), end)
            if kind == "name" and follows and (follows.lastgroup == "op" or follows.group() in "([" and follows.start() == token.end()):
                return [], token.end(), token.group()  # a type, a call or the next pair's name
            return [(bare.start(1), bare.end(1))], bare.end(), None
        else:
            break
        plus = TOKEN.match(text, _blank(text, at, end), end)
        if not plus or plus.lastgroup != "plus":
            break
        at = plus.end()
    return found, at, None


def _blank(text: str, at: int, end: int) -> int:
    while at < end and text[at] in " \t":
        at += 1
    return at


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end), by start, then kind as listed, then end."""
    text = text or ""
    found = {("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]}
    found |= {("hex", m.start(), m.end()) for m in HEX.finditer(text)}
    signed = list(lines(text))
    for start, end in signed:  # no assignment crosses a line
        found |= {("assign", m.start(), m.end()) for m in ASSIGN.finditer(text, start, end) if len(m.group(2)) >= LEAST["assign"]}
    for name, start, end in pairs(text, signed):
        worth = name_score(name)
        if worth >= THRESHOLD and worth * literal_score(text[start:end]) >= THRESHOLD:
            found.add(("literal", start, end))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _digest(text: str | None) -> dict:
    spans = scan(text)
    count = Counter(k for k, _, _ in spans)
    shown = lambda some: ",".join(f"{k}:{a}:{b}" for k, a, b in some)
    base = shown(s for s in spans if s[0] != "literal")
    return {"n_assign": count["assign"], "n_access": count["access"], "n_hex": count["hex"],
            "base_sha256": sha256(base.encode()).hexdigest(), "spans": shown(spans)}


def digests(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of spans of each shape, the hash of their list, and all spans as text."""
    names = {"n_assign": pa.int64(), "n_access": pa.int64(), "n_hex": pa.int64(), "base_sha256": pa.string(), "spans": pa.string()}

    def run(batches):
        for batch in sliced(batches):
            rows = [_digest(t) for t in batch.column("text").to_pylist()]
            new = [pa.array([r[n] for r in rows], kind) for n, kind in names.items()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *new], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every run of overlapping spans replaced; null stays null."""
    out, at = [], 0
    for _, start, end in scan(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return text if text is None else "".join([*out, text[at:]])


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with secrets replaced in ``text``; all other columns stay."""
    def run(batches):
        for batch in sliced(batches):
            at = batch.schema.get_field_index("text")
            text = pa.array([redact(t, mark) for t in batch.column(at).to_pylist()], batch.schema.field(at).type)
            yield batch.set_column(at, "text", text)

    return docs.mapInArrow(run, docs.schema)
