"""Operator 3: secrets by assignment-aware lexing.

Base spans are three fixed patterns. Beyond them, every assignment operator in
the text is read as source or configuration syntax: the name before it and the
literal (or the concatenation of literals and names) after it. Constants are
propagated in text order, so ``KEY = "..."`` and a later ``password = KEY`` make
KEY's literal the value of ``password``. A literal is reported when the name it
reaches is sensitive and the literal looks like a secret (``holds``): the stronger
the name, the less the value has to show. A scheme and its token (``Bearer ...``)
are one literal of which the token is the value, a private key block is one literal
with or without quotes, and of a URL with a login the password is the value.

Defined results: a null text is an empty one; spans are code points of the whole
text, end exclusive; repeated rows give repeated rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices

# The base patterns and the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is the same run that [0-9a-f]+ finds
KINDS = ("assign", "access", "hex", "literal")

KEYWORD_END = re.compile(r"(password|passwd|secret|token|api_?key)\Z", re.I | re.A)
#: The longest keyword that KEYWORD_END can find.
KEYWORD_LENGTH = 8

#: How strongly a word in a target's name says that the value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "secrets": 1.0, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "token": 0.9, "pass": 0.8, "bearer": 0.9, "auth": 0.7, "authorization": 0.7, "signature": 0.6, "private": 0.6,
    "pin": 0.5, "key": 0.5, "cookie": 0.5, "salt": 0.5, "dsn": 0.5,
}
#: Words that make a following ``key`` secret.
KEY_OWNERS = {"api", "access", "private", "secret", "encryption", "signing", "master", "account", "storage", "service", "auth", "session", "ssh", "deploy", "license"}
#: A name that ends in one of these describes a secret and doesn't hold it.
DESCRIBES = {"id", "name", "url", "uri", "path", "file", "count", "length", "len", "size", "type", "hint", "field", "label", "policy", "expiry", "expires", "ttl", "max", "min", "limit", "public", "version", "format", "enabled", "required", "author", "authors", "keyboard", "page", "index"}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|-+|_+|0+|1234\w*|null|none|nil|true|false|undefined|todo|tbd|test|changeme|change_me|example\w*|placeholder|dummy|redacted|your[_-].*|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s|https?://.*)$")
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
LITERAL = re.compile(r"""(?:[bBrRuUfF]{1,2}(?=["']))?(?:\"\"\"(?P<a>.*?)\"\"\"|'''(?P<b>.*?)'''|"(?P<c>(?:[^"\\\n]|\\[^\n])*+)"|'(?P<d>(?:[^'\\\n]|\\[^\n])*+)'|`(?P<e>[^`\n]*)`|\$\{?(?P<ref>[A-Za-z_]\w*)\}?|(?P<bare>[^\s"'`,;(){}\[\]<>]+))""", re.S)
JOIN = re.compile(r"[ \t]*\+[ \t]*")
LEAST_SCORE = 0.5
#: From this sensitivity on a quoted value needs no second kind of characters.
STRONG = 0.7
SCHEME = re.compile(r"(?i)(?:bearer|basic|token|apikey)[ \t]+(?=[A-Za-z0-9+/_.=~-]{8,})")
KEY_BLOCK = re.compile(r"(?:[|>][+-]?[ \t]*\n)?\s*(-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----)", re.S)
URL_LOGIN = re.compile(r"\A[a-zA-Z][a-zA-Z0-9+.-]*://[^\s:/@]*:([^\s@/]+)@")


class Span(NamedTuple):
    """A finding; value is the secret itself inside it."""

    start: int
    kind: int
    end: int
    value: tuple[int, int]


def sensitivity(name: str) -> float:
    """0 to 1: how far a target of this name holds a secret."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or words[-1] in DESCRIBES or "public" in words:
        return 0.0
    score = max(SENSITIVE.get(w, 0.0) for w in words)
    for a, b in zip(words, words[1:]):
        if b in ("key", "keys") and a in KEY_OWNERS:
            score = 1.0
    return score


def looks_secret(value: str) -> float:
    """0 to 1: length, spread of characters and kinds of characters of a literal."""
    n = len(value)
    if n < 8 or any(c.isspace() for c in value) or PLACEHOLDER.match(value):
        return 0.0
    spread = -sum(k / n * math.log2(k / n) for k in Counter(value).values()) / math.log2(min(n, 64))
    kinds = sum((any(c.islower() for c in value), any(c.isupper() for c in value), any(c.isdigit() for c in value), not value.isalnum()))
    return spread * min(1.0, 0.55 + 0.15 * kinds + 0.01 * min(n, 20)) if kinds > 1 else 0.4 * spread


def holds(score: float, value: str, quoted: bool, scheme: bool) -> bool:
    """Whether a literal is the secret of a target of this sensitivity."""
    if score < LEAST_SCORE or PLACEHOLDER.match(value):
        return False
    if score * looks_secret(value) >= LEAST_SCORE:
        return True
    n, words = len(value), value.split()
    if not words:
        return False
    spread = -sum(k / n * math.log2(k / n) for k in Counter(value).values()) / math.log2(max(2, min(n, 64)))
    digits = sum(c.isdigit() for c in value)
    if len(words) > 1:  # a pass phrase: some plain words, but no sentence about secrets
        return quoted and score >= 1.0 and len(words) >= 3 and n >= 12 and all(w.isalpha() and w.islower() for w in words) and not any(w in SENSITIVE or w in DESCRIBES for w in words)
    if score >= STRONG:
        return (quoted or scheme) and n >= 6 and spread >= 0.5 and value.lower() not in SENSITIVE and sensitivity(value) == 0
    return n >= 16 and spread >= 0.6 and 8 * digits >= n and digits < n


def operators(text: str) -> Iterator[int]:
    """Places of ``=`` and ``:`` in order."""
    a, b = text.find("="), text.find(":")
    while a >= 0 or b >= 0:
        if b < 0 or 0 <= a < b:
            yield a
            a = text.find("=", a + 1)
        else:
            yield b
            b = text.find(":", b + 1)


def assignments(text: str, ops: list[int]) -> Iterator[Span]:
    """The matches of ASSIGN from left to right, found from their operators."""
    after = 0
    for op in ops:
        at = op
        while at > after and text[at - 1] == " ":
            at -= 1
        for end in (at, at - 1 if text[at - 1:at] in ("'", '"') else at):
            if (k := KEYWORD_END.search(text, max(after, end - KEYWORD_LENGTH), end)) and (m := ASSIGN.match(text, k.start())):
                after = m.end()
                if len(m[2]) >= ASSIGN_LEAST:
                    yield Span(m.start(), 0, m.end(), m.span(2))
                break


def name_before(text: str, at: int) -> str:
    while at and text[at - 1] in " \t":
        at -= 1
    while at and text[at - 1] in "\"'`]":
        at -= 1
    end = at
    while at and (text[at - 1].isalnum() or text[at - 1] in "_.-$"):
        at -= 1
    return text[at:end].strip(".-$")


def literals(text: str, ops: list[int]) -> Iterator[Span]:
    """Literals whose target is sensitive, with constants propagated."""
    known: dict[str, tuple[str, list[tuple[int, int]], bool]] = {}
    after = 0
    for op in ops:
        if op < after or not (name := name_before(text, op)):
            continue
        at = op + 1
        while text[at:at + 1] in ("=", ">", " ", "\t") and at < len(text):
            at += 1
        value, parts, quoted, scheme = "", [], False, False
        if "-" in text[at:at + 80] and (block := KEY_BLOCK.match(text, at)):
            after = block.end()
            known[name] = known[name.rpartition(".")[2]] = (block[1], [block.span(1)], True)
            yield Span(block.start(1), 3, block.end(1), block.span(1))
            continue
        if mark := SCHEME.match(text, at):
            at, scheme = mark.end(), True
        while m := LITERAL.match(text, at):
            group = m.lastgroup
            ref = m[group].rstrip(".") if group in ("ref", "bare") else None
            if ref is not None and ref in known:
                value, parts, quoted = value + known[ref][0], parts + known[ref][1], quoted or known[ref][2]
            elif group != "ref":
                start = m.start(group)
                if not parts and ref is None and (mark := SCHEME.match(m[group])):
                    start, scheme = start + mark.end(), True
                value, parts, quoted = value + text[start:m.end(group)], [*parts, (start, m.end(group))], quoted or ref is None
            after = at = m.end()
            if not (j := JOIN.match(text, at)):
                break
            at = j.end()
        if not parts:
            continue
        known[name] = known[name.rpartition(".")[2]] = (value, parts, quoted)
        if len(parts) == 1 and "://" in value and (login := URL_LOGIN.match(value)):
            if not PLACEHOLDER.match(login[1]):
                inside = parts[0][0] + login.start(1), parts[0][0] + login.end(1)
                yield Span(inside[0], 3, inside[1], inside)
        elif "PRIVATE KEY-----" in value or holds(sensitivity(name), value, quoted, scheme):
            for start, end in parts:
                if end > start:
                    yield Span(start, 3, end, (start, end))


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans, each in the order of start and kind."""
    text = text or ""
    ops = list(operators(text))
    base = list(assignments(text, ops))
    base += [Span(m.start(), 1, m.end(), m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    base += [Span(m.start(), 2, m.end(), m.span()) for m in HEX.finditer(text)]
    base.sort()
    held = {s.value for s in base}
    more = sorted({s for s in literals(text, ops) if s.value not in held})
    return base, sorted(base + more)


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row. No shuffle."""
    src = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            found = [find(t) for t in b.column(1).to_pylist()]
            yield pa.record_batch([
                b.column(0), *(pa.array([sum(s.kind == k for s in base) for base, _ in found], pa.int64()) for k in range(3)),
                pa.array([hashlib.sha256(written_out(base).encode()).hexdigest() for base, _ in found], pa.string()),
                pa.array([written_out(spans) for _, spans in found], pa.string()),
            ], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return src.mapInArrow(run, f"doc_id {dict(src.dtypes)['doc_id']}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")


def masked(text: str, spans: list[Span], mask: str) -> str:
    """The text with every secret value replaced; overlapping values count as one."""
    out, at = [], 0
    for start, end in sorted(s.value for s in spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret value in ``text_col`` masked; nulls stay null and other columns as they are."""
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col):
            texts = [t if t is None or not (s := find(t)[1]) else masked(t, s, mask) for t in b.column(at).to_pylist()]
            yield pa.record_batch([pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))], names=names)

    return docs.mapInArrow(run, docs.schema)
