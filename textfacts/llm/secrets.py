"""Secrets in text: fixed patterns, and assignment-aware lexing of source and configuration syntax.

The lexer reads `name = value`, `name: value`, `name: type = value`, `name := value`, `"name" => value`,
values on the line after a name and its colon, `<name>value</name>` and so on into pairs of a name and a value of literals and names. Of a call it reads
the quoted arguments, but not the first one of a look-up, which is a key. Names that were given literals before stand for
them (constants are propagated, also through concatenation), and each literal is scored by how
sensitive the names are that it reaches and by how little it looks like a placeholder.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts_of

KINDS = ("assign", "access", "hex", "literal")
LEAST_SCORE = 0.5
LEAST_LENGTH = 6

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer never matches, and runs are taken whole

#: A name starts where no other name goes on and is taken whole, so that each character is read a bounded number of times.
_EDGE = r"(?<![A-Za-z0-9_$])(?<![A-Za-z0-9_$][.-])"
_PAIR = re.compile(
    rf"""{_EDGE}(?P<name>[A-Za-z0-9_$]++(?:[.-][A-Za-z0-9_$]++)*+)["'\]]?[ \t]*+(?::=|=>|(?<![=!<>])=(?![=~])|:(?![:/=]))[ \t]*+(?=(?P<first>["'`A-Za-z0-9_$+/]))""",
    re.ASCII,
)


def _nested(a: str, b: str, depth: int = 3) -> str:
    """What stands in a pair of brackets on one line, and the brackets."""
    inner = rf"[^{a}{b}\n]"
    return rf"{a}(?:{inner}|{_nested(a, b, depth - 1)})*+{b}" if depth else rf"{a}{inner}*+{b}"


_BRACKETS = "|".join(_nested(a, b) for a, b in ((r"\[", r"\]"), ("<", ">"), (r"\(", r"\)"), (r"\{", r"\}")))
_WORDS = r"(?:(?:mut|dyn|impl|const|constant|readonly|keyof|typeof|unique)[ \t]+)*+"
_UNIT = rf"""(?:[&*](?:'\w++[ \t]+)?)*+{_WORDS}(?:[A-Za-z_$][\w$]*+(?:(?:\.|::)[\w$]++)*+|"[^"\n]*+"|'[^'\n]*+'|{_BRACKETS})(?:{_BRACKETS})*+[?!]?"""
#: A declaration with its type: `name: type = value`.
_TYPED = re.compile(rf"""{_EDGE}(?P<name>[A-Za-z0-9_$]++)[?!]?[ \t]*+:(?![:/=])[ \t]*+{_UNIT}(?:[ \t]*+[|&][ \t]*+{_UNIT})*+[ \t]*+:?=(?![=~>])[ \t]*+(?=(?P<first>["'`A-Za-z0-9_$+/]))""", re.ASCII)
#: A name and its colon, with the value on the next line, further in.
_NEXT = re.compile(rf"""(?m)^(?P<indent>[ \t]*+)(?:-[ \t]++)?["']?(?P<name>[A-Za-z0-9_$]++(?:[.-][A-Za-z0-9_$]++)*+)["']?[ \t]*+:[ \t]*+(?:[|>][+-]?)?[ \t]*+\r?\n(?P=indent)[ \t]++(?=(?P<first>["'`A-Za-z0-9_$+/]))""", re.ASCII)
#: An element with its text.
_TAG = re.compile(r"""<(?:\w++:)?(?P<name>[A-Za-z_][A-Za-z0-9_.-]*+)(?:[ \t][^<>\n]*+)?>[ \t]*+(?P<first>(?P<value>[^<>\s]++))[ \t]*+</(?:\w++:)?(?P=name)>""", re.ASCII)
_QUOTED = re.compile(r"""(?P<q>\"{3}|'{3}|["'`])(?P<quoted>(?:\\.|(?!(?P=q))[^\\\n])*+)(?P=q)|[()\n]""")
_ATOM = re.compile(r"""(?:[rbfuRBFU]{0,2}(?P<q>\"{3}|'{3}|["'`])(?P<quoted>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)|(?P<bare>[A-Za-z0-9_$+/.=~-]+))[ \t]*""", re.ASCII)
_NAME = re.compile(r"[A-Za-z_$][A-Za-z0-9_$]*(?:\.[A-Za-z0-9_$]+)*", re.ASCII)
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: Parts of names and how sensitive they make what is assigned to them.
_SENSITIVE = {"password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "pass": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "auth": 0.7}
#: Parts of the names of calls whose first argument is a key.
_LOOK_UPS = {"get", "getenv", "env", "environ", "property", "var", "lookup", "read", "load", "fetch", "find", "string", "config", "setting", "option", "value"}
_KEYED = {"api", "access", "private", "secret", "auth", "signing", "encryption", "client", "account", "service"}
_PLACEHOLDERS = re.compile(r"(?i)^(?:.*(?:example|changeme|change_me|placeholder|your[_-]|dummy|redacted|insert|todo).*|x+|\*+|none|null|true|false|undefined|string|test|secret|password|token)$")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    value_start: int  #: the secret itself, within start and end
    value_end: int
    name: str  #: the sensitive name, if there is one
    score: float


def name_score(name: str) -> float:
    """0 to 1: how likely a value of this name is secret."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    score = max((_SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    if "key" in parts and _KEYED & set(parts):
        score = max(score, 0.95)
    if parts and parts[-1] in ("length", "count", "name", "url", "type", "id", "path", "file", "size", "limit"):
        score *= 0.3  # what describes a secret isn't one
    return score


def literal_score(value: str) -> float:
    """0 to 1: how much a literal looks like a generated value rather than a word or a placeholder."""
    if len(value) < LEAST_LENGTH or _PLACEHOLDERS.match(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    kinds = sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))
    return min(1.0, entropy / 4) * (0.5 if kinds < 2 or " " in value else 1.0)


class _Named(NamedTuple):
    """A name with the literals given to it: spans of its own, and earlier names that stand for theirs."""

    name: str
    spans: list[tuple[int, int]]
    constants: set[int]  #: their numbers


def _arguments(text: str, at: int, call: str) -> tuple[list[tuple[int, int]], int]:
    """The spans of the quoted arguments of a call whose parenthesis is at `at`, on its line, and where it ends; without the key of a look-up."""
    spans, depth, end = [], 0, at
    for m in _QUOTED.finditer(text, at):
        end = m.end()
        if m["q"]:
            spans.append(m.span("quoted"))
        else:
            depth += (m[0] == "(") - (m[0] == ")")
            if m[0] == "\n" or not depth:
                break
    parts = _PARTS.findall(call)
    key = any(p.lower() in _LOOK_UPS for p in parts) and spans and text[at + 1 : spans[0][0] - 1].strip("rbfuRBFU \t\"'") == ""
    return spans[1:] if key else spans, end


def _definitions(text: str) -> list[_Named]:
    """Pairs of a name and a value in order of the text. A constant is referred to, not expanded, so all of them together are linear in the text."""
    found: list[_Named] = []
    number: dict[str, int] = {}  # of the latest definition of a name
    # What follows the ':' of a typed declaration may be a value with a '=' in it, so both readings are taken.
    typed = _TYPED.finditer(text) if ":" in text and "=" in text else ()
    last, within = (-1, ""), -1
    called = -1  # the end of the arguments that were read
    run, covered = -1, False  # the end of the last value without quotes, and whether a sensitive name has it
    below = _NEXT.finditer(text) if ":" in text and "\n" in text else ()
    tags = _TAG.finditer(text) if "</" in text else ()
    for pair in heapq.merge(_PAIR.finditer(text), typed, below, tags, key=lambda m: (m.start("name"), m.start("first"))):
        at, name = pair.start("first"), pair["name"]
        if pair.re is _TAG:
            number[name] = len(found)
            found.append(_Named(name, [pair.span("value")], set()))
            continue
        if pair.re is _NEXT:
            # The next line's only value: one that goes on is a text or another name.
            atom = _ATOM.match(text, at)
            if not (atom and text[atom.end() : atom.end() + 1] in ("", "\n", "\r")):
                continue
        own = (pair.start("name"), name)
        if pair.re is _TYPED:
            within = at
        elif pair.start() < within and not name_score(name):  # the type of a declaration is no name
            continue
        if pair.start() < run and own != last:  # within a value: the outermost sensitive name has all that follows
            if covered or not name_score(name):
                continue
            covered = True
        else:
            covered = bool(name_score(name))
        spans: list[tuple[int, int]] = []
        constants = {number[name]} if own == last and name in number else set()
        last = own
        while atom := _ATOM.match(text, at):
            if atom["q"]:
                spans.append(atom.span("quoted"))
            else:
                a, b = atom.span("bare")
                run = max(run, b)
                b -= len(atom["bare"]) - len(atom["bare"].rstrip(".=+"))
                bare = text[a:b]
                if text[b : b + 1] == "(" and _NAME.fullmatch(bare):
                    if b < called:  # the call around has read them
                        break
                    some, called = _arguments(text, b, bare)
                    spans += some
                    break
                if bare in number and _NAME.fullmatch(bare):
                    constants.add(number[bare])
                elif b > a:
                    spans.append((a, b))
            at = atom.end()
            if text[at : at + 1] != "+":
                break
            at += 1
            while text[at : at + 1] in (" ", "\t"):
                at += 1
        if spans or constants:
            number[name] = len(found)
            found.append(_Named(name, spans, constants))
    return found


def assigned(text: str) -> dict[tuple[int, int], tuple[float, str]]:
    """The span of each literal that reaches a sensitive name, with the most sensitive one (of equals, the last in order) and its score."""
    found = _definitions(text)
    reach = [(name_score(d.name), d.name) for d in found]
    out: dict[tuple[int, int], tuple[float, str]] = {}
    for n in range(len(found) - 1, -1, -1):  # a definition only refers to earlier ones
        for c in found[n].constants:
            reach[c] = max(reach[c], reach[n])
        if reach[n][0]:
            for span in found[n].spans:
                out[span] = max(out.get(span, (0.0, "")), reach[n])
    return out


def find(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind. None counts as empty; offsets are code points, ends exclusive."""
    if not text:
        return []
    out: list[Span] = []
    low = text.lower()
    if any(h in low for h in _ASSIGN_HINTS):
        out.extend(Span("assign", *m.span(), *m.span(2), m[1], 1.0) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST_LENGTH)
    if "AKIA" in text:
        out.extend(Span("access", *m.span(), *m.span(), "", 1.0) for m in _ACCESS.finditer(text) if len(m[0]) >= 20)
    out.extend(Span("hex", *m.span(), *m.span(), "", 1.0) for m in _HEX.finditer(text))
    if "=" in text or ":" in text:
        for (a, b), (score, name) in assigned(text).items():
            if (score := score * literal_score(text[a:b])) >= LEAST_SCORE:
                out.append(Span("literal", a, b, a, b, name, round(score, 6)))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind), s.end))


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each secret value, overlapping ones as one, replaced by a mark."""
    out, at = [], 0
    for a, b in sorted((s.value_start, s.value_end) for s in spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


SPAN = "array<struct<kind:string,start:long,end:long,name:string,score:double>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, spans and redacted text of every whole text. A null text has no spans and an empty redacted text; repeated rows give repeated results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.float64())]))
        for b in batches:
            spans, texts = [], []
            for t in texts_of(b):
                found = find(t)
                spans.append([{"kind": s.kind, "start": s.start, "end": s.end, "name": s.name, "score": s.score} for s in found])
                texts.append(redact(t, found) if found else t or "")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind), pa.array(texts, pa.string())], ["doc_id", "spans", "redacted"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, f"doc_id long, spans {SPAN}, redacted string")


def joined(spans: str, only: str = "") -> str:
    """SQL: kind:start:end of an array of spans, comma-joined."""
    kept = f"filter({spans}, s -> s.kind in ({only}))" if only else spans
    return f"array_join(transform({kept}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def digest(found: DataFrame) -> DataFrame:
    """The counts and joined spans of scan()'s rows."""
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in KINDS]
    base = joined("spans", "'assign', 'access', 'hex'")
    return found.select("doc_id", *counts[:3], F.expr(f"sha2({base}, 256)").alias("base_sha256"), F.expr(joined("spans")).alias("spans"), counts[3])


def base_digest_of(text: str | None) -> str:
    """base_sha256 by Python alone, for tests."""
    s = ",".join(f"{x.kind}:{x.start}:{x.end}" for x in find(text) if x.kind != "literal")
    return hashlib.sha256(s.encode()).hexdigest()


def redacted(docs: DataFrame) -> DataFrame:
    """docs with each secret value in its text replaced, and n_chars, where there is one, that of the new text. Null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for some in texts:
            yield pd.Series([redact(t, found) if t and (found := find(t)) else t for t in some], dtype=object)

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
