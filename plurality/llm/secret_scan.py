"""Secret scan: fixed patterns, and assignments read with a small lexer.

Every whole text is scanned twice. Three patterns (assignments to telling names,
access keys, long hexadecimal runs) give the base spans. The lexer reads source and
configuration syntax into (name, literal) pairs: ``name = "literal"``, ``name:
literal``, ``"name": "literal"``, ``name => literal``, ``<name>literal</name>``,
``x["name"] = "literal"``, ``name: type = "literal"``, ``var name type = "literal"``,
``<add key="name" value="literal"/>`` and YAML block scalars; literals may be in
single, double, triple or back quotes, with ``+`` joining them and names standing for
what was assigned to them before. A literal whose name, or whose holder's name, is sensitive is scored by
name, length, character classes and entropy; above a threshold its span is added
under the kind ``named``. Base spans are never removed.

Results for odd input: a NULL or empty text has no spans; spans of equal start
are ordered by kind; repeated rows get equal results; very long texts are scanned whole,
and long joined literals scored by their beginning; an empty table gives no rows. Offsets are code points,
ends exclusive. Other columns are carried, not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plurality.functions import col
from plurality.llm.batches import slices

# Kinds in the order in which spans of equal start are listed.
KINDS = ("assign", "access", "hex", "named")
THRESHOLD = 4.0
RESULT = (
    "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
    "spans string, redacted string"
)

# The base patterns, each with the least length of the named group.
_BASE = (
    (
        "assign",
        re.compile(
            r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
            r"(?P<least>[A-Za-z0-9+/_.=-]+)",
            re.ASCII,
        ),
        6,
    ),
    ("access", re.compile(r"(?P<least>AKIA[A-Z0-9]+)"), 20),
    ("hex", re.compile(r"(?P<least>[0-9a-f]{24,})"), 24),
)

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Matches of the fixed patterns, leftmost and without overlap per kind."""
    return [
        (m.start(), m.end(), kind)
        for kind, pattern, least in _BASE
        for m in pattern.finditer(text)
        if m.end("least") - m.start("least") >= least
    ]


# Words in names that make a literal worth protecting, by weight.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "passphrase": 3.0, "secret": 3.0,
    "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5,
    "private": 1.5, "access": 1.0, "auth": 1.5, "bearer": 2.5, "signing": 1.5,
    "encryption": 1.5, "client": 0.5, "api": 1.0, "key": 1.5, "salt": 1.5,
}
# Literals that stand for a secret without being one.
PLACEHOLDERS = re.compile(
    r"(?i)^(none|null|true|false|undefined|changeme|example|placeholder|redacted|"
    r"your[\W_].*|x{3,}|\*+|<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%)$"
)

_NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
# One lexer rule per kind of token that matters; white space of one line only. A name
# may end a subscript or be an array.
_PAIR = re.compile(
    rf"(?<![A-Za-z0-9_.-])(?P<quote>[\"']?)(?P<name>{_NAME})(?P=quote)[ \t]*"
    r"(?:\][ \t]*)?(?:\[[0-9]*\][ \t]*)?"
    r"(?P<op>:=|=>|==?|:)[ \t]*(?=[\"'`A-Za-z0-9+/_$%<{*.&|>-])",
    re.ASCII,
)
_ATOM = (
    r"(?:&(?:'[a-z_]+[ \t]+)?(?:mut[ \t]+)?|\*)?"
    r"[A-Za-z_][A-Za-z0-9_]*(?:(?:\.|::)[A-Za-z_][A-Za-z0-9_]*)*"
    r"(?:<[^\n=;{}()\"]{0,80}>|\[[^\n=;{}()]{0,80}\])?[?!]?"
)
_SET = r"[ \t]*=(?![=>])[ \t]*(?=[\"'`A-Za-z0-9+/_$%<{*.-])"
# A type behind the name's colon, up to the literal; and one without a colon.
_TYPE = re.compile(rf"{_ATOM}(?:[ \t]*\|[ \t]*{_ATOM}){{0,5}}{_SET}", re.ASCII)
_DECLARED = re.compile(rf"\b(?:var|const)[ \t]+(?P<name>{_NAME})[ \t]+{_ATOM}{_SET}", re.ASCII)
_ELEMENT = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<>\n]+)</(?P=name)>", re.ASCII)
# An element with attributes, and its text if nothing else is in it.
_TAG = re.compile(
    r"<[A-Za-z][\w:.-]*(?P<attrs>(?:\s+[A-Za-z_][\w:.-]*\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))+)"
    r"(?:\s*>(?P<text>[^<>]+)</)?",
    re.ASCII,
)
_ATTRIBUTE = re.compile(
    r"(?P<name>[A-Za-z_][\w:.-]*)\s*=\s*(?P<q>[\"'])(?P<value>(?:(?!(?P=q)).)*)(?P=q)",
    re.ASCII | re.S,
)
_NAMING = frozenset({"key", "name", "id", "property"})
_OPERAND = re.compile(
    r"(?:[rbuf]{0,2}(?P<q3>\"\"\"|'{3})(?P<text3>(?s:.*?))(?P=q3)"
    r"|(?P<back>`)(?P<textb>(?s:\\.|[^`\\])*)`"
    r"|[rbuf]?(?P<q>[\"'])(?P<text>(?:\\.|(?!(?P=q))[^\\\n])*)(?P=q)"
    r"|(?P<bare>[A-Za-z0-9+/_.=$%-]+))",
    re.ASCII,
)
_QUOTED = re.compile(r"[rbuf]{0,2}[\"'`]")
_BLOCK = re.compile(r"[|>][+0-9-]{0,2}[ \t]*(?:#[^\n]*)?\r?\n")
_BEFORE_KEY = re.compile(r"[ \t-]*[\"']?\Z")
_LINE = re.compile(r"(?P<indent>[ \t]*)(?P<text>[^\n]*?)[ \t\r]*(?:\n|\Z)")
_PLUS = re.compile(r"[ \t]*\+[ \t]*(?=[\"'`A-Za-z_])")
_IDENTIFIER = re.compile(rf"{_NAME}\Z", re.ASCII)
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", re.ASCII)


# Characters of a joined literal that are kept to score it; all its parts have spans.
SCORED_CHARS = 4096


@dataclass(eq=False)
class Literal:
    """What is assigned: its text (the beginning, to be scored), and where its parts stand.

    A part that is a constant is held by reference, so that joining constants over and
    over costs a step each, not a copy.
    """

    text: str = ""
    own: list[tuple[int, int]] = field(default_factory=list)
    constants: list[Literal] = field(default_factory=list)

    def places(self, seen: set[int]) -> Iterator[tuple[int, int]]:
        """The spans of all parts, without the constants in ``seen``, which grows."""
        waiting = [self]
        while waiting:
            literal = waiting.pop()
            if id(literal) not in seen:
                seen.add(id(literal))
                yield from literal.own
                waiting += literal.constants


def assignments(text: str) -> Iterator[tuple[str, Literal]]:
    """(name, literal) of every assignment, constants filled in.

    A name on the right stands for the literal that it was last assigned.
    """
    constants: dict[str, Literal] = {}
    found = [m for m in _PAIR.finditer(text) if m["op"] != "=="]
    for m in sorted([*found, *_DECLARED.finditer(text)], key=lambda m: m.start("name")):
        starts = [m.end()]
        if m.re is _PAIR and m["op"] == ":":
            if spans := _block_lines(text, m.start("name"), m.end()):
                yield m["name"], Literal("".join(text[a:b] for a, b in spans), spans)
                continue
            if typed := _TYPE.match(text, m.end()):
                # Without quotes the right side may be a value that holds a sign.
                sure = _QUOTED.match(text, typed.end())
                starts = [typed.end()] if sure else [m.end(), typed.end()]
        for at in starts:
            literal = _operands(text, at, constants)
            if literal.own or literal.constants:
                constants[m["name"]] = literal
                yield m["name"], literal
    for m in _ELEMENT.finditer(text):
        yield m["name"], Literal(m["value"].strip(), [m.span("value")])
    for tag in _TAG.finditer(text):
        names, values = [], []
        for m in _ATTRIBUTE.finditer(text, *tag.span("attrs")):
            if m["name"].lower() in _NAMING:
                names.append(m["value"])
            elif m["name"].lower() == "value":
                values.append(m.span("value"))
        if tag["text"] and not values:
            values.append(tag.span("text"))
        for name in names:
            for a, b in values:
                yield name, Literal(text[a:b].strip(), [(a, b)])


def _operands(text: str, at: int, constants: dict[str, Literal]) -> Literal:
    """The literal that starts at a place."""
    literal = Literal()
    while operand := _OPERAND.match(text, at):
        inner = next(g for g in ("text3", "textb", "text", "bare") if operand[g] is not None)
        part = operand[inner]
        if inner == "bare" and part in constants:
            literal.constants.append(constants[part])
            part = constants[part].text
        else:
            literal.own.append(operand.span(inner))
        if len(literal.text) < SCORED_CHARS:
            literal.text = (literal.text + part)[: max(SCORED_CHARS, len(part))]
        plus = _PLUS.match(text, operand.end())
        if not plus:
            break
        at = plus.end()
    return literal


def _block_lines(text: str, name: int, at: int) -> list[tuple[int, int]]:
    """Spans of the lines of a YAML block scalar: what is indented more than its key."""
    opened = _BLOCK.match(text, at)
    if not opened:
        return []
    start = text.rfind("\n", 0, name) + 1
    before = text[start:name]
    if not _BEFORE_KEY.match(before):
        return []
    column, spans, at = len(before.rstrip("\"'")), [], opened.end()
    while at < len(text):
        line = _LINE.match(text, at)
        if line["text"]:
            if len(line["indent"]) <= column:
                break
            spans.append(line.span("text"))
        at = line.end()
    return spans


def sensitivity(name: str) -> float:
    """How strongly a name announces a secret: its words' weights, at most 4."""
    words = [w.lower() for w in _WORDS.findall(name.replace("_", " "))]
    weight = sum(SENSITIVE.get(w, 0.0) for w in set(words))
    joined = "".join(words)
    weight = max(weight, *(v for k, v in SENSITIVE.items() if joined.endswith(k)), 0.0)
    return min(4.0, weight)


def strength(literal: str) -> float:
    """How much a literal looks like a secret: length, classes, bits per character."""
    if len(literal) < 6 or PLACEHOLDERS.match(literal):
        return 0.0
    classes = sum(
        any(test(c) for c in literal)
        for test in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum())
    )
    n = len(literal)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    return min(1.0, n / 16) + 0.5 * (classes - 1) + min(1.5, entropy / 2.5)


def named_spans(text: str, threshold: float = THRESHOLD) -> list[Span]:
    """Literals assigned to sensitive names."""
    found, seen, kept = set(), set(), []
    for name, literal in assignments(text):
        weight = sensitivity(name)
        strong = strength(literal.text) if weight >= 1.5 else 0
        if strong and weight + strong >= threshold:
            # Literals are told apart by identity, so those seen must stay alive.
            kept.append(literal)
            found.update((a, b, "named") for a, b in literal.places(seen) if a < b)
    return list(found)


def scan(text: str | None, threshold: float = THRESHOLD) -> list[Span]:
    """All spans of a text by start, then kind."""
    if not text:
        return []
    spans = base_spans(text)
    if "=" in text or ":" in text or "</" in text:
        spans += named_spans(text, threshold)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def redact(text: str | None, spans: list[Span], mark: str = "[secret]") -> str | None:
    """The text with ``mark`` in place of every maximal covered stretch."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, _ in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def secrets_of(text: Column, threshold: float = THRESHOLD, redacted: bool = True) -> Column:
    """Struct of counts, digest, spans and the redacted text (NULL if not asked for)."""

    names, kinds = zip(*[part.split() for part in RESULT.split(", ")])
    types = [pa.int64() if kind == "bigint" else pa.string() for kind in kinds]

    @F.arrow_udf(RESULT)
    def scanned(texts: pa.Array) -> pa.Array:
        parts = []
        for part in slices(texts):
            rows = []
            for text in part:
                spans = scan(text, threshold)
                base = [s for s in spans if s[2] != "named"]
                counts = Counter(kind for _, _, kind in base)
                digest = hashlib.sha256(listed(base).encode()).hexdigest()
                clean = redact(text, spans) if redacted else None
                rows.append((*(counts[k] for k in KINDS[:3]), digest, listed(spans), clean))
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            parts.append(pa.StructArray.from_arrays(columns, names))
        return pa.concat_arrays(parts)

    return scanned(text)


def find_secrets(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans."""
    found = docs.select(
        col(doc_id).alias("doc_id"),
        secrets_of(col(text), threshold, redacted=False).alias("found"),
    )
    return found.select("doc_id", "found.*").drop("redacted")
