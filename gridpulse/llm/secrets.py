"""Secret scans: an assignment-aware lexer over code, configuration and prose.

Base findings are three patterns: assignments of sensitive names, access keys, long hex runs. The
method adds name-literal pairs. A small lexer reads assignments (``=``, ``:``, ``:=``, ``=>``) of any length with type
annotations and subscripts, tuples of names and values, ``#define``, calls that store a name and a literal, and markup attributes
(``key="..." value="..."``). Literals are bare words, quoted strings with prefixes and in back quotes, triple-quoted strings, indented YAML
blocks, joined strings (adjacent, added, in brackets), the first string of a wrapping call and the default of a lookup.
Calls, subscripts and dotted names are expressions, not literals. Constants are propagated through assignments of
names, defined above or below their use. Each literal is scored by how
sensitive its target name is and how much it looks like a credential. A constant that reaches a
sensitive target is reported where its literal stands; of joined strings every piece is reported.

Spans are code points, end exclusive; kinds in order: assign, access, hex, lexed.

Defined cases: null text is empty and has no spans; overlapping spans of different kinds all stay;
repeated rows are judged row by row; extra columns are ignored; an empty table gives an empty result.
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
from pyspark.sql import functions as F

from gridpulse.llm.common import ready

# The base patterns and their order. Letter case is spelt out, as only ASCII letters fold.
KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
HEX_RUN = bytes(0x78 if chr(b) in "0123456789abcdef" else 0x20 for b in range(256))

# Parts of target names and how sensitive each makes its literal.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "api_key": 1.0, "access_key": 1.0, "private_key": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.6,
    "bearer": 0.8, "signing_key": 0.9, "encryption_key": 1.0, "client_secret": 1.0, "conn_string": 0.8,
}
# Every repeat is possessive and a name starts where its run of characters does, so scans are linear without bounds.
TARGET = re.compile(
    r"""(?P<quote>["']?)(?<![A-Za-z0-9_.\-])[0-9.\-]*+(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P=quote)"""
    r"""[ \t]*+(?:\[(?P<index>[A-Za-z0-9_]*+)\]|\])?[ \t]*+(?P<sign>:=|=>|[?!]?:|=)[ \t]*+""")
_TYPE = r"[A-Za-z_]++(?:(?:8|16|32|64|128)(?![A-Za-z0-9_]))?(?:(?:\.|::)[A-Za-z_]++)*+(?:\[(?:[^\]\n=:\"']|::)*+\]++|<(?:[^>\n=:\"']|::)*+>++)*+[?!]?"
ANNOTATION = re.compile(
    rf"(?:&(?:'[a-z_]++[ \t]++)?(?:mut[ \t]++)?)?{_TYPE}(?:[ \t]*+\|[ \t]*+{_TYPE})*+(?:[ \t]++=(?![=>])[ \t]*+|=[ \t]*+(?=[\"']))")
_PREFIX = r"""(?:[A-Za-z]{1,2}(?=["'`]))?+"""
QUOTED = re.compile(_PREFIX + r"""(?P<open>["'`])(?P<text>(?:[^"'`\\\n]++|\\.|(?!(?P=open))["'`])++)(?P=open)""")
LONG = re.compile(_PREFIX + r"""(?P<mark>\"{3}|'{3})""")
BARE = re.compile(r"""[^\s"'`#;,(){}\[\]<>]++""")
BLOCK = re.compile(r"[|>][+\-]?[0-9]?[+\-]?[ \t]*+\n")
BLOCK_LINE = re.compile(r"(?P<indent>[ \t]*+)(?P<rest>[^\n]*+)\n?")
BRACKETS = re.compile(r"(?:\([ \t\n]*+)++")
JOIN = re.compile(r"[ \t]*+(?:\\?\n[ \t]*+(?=[+.&]))?+(?:[+.&][ \t]*+(?:\\?\n[ \t]*+)?|\\\n[ \t]*+)?+")
JOIN_IN_BRACKETS = re.compile(r"\s*+(?:[+.&]\s*+)?+")
CALL = re.compile(r"(?:(?:new|await)[ \t]++)?+(?P<call>[A-Za-z_](?:[A-Za-z0-9_.]|::)*+)\([ \t\n]*+")
ARGUMENT = re.compile(r"(?:[A-Za-z0-9_.]++(?:\[[^\]\n]*+\])?+)?+\s*+,\s*+")
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")
# Dotted names whose parts read like names; parts of encoded tokens mix digits in.
_WORD = r"[A-Za-z_]++[0-9]{0,3}+(?:_[A-Za-z_]*+[0-9]{0,3}+)*+"
DOTTED = re.compile(rf"{_WORD}(?:\.{_WORD})++\Z")
TUPLE = re.compile(
    r"(?m)^[ \t]*+(?:(?:const|let|var|final)[ \t]++)?+[(\[]?+[ \t]*+(?P<names>[A-Za-z_]\w*+(?:[ \t]*+,[ \t]*+[A-Za-z_]\w*+)++)"
    r"[ \t]*+[)\]]?+[ \t]*+(?P<sign>:?=(?!=)[ \t]*+)[(\[]?+[ \t]*+")
ELEMENT, COMMA = re.compile(r"""[^\s"'`,;()\[\]{}=:#]++"""), re.compile(r"[ \t]*+,[ \t]*+")
TUPLE_END = re.compile(r"(?m)[ \t]*+[)\]]?+[ \t]*+(?:;|#|//|$)")
# How the last part of a call's name begins that looks a name up, and that stores a name with a literal.
LOOKUP = re.compile(r"(?:get|load|read|open|fetch|find|lookup|require|input|prompt|env)")
PAIRS = (
    re.compile(r"(?m)^[ \t]*+#[ \t]*+define[ \t]++(?P<name>[A-Za-z_]\w*+)[ \t]++"),
    re.compile(
        r"""(?<![A-Za-z0-9_])(?:define|set|put|add|get|insert|export|store|register)[A-Za-z_]*+\([ \t]*+(?P<quote>["'])"""
        r"""(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P=quote)[ \t]*+,[ \t]*+"""),
    re.compile(
        r"""(?<![A-Za-z0-9_\-])(?:key|name|id)[ \t]*+=[ \t]*+(?P<quote>["'])(?P<name>[A-Za-z_][A-Za-z0-9_.\-]*+)(?P=quote)"""
        r"""\s++(?:value|content)[ \t]*+=[ \t]*+"""),
)
PLACEHOLDER = re.compile(r"(?i)(?:x+|\*+|\.+|none|null|true|false|undefined|changeme|example|your[_-].*|<.*|\$\{?.*|\{.*\})\Z")
REPORT_FROM = 0.5

Span = tuple[int, int, str]
Pieces = tuple[tuple[int, int], ...]


def base_spans(text: str) -> list[Span]:
    """The base findings, sorted by start and kind."""
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in text.encode("utf-8", "surrogatepass").translate(HEX_RUN):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def name_weight(name: str) -> float:
    """How sensitive a target name is: by its whole, its parts and its pairs of parts."""
    parts = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().replace("-", "_").replace(".", "_").split("_")
    pairs = ["_".join(parts[i:i + 2]) for i in range(len(parts) - 1)]
    return max((SENSITIVE.get(p, 0.0) for p in [*parts, *pairs, "".join(parts)]), default=0.0)


def literal_weight(literal: str) -> float:
    """How much a literal looks like a credential: length, mixed characters, spread."""
    if len(literal) < 6 or PLACEHOLDER.match(literal) or any(c.isspace() for c in literal):
        return 0.0
    counts = Counter(literal)
    bits = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    classes = sum(any(t(c) for c in literal) for t in (str.islower, str.isupper, str.isdigit)) + (not literal.isalnum())
    return min(1.0, 0.15 * classes + 0.1 * bits + 0.02 * min(len(literal), 20))


class Statement(NamedTuple):
    """A target with the pieces of its literal, none for an expression; ``reference`` is the name that a bare word may be.

    A target that is itself a bare literal defines no constant for the statements above it.
    """

    name: str
    index: str
    pieces: Pieces
    reference: str | None = None
    defines: bool = True


def quoted(text: str, at: int) -> tuple[int, int, int] | None:
    """Start and end of what a string literal at ``at`` holds, and where the literal ends."""
    if long := LONG.match(text, at):
        close = text.find(long["mark"], long.end())
        held = text[long.end():max(close, long.end())]
        if held.strip():
            start = long.end() + len(held) - len(held.lstrip())
            return start, start + len(held.strip()), close + 3
    if found := QUOTED.match(text, at):
        return *found.span("text"), found.end()
    return None


def strings(text: str, at: int, joins: bool) -> tuple[Pieces, int] | None:
    """The pieces of a literal of one or more joined strings, and where it ends."""
    brackets = BRACKETS.match(text, at)
    first = quoted(text, brackets.end() if brackets else at)
    if first is None:
        return None
    pieces, after = [first[:2]], first[2]
    between = JOIN_IN_BRACKETS if brackets else JOIN
    while joins and (more := quoted(text, between.match(text, after).end())):
        pieces.append(more[:2])
        after = more[2]
    return tuple(pieces), after


def argument(text: str, call: re.Match, joins: bool) -> tuple[Pieces, int]:
    """The literal that a call wraps, or the default of a lookup."""
    looks_up = LOOKUP.match(re.split(r"[.:]", call["call"])[-1].lower())
    at, place = call.end(), 0
    while True:
        if found := strings(text, at, joins):
            if place or not looks_up:
                return found
            at = found[1]
        following = ARGUMENT.match(text, at)
        if not joins or not following:
            return (), at
        at, place = following.end(), place + 1


def block(text: str, key: int, at: int) -> Pieces:
    """The indented lines after ``at``, deeper than the line of ``key``, from the first word to the last."""
    own = BLOCK_LINE.match(text, text.rfind("\n", 0, key) + 1)
    start = end = None
    while at < len(text):
        line = BLOCK_LINE.match(text, at)
        if line["rest"].strip():
            if len(line["indent"]) <= len(own["indent"]):
                break
            start = line.start("rest") if start is None else start
            end = line.start("rest") + len(line["rest"].rstrip())
        at = line.end()
    return () if start is None else ((start, end),)


def tuples(text: str) -> tuple[list[Statement], set[int]]:
    """Statements of several names and as many values, and where their values begin."""
    out, begins = [], set()
    for m in TUPLE.finditer(text):
        values, at = [], m.end()
        while found := quoted(text, at) or (other := ELEMENT.match(text, at)):
            values.append((found[:2],) if isinstance(found, tuple) else ())
            at = found[2] if isinstance(found, tuple) else other.end()
            if not (comma := COMMA.match(text, at)):
                break
            at = comma.end()
        names = re.split(r"[ \t]*,[ \t]*", m["names"])
        if len(values) == len(names) and TUPLE_END.match(text, at):
            out += [Statement(n, "", v) for n, v in zip(names, values, strict=True)]
            begins.add(m.end("sign"))
    return out, begins


def statements(text: str) -> Iterator[Statement]:
    """Every statement; the search goes on inside its literal."""
    several, begins = tuples(text) if "," in text else ([], set())
    yield from several
    for pattern in PAIRS:
        for m in pattern.finditer(text):
            if found := strings(text, m.end(), False):
                yield Statement(m["name"], "", found[0])
            elif pattern is PAIRS[0] and (bare := BARE.match(text, m.end())) and text[bare.end():bare.end() + 1] != "(":
                yield Statement(m["name"], "", (bare.span(),))
    at = bare_end = joined_end = 0
    while m := TARGET.search(text, at):
        at, name, index, defines = m.end(), m["name"], m["index"] or "", m.start("name") >= bare_end
        if at in begins:
            continue
        if m["sign"].endswith(":"):
            typed = ANNOTATION.match(text, at)
            if typed and (QUOTED.match(text, typed.end()) or LONG.match(text, typed.end()) or BARE.match(text, typed.end()) or BRACKETS.match(text, typed.end())):
                at = typed.end()
            elif at >= bare_end and (lines := BLOCK.match(text, at)):
                yield Statement(name, index, block(text, m.start("name"), lines.end()))
                continue
        if at < bare_end and at == m.end():  # inside a bare word, which ends where it ends
            yield Statement(name, index, ((at, bare_end),), None, defines)
            continue
        joins = at >= joined_end
        if found := strings(text, at, joins):
            joined_end = max(joined_end, found[1])
            yield Statement(name, index, found[0], None, defines)
            at = found[0][0][0]
        elif call := CALL.match(text, at):
            pieces, end = argument(text, call, joins)
            joined_end = max(joined_end, end)
            yield Statement(name, index, pieces, None, defines)
        elif bare := BARE.match(text, at):
            bare_end = bare.end()
            word = text[at:bare_end] if NAME.match(text, at, bare_end) else None
            follows = text[bare_end:bare_end + 1]
            opaque = follows == "(" or word and follows == "[" or DOTTED.match(text, at, bare_end)
            yield Statement(name, index, () if opaque else (bare.span(),), word, defines)


def joined(text: str, pieces: Pieces) -> str:
    """What a literal says: of several lines, all but armour lines, without their margins."""
    whole = "".join(text[a:b] for a, b in pieces)
    return "".join(line.strip() for line in whole.split("\n") if not line.strip().startswith("-----")) if "\n" in whole else whole


def lexed_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, directly or through constants, in order of the statements."""
    if not any(c in text for c in "=:(#"):
        return []
    constants: dict[str, tuple[Pieces, str | None]] = {}
    first: dict[str, tuple[Pieces, str | None]] = {}
    waiting: list[tuple[float, Pieces, str]] = []
    found: set[tuple[int, int]] = set()
    reported = 0

    def judge(weight: float, pieces: Pieces) -> int:
        if pieces and weight * literal_weight(joined(text, pieces)) >= REPORT_FROM:
            found.update(pieces)
            return pieces[-1][1]
        return 0

    for name, index, pieces, reference, defines in statements(text):
        own = (pieces, reference)
        value = constants.get(reference, own) if reference else own
        constants[name] = value
        if defines:
            first.setdefault(name, value)
        # What lies in a reported literal is reported.
        if (value != own or not pieces or pieces[0][0] >= reported) and (weight := max(name_weight(name), name_weight(index))):
            if value[1]:
                waiting.append((weight, *value))
            else:
                reported = max(reported, judge(weight, value[0]))
    for weight, pieces, reference in waiting:  # names that are defined below their use, or nowhere
        passed = set()
        while reference in first and reference not in passed:
            passed.add(reference)
            pieces, following = first[reference]
            if following is None:
                break
            reference = following
        judge(weight, pieces)
    return sorted((a, b, "lexed") for a, b in found)


def all_spans(text: str) -> list[Span]:
    """Base and added spans by start, then kind as listed, then end."""
    return sorted(set(base_spans(text)) | set(lexed_spans(text)), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def masked(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with every found stretch replaced; overlapping stretches become one mark."""
    out, at, reach = [], 0, -1
    for start, end, _ in spans:
        if start >= reach:
            out += [text[at:start], mark]
        reach = at = max(reach, end)
    return "".join(out) + text[at:]


def scan_secrets(documents: DataFrame) -> DataFrame:
    """Per row: doc_id, counts of the base kinds, digest of the base spans, all spans as text."""
    ready(documents.sparkSession)
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, spans = [], [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                counts.append([sum(s[2] == k for s in base) for k in KINDS[:3]])
                shas.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(sorted({*base, *lexed_spans(text or "")}, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))))
            n = [pa.array([c[i] for c in counts], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *n, pa.array(shas, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return source.mapInArrow(
        scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def mask_secrets(documents: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``documents`` with every secret of ``text`` replaced by a mark; other columns stay."""
    ready(documents.sparkSession)
    place = documents.columns.index("text")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            clean = [t if t is None else masked(t, all_spans(t), mark) for t in texts]
            yield batch.set_column(place, batch.schema.field(place), pa.array(clean, batch.schema.field(place).type))

    return documents.mapInArrow(mask, documents.schema)
