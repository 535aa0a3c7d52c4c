"""Secret scans by assignment-aware lexing, on top of three base patterns.

Every text is searched for the base patterns (kinds ``assign``, ``access``, ``hex``), whole and
exactly. Lines with an assignment are also lexed as source or configuration: strings, names,
numbers, references and operators become tokens; ``name = value``, ``"name": value``, ``<name>value</name>``,
``--name value`` and ``name -> value`` become pairs of a name and an expression of literals and
references joined by ``+`` or standing side by side. Constants are propagated in order of the text:
a reference (``NAME``, ``$NAME``, ``${NAME}``) takes the literals that its name was last given. A pair's score
adds how sensitive its target's words are (its name split at case and marks) and how random the value
looks; at ``threshold`` or more, the literals' own spans become spans of kind ``literal``, wherever they
were written. Base spans stay as they are.

All offsets are code points, ends exclusive. Spans are ordered by start, then by kind as listed.

Cases: null texts count as empty and have no spans. Unclosed strings end at their line's end.
Names that refer to themselves have no value. Texts of any length are scanned whole; the lexer takes one line at a time, and a target without its value,
or an expression that ends in an operator, goes on in the next line that isn't blank. Rows
that repeat get equal results. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Generator, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_quality import blocks
from .shared import documents

KINDS = ("assign", "access", "hex", "literal")
#: Fixed patterns of the contract. A run of 32 or more hex digits is what greedy [0-9a-f]+ finds there; the same goes for AKIA with 12 more.
ASSIGN = re.compile(r"""(?ai:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Words in a target's name and how much each says that the value is secret.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.8, "apikey": 1.0, "key": 0.4, "credential": 0.9, "credentials": 0.9,
    "auth": 0.5, "private": 0.5, "api": 0.3, "access": 0.3, "bearer": 0.7, "jwt": 0.7, "salt": 0.5, "signature": 0.5, "session": 0.3, "cert": 0.3,
}
#: Words that say that a value is no secret.
HARMLESS = {"name": -0.5, "id": -0.3, "file": -0.9, "path": -0.9, "url": -0.6, "public": -0.7, "length": -0.8, "count": -0.8, "type": -0.6, "field": -0.6, "label": -0.6, "example": -0.8, "placeholder": -1.0}
PLACEHOLDER = re.compile(r"(?i)^(?:x+|\*+|\.+|none|null|true|false|undefined|changeme|your[-_ ].*|<.*>|todo.*|example.*|test|dummy|redacted)$")
#: Each line with an assignment has one of these; a line without is lexed only where a target waits for its value.
CANDIDATE = re.compile(r"[=:]|--[A-Za-z]|</|->")
#: Elements that hold line breaks; those on one line are tokens.
TAG = re.compile(r"<(?P<name>[A-Za-z_][\w.-]*+)[^<>]*+>(?P<held>[^<>]++)</(?P=name)\s*+>")
#: Words at a line's end that say that its value follows.
GOES_ON = {"\\", "|", "|-", "-"}
#: Small letters of what an ``assign`` match must contain.
HINTS = ("passw", "secret", "token", "api_key", "apikey")
#: No branch gives back what it took, so a line is read in time proportional to its length.
TOKEN = re.compile(
    r"""(?P<string>[rbfuRBFU]{0,2}(?P<quote>'''|\"\"\"|"|'|`)(?P<body>(?:\\.|(?!(?P=quote)).)*)(?P<close>(?P=quote))?)"""
    r"""|(?P<tag><(?P<tagname>[A-Za-z_][\w.-]*+)[^<>]*+>(?P<tagged>[^<>]++)</(?P=tagname)\s*+>)"""
    r"""|(?P<option>--(?P<optname>[A-Za-z][\w-]*+)(?:=|\s++))"""
    r"""|(?P<ref>\$\{(?P<refname>[A-Za-z_][\w.]*+)[^{}\s]*+(?:\{[^{}\s]*+\}[^{}\s]*+)?+\}|\$(?P<refbare>[A-Za-z_]\w*+))"""
    r"""|(?P<op>:=|=>|->|==+|!=|<=|>=|\+=|\?\?|=|:|\+)"""
    r"""|(?P<name>[A-Za-z_][\w]*(?:[.-][A-Za-z_]\w*)*)"""
    r"""|(?P<comment>(?:#|//)\s?)"""
    r"""|(?P<word>[^\s"'`=:+<>,;(){}\[\]$#]+)"""
    r"""|(?P<mark>[,;(){}\[\]<>$#])"""
)
WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    small = text.lower()
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8] if any(h in small for h in HINTS) else []
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def name_score(name: str) -> float:
    words = [w.lower() for w in WORDS.findall(name)]
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    found = [SENSITIVE[w] for w in {*words, *joined} if w in SENSITIVE]
    return sum(found) + sum(HARMLESS.get(w, 0.0) for w in words)


class Value:
    """Literals in order, as a graph that shares what constants hold, with what the score needs of their text.

    A constant can be used many times over, so its text may be far longer than the document.
    """

    EDGE = 64
    __slots__ = ("blank", "counts", "head", "inner", "lead", "length", "parts", "span", "tail", "told", "trail")

    def __init__(self, text: str = "", span: tuple[int, int] | None = None):
        bare = text.strip()
        self.parts, self.span, self.told = [], span, False
        self.counts, self.length, self.head, self.tail = Counter(text), len(text), text[: self.EDGE], text[-self.EDGE :]
        self.blank, self.inner = not bare, " " in bare
        self.lead, self.trail = " " in text[: len(text) - len(text.lstrip())], " " in text[len(text.rstrip()) :]

    def add(self, other: Value) -> None:
        self.parts.append(other)
        self.counts.update(other.counts)
        self.length += other.length
        self.head, self.tail = (self.head + other.head)[: self.EDGE], (self.tail + other.tail)[-self.EDGE :]
        self.inner |= other.inner or not self.blank and not other.blank and (self.trail or other.lead)
        if self.blank:
            self.lead |= other.lead
        self.trail = other.trail or other.blank and self.trail
        self.blank &= other.blank

    def placeholder(self) -> bool:
        if self.length <= self.EDGE:
            return bool(PLACEHOLDER.match(self.head))
        if set(self.counts) <= {"x", "X"} or set(self.counts) in ({"*"}, {"."}):
            return True
        # Longer ones are told by their ends; no fixed word is so long. The mark in the middle is no run of one sign.
        return bool(PLACEHOLDER.match(self.head + ("\n" if "\n" in self.counts else "-") + self.tail))

    def spans(self) -> Iterator[tuple[int, int]]:
        """Spans of its literals that weren't told before."""
        left = [self]
        while left:
            value = left.pop()
            if not value.told:
                value.told = True
                left += value.parts
                if value.span and value.span[1] > value.span[0]:
                    yield value.span


def value_score(value: Value) -> float:
    """From -1 (a placeholder, or too short) to 0.6 (long, mixed and without repeats)."""
    if value.length < 6 or value.inner or value.placeholder():
        return -1.0
    entropy = -sum(p * math.log2(p) for c in value.counts.values() if (p := c / value.length))
    signs = "".join(value.counts)
    kinds = sum(bool(re.search(p, signs)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(0.6, 0.1 * entropy + 0.1 * (kinds - 1))


def lex(line: str, base: int) -> Iterator[tuple[str, str, int, int]]:
    """(kind, value, start, end) of the tokens of a line; spans of strings and tags are those of what they hold."""
    at = 0
    while m := TOKEN.search(line, at):
        at = m.end()
        kind = m.lastgroup if m.lastgroup in ("op", "name", "word", "mark", "comment") else next(k for k in ("string", "tag", "option", "ref") if m[k] is not None)
        if kind == "string":
            yield "string", m["body"], base + m.start("body"), base + m.end("body")
        elif kind == "tag":
            yield "tag", m["tagname"], base + m.start("tagged"), base + m.end("tagged")
        elif kind == "option":
            yield "option", m["optname"], base + m.start(), base + m.end()
        elif kind == "ref":
            yield "ref", m["refname"] or m["refbare"], base + m.start(), base + m.end()
        elif kind != "comment":
            yield kind, m[0], base + m.start(), base + m.end()


Pair = tuple[str, list[tuple[str, str, int, int]]]
GIVES = {"=", ":", ":=", "=>", "->", "+="}


def pairs(line: str, base: int, opened: Pair | None = None) -> Generator[Pair, None, Pair | None]:
    """Targets and the parts of what they are given: literals, names and references.

    ``opened`` is what the line before left without its value, or its value's rest; returns the same of this line.
    """
    tokens = list(lex(line, base))
    if tokens and tokens[-1][0] == "word" and tokens[-1][1] in GOES_ON:
        tokens.pop()
        goes_on = True
    else:
        goes_on = False
    target, parts = opened or (None, [])
    joined = True
    for i, (kind, value, start, end) in enumerate(tokens):
        after = tokens[i + 1] if i + 1 < len(tokens) else ("", "", 0, 0)
        if kind == "tag":
            yield value, [("string", line[start - base : end - base].strip(), start, end)]
        elif (kind in ("name", "string") and after[0] == "op" and after[1] in GIVES) or kind == "option":
            if target is not None and parts:
                yield target, parts
            target, parts, joined = value, [], True
        elif kind == "op" and value in GIVES:
            joined = True
        elif kind == "op" and value in ("+", "??"):
            joined = True
        elif target is not None and kind in ("string", "word", "name", "ref"):
            # Strings may stand side by side; anything else needs an operator between.
            if joined or (kind == "string" and parts and parts[-1][0] == "string"):
                parts.append((kind, value, start, end))
                joined = False
        elif kind == "mark" and value in ",;})]":
            if target is not None and parts:
                yield target, parts
            target, parts = None, []
    if target is not None and (joined or goes_on):
        return target, parts
    if target is not None and parts:
        yield target, parts
    return None


def assignments(text: str) -> Iterator[Pair]:
    """Pairs of all lines that have any, in order; elements of several lines come with the line that closes them."""
    tags = [m for m in TAG.finditer(text) if "\n" in m[0]] if "</" in text else []
    at, opened, told = 0, None, 0
    while at < len(text):
        start = at
        if opened is None:
            m = CANDIDATE.search(text, at)
            if not m:
                break
            start = text.rfind("\n", 0, m.start()) + 1
        end = text.find("\n", start if opened else m.start())
        end = len(text) if end < 0 else end
        opened = yield from pairs(text[start:end], start, opened)
        while told < len(tags) and tags[told].end() <= end:
            m = tags[told]
            yield m["name"], [("string", m["held"].strip(), m.start("held"), m.end("held"))]
            told += 1
        at = end + 1
    if opened and opened[1]:
        yield opened


def literal_spans(text: str, threshold: float = 0.9) -> list[tuple[int, int, str]]:
    constants: dict[str, Value] = {}
    found = set()
    for target, parts in assignments(text):
        whole = Value()
        for kind, value, start, end in parts:
            if kind in ("name", "ref") and value in constants:
                whole.add(constants[value])
            elif kind != "ref":
                whole.add(Value(value, (start, end)))
        if target not in [value for kind, value, _, _ in parts if kind in ("name", "ref")]:
            constants[target] = whole
        bare = all(kind == "name" and value not in constants for kind, value, _, _ in parts)
        # A bare word is a literal in configuration only when it doesn't read as a name.
        if bare and not any(c.isdigit() for c in whole.counts):
            continue
        sensitive = name_score(target)
        if sensitive > 0 and sensitive + value_score(whole) >= threshold:
            found |= {(start, end, "literal") for start, end in whole.spans()}
    return list(found)


def scan(text: str, threshold: float = 0.9) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) of a text, in order."""
    spans = base_spans(text) + literal_spans(text, threshold)
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def find_secrets(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", threshold: float = 0.9) -> DataFrame:
    """Per row: doc_id, spans (kind, start, end)."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches):
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in scan(text, threshold)] for text in texts]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(spans, kind)], ["doc_id", "spans"])

    plain = df.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return plain.mapInArrow(find, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(documents(spark, sf_dir)).withColumn("base", F.filter("spans", lambda s: s["kind"] != "literal"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def digest(spans: list[tuple[int, int, str]]) -> str:
    """base_sha256 of a text's spans, as the query derives it."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans if k != "literal").encode()).hexdigest()
