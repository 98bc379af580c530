"""Secret scanning by assignment-aware lexing.

Three plain patterns give the base spans. On top of them a text is lexed for assignments
in source and configuration syntax: ``name = "literal"``, ``"name": "literal"``,
``cfg["name"] = "literal"``, ``name: type = "literal"``, ``a, name = "x", "literal"``,
``export NAME=literal``, ``--name literal``, ``<name>literal</name>``, header-like
``name: literal`` and, below a name of its own line or brace, ``value: literal``. Values
may be long strings, strings side by side or continued, sums, lists and joins; the parts
of one value are judged together. What a call or a subscript gives is no literal. Pairs of name and literal are propagated: a name assigned another
name, or a concatenation of names and literals, gets their literals as its own, in the
order of the text, through any number of names. A literal is a secret if the names it reaches
score enough: how sensitive the words of a name are, and how random the literal is.

Everything happens within one text; no data moves between rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphsweep.llm.common import text_or_empty

#: The base patterns and the least length of what they must match.
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX_RUN = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ("assign", "access", "hex", "literal")

#: How sensitive a word of a name is. The words of a name add up like independent signs.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.8, "private": 0.6, "signature": 0.6,
    "salt": 0.6, "key": 0.5, "access": 0.4, "session": 0.4, "webhook": 0.4, "connection": 0.4, "dsn": 0.5,
}
#: What makes a name harmless although a word of it is sensitive.
HARMLESS = {"length", "count", "size", "max", "min", "limit", "name", "field", "label", "placeholder", "hint",
            "expired", "expires", "expiry", "ttl", "type", "public", "url", "path", "file", "policy", "id"}
#: Literals of at least this many characters whose name and shape score this much are secrets.
LITERAL_LEAST, SCORE_LEAST = 8, 0.35
#: Names below this are common for harmless values: theirs must mix letters and digits.
STRONG = 0.75
#: Words of a literal with blanks that is a passphrase.
PHRASE_LEAST = 3

_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-")
#: What the lexer stops at; all between is looked at once, from the next stop.
_STOP = re.compile(rf"""(?:^|(?<=\s))--(?P<flag>{_NAME})[\ =](?P<flagval>[^\s-]\S*+)
  | <(?P<tag>{_NAME})>(?P<tagval>[^<>\n]++)</(?P=tag)>
  | (?P<op>:=|=>|[=!<>~]=|=|:(?![:/])) | (?P<open>\{{) | (?P<close>\}})
""", re.VERBOSE | re.MULTILINE)
_COMPARED = {"==", "!=", "<=", ">=", "~="}
_STRING = re.compile(r"""(?P<prefix>[A-Za-z]{0,2})(?:
    \"\"\"(?P<dq3>(?:[^"\\]|\\.|"(?!""))*+)\"\"\" | \'\'\'(?P<sq3>(?:[^'\\]|\\.|'(?!''))*+)\'\'\'
  | "(?P<dq>(?:[^"\\\n]|\\.)*+)" | '(?P<sq>(?:[^'\\\n]|\\.)*+)' | `(?P<bq>[^`\n]*+)`)""", re.VERBOSE | re.DOTALL)
_REF = re.compile(rf"(?P<ref>\$?\{{?{_NAME}\}}?)(?=[\ \t]*+(?:[+;,)\r\n]|\.\.|\Z))")
_BARE = re.compile(r"""[^\s"'`;,()<>{}]++""")
_EXPRESSION = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*+\[")
_HOLE = re.compile(rf"\$?\{{({_NAME})\}}")
_BLANK, _BLANKS = re.compile(r"(?:[ \t]|\\\r?\n)*+"), re.compile(r"\s*+")
_JOIN = re.compile(r"\.join\(\s*+(?=[\[(])")
#: Between a name's colon and its equals sign: a type.
_TYPE = re.compile(r"[A-Za-z0-9_.,|?\[\] \t]{0,200}")
#: Names that say no more than that a value follows: the name around them counts.
_VALUE_NAMES = {"value", "default", "data", "content", "raw", "plain", "plaintext", "string", "text", "stringdata", "literal"}
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: A text without one of these characters has no assignment.
_HINT = re.compile(r"[=:]|--[A-Za-z]|</")


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int
    name: str = ""
    score: float = 1.0


def base_spans(text: str) -> list[Span]:
    """Leftmost matches per kind, those too short dropped; code points, end exclusive."""
    spans = [Span("assign", *m.span(), name=m[1]) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    spans += [Span("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    # runs of these characters never overlap, so only the long ones need to be looked at
    spans += [Span("hex", *m.span()) for m in HEX_RUN.finditer(text)]
    return sorted(spans, key=_order)


def _order(span: Span) -> tuple:
    return span.start, KINDS.index(span.kind), span.end


def sensitivity(name: str) -> float:
    """0 to 1: how likely a value of this name is to be kept secret."""
    words = [w.lower() for w in _WORDS.findall(name)]
    joined = {a + b for a, b in zip(words, words[1:], strict=False)}
    best = 1 - math.prod(1 - SENSITIVE.get(w, 0.0) for w in {*words, *joined})
    return 0.3 * best if HARMLESS & {w for w in words[-1:]} else best


def randomness(literal: str) -> float:
    """0 to 1: entropy per character against what its alphabet allows, and its mix.

    Of literals with blanks only passphrases count: no sentences, nor what names a secret.
    """
    if len(literal) < LITERAL_LEAST:
        return 0.0
    if " " in literal.strip():
        parts = literal.lower().split()
        if len(set(parts)) < PHRASE_LEAST or literal.strip()[-1] in ".:!?" or any(sensitivity(w) for w in parts):
            return 0.0
    counts = Counter(literal)
    entropy = -sum(n / len(literal) * math.log2(n / len(literal)) for n in counts.values())
    kinds = sum(map(bool, (re.search("[a-z]", literal), re.search("[A-Z]", literal), re.search("[0-9]", literal),
                           re.search(r"[^A-Za-z0-9]", literal))))
    return min(1.0, min(1.0, entropy / min(4.0, math.log2(len(literal)))) * (0.55 + 0.15 * kinds))


def secrecy(weight: float, literal: str) -> float:
    """Score of a literal under a name of sensitivity ``weight``."""
    if weight < STRONG and (" " in literal.strip() or not (re.search("[0-9]", literal) and re.search("[A-Za-z]", literal))):
        return 0.0
    return weight * randomness(literal)


@dataclass
class Literal:
    start: int
    end: int
    value: str
    is_name: bool = False


Assignment = tuple[str, list[Literal], list[str]]


def assignments(text: str) -> list[Assignment]:
    """Name, literals and names on the right-hand side of every assignment, in order."""
    return _Lexer(text).run()


class _Lexer:
    """One pass over a text, from operator to operator; no character is looked back to
    beyond the stop before it, so the time is linear whatever the text holds."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.found: list[Assignment] = []
        self.floor = 0  # up to here all is read
        self.line = 0  # where the line of the last stop began
        self.outer: list[tuple[int, str]] = []  # names over indented lines: indent, name
        self.braces: list[str] = []  # names of open braces
        self.typed: tuple[str, int] | None = None  # a name and colon: perhaps a type follows

    def run(self) -> list[Assignment]:
        at = 0
        while (m := _STOP.search(self.text, at)) is not None:
            at = m.end()
            if m["flag"]:
                self.found.append((m["flag"], [Literal(*m.span("flagval"), m["flagval"])], []))
            elif m["tag"]:
                self.found.append((m["tag"], [Literal(*m.span("tagval"), m["tagval"])], []))
            elif m["op"]:
                at = self._operator(m) if m["op"] not in _COMPARED else at
            elif m["open"]:
                self.braces.append("")
            elif self.braces:
                self.braces.pop()
            self.floor = at
        return self.found

    # the left-hand side

    def _name_before(self, end: int) -> tuple[str, int] | None:
        """The name that ends at ``end``, plain, quoted or a quoted subscript, and its start."""
        text, low = self.text, self.floor
        while end > low and text[end - 1] in " \t":
            end -= 1
        if end == low:
            return None
        if text[end - 1] == "]":
            inner = self._name_before(end - 1) if text[end - 2:end - 1] in ("'", '"') else None
            return (inner[0], inner[1] - 1) if inner and text[inner[1] - 1:inner[1]] == "[" else None
        quote = text[end - 1] if text[end - 1] in "\"'" else ""
        last = end - len(quote)
        start = last
        while start > low and text[start - 1] in _NAME_CHARS:
            start -= 1
        name = text[start:last].lstrip("0123456789.-")
        if not name:
            return None
        if quote and text[start - 1:start] == quote and start > low:
            start -= 1
        return name, start

    def _names(self, op: re.Match) -> list[str]:
        """The names to the left; several for a tuple, the colon's name behind a type."""
        typed, self.typed = self.typed, None
        first = self._name_before(op.start())
        if op["op"] == "=" and typed and _TYPE.fullmatch(self.text, typed[1], op.start()):
            return [typed[0]]
        if first is None:
            return []
        names, start = [first[0]], first[1]
        while op["op"] == "=" and self.text[start - 1:start] in (",", " ") and start > self.floor:
            comma = start
            while comma > self.floor and self.text[comma - 1] in " \t":
                comma -= 1
            more = self._name_before(comma - 1) if self.text[comma - 1:comma] == "," and comma > self.floor else None
            if more is None:
                break
            names.insert(0, more[0])
            start = more[1]
        self.start = start
        return names

    def _within(self, name: str) -> str:
        """A name that only says "value", with the name around it."""
        words = _WORDS.findall(name)
        if not words or words[-1].lower() not in _VALUE_NAMES:
            return name
        around = next((n for n in reversed(self.braces) if n), "") or next((n for _, n in reversed(self.outer)), "")
        return f"{around}.{name}" if around else name

    # the right-hand side

    def _operator(self, op: re.Match) -> int:
        text = self.text
        self.start = op.start()
        names = self._names(op)
        cut = text.rfind("\n", self.floor, self.start)
        if cut >= 0:
            self.line = cut + 1
        if not names:
            return op.end()
        at = _BLANK.match(text, op.end()).end()
        if op["op"] == ":":
            lead = text[self.line:self.start] if self.start - self.line < 200 else "x"
            indent = self.start - self.line if not lead.strip(" \t-") else -1
            while self.outer and 0 <= indent <= self.outer[-1][0]:
                self.outer.pop()
            if at == len(text) or text[at] in "\r\n":
                if indent >= 0:
                    self.outer.append((indent, names[0]))
                return at
            self.typed = names[0], op.end()
        if text[at:at + 1] == "{":
            self.braces.append(names[0])
            return at + 1
        names = [self._within(n) for n in names]
        groups, refs, at = self._value(at)
        if len(names) > 1:
            while len(groups) < len(names) and text[(comma := _BLANK.match(text, at).end()):comma + 1] == ",":
                more, further, at = self._value(_BLANK.match(text, comma + 1).end())
                groups += more or [[]]
                refs += further
            if len(groups) == len(names):
                self.found += [(n, _whole(g), []) for n, g in zip(names, groups, strict=True)]
                return at
        self.found.append((names[-1], [x for g in groups for x in _whole(g)], refs))
        return at

    def _value(self, at: int) -> tuple[list[list[Literal]], list[str], int]:
        """Literals, those of one value together, names, and where the expression ends."""
        groups: list[list[Literal]] = []
        refs: list[str] = []
        group: list[Literal] = []
        while True:
            at, lists = self._part(at, group, refs)
            groups += lists
            after = _BLANK.match(self.text, at).end()
            if self.text.startswith("..", after):
                at = _BLANK.match(self.text, after + 2).end()
            elif self.text[after:after + 1] == "+":
                at = _BLANK.match(self.text, after + 1).end()
            elif group and _STRING.match(self.text, after):
                at = after  # strings side by side
            else:
                return ([group] if group else []) + groups, refs, at

    def _part(self, at: int, group: list[Literal], refs: list[str]) -> tuple[int, list[list[Literal]]]:
        text = self.text
        if (m := _STRING.match(text, at)) is not None:
            if (joined := _JOIN.match(text, m.end())) is not None:
                lists, at = self._list(joined.end(), refs)
                group += [x for g in lists for x in g]
                return min(at + 1, len(text)), []
            self._string(m, group, refs)
            return m.end(), []
        if text[at:at + 1] in ("(", "["):
            lists, at = self._list(at, refs)
            if len(lists) == 1:
                group += lists[0]
                return at, []
            return at, lists
        if (m := _REF.match(text, at)) is not None:
            plain = m["ref"].strip("${}")
            refs.append(plain)
            # what names a secret is a name, not its value
            if not sensitivity(plain):
                group.append(Literal(m.start("ref"), m.end("ref"), m["ref"], is_name=True))
            return m.end(), []
        if (m := _BARE.match(text, at)) is not None:
            called = text[m.end():m.end() + 1] == "(" or _EXPRESSION.match(m[0])
            if not called:
                group.append(Literal(m.start(), m.end(), m[0]))
            return m.end(), []
        return at, []

    @staticmethod
    def _string(m: re.Match, group: list[Literal], refs: list[str]) -> None:
        kind = next(k for k in ("dq3", "sq3", "dq", "sq", "bq") if m[k] is not None)
        value = m[kind]
        if kind == "bq" or "f" in m["prefix"].lower():  # names in holes are names, not text
            refs.extend(_HOLE.findall(value))
            value = _HOLE.sub("", value)
        if value:
            group.append(Literal(*m.span(kind), value))

    def _list(self, at: int, refs: list[str]) -> tuple[list[list[Literal]], int]:
        """The strings of a list, tuple or parenthesis, those without a comma between together."""
        text, groups, group = self.text, [], []
        at += 1
        while True:
            at = _BLANKS.match(text, at).end()
            if (m := _STRING.match(text, at)) is not None:
                self._string(m, group, refs)
                at = m.end()
            elif text[at:at + 1] == "+":
                at += 1
            elif text[at:at + 1] == ",":
                groups.append(group)
                group, at = [], at + 1
            else:  # the end, or something that is no string
                return [g for g in (*groups, group) if g], at + (text[at:at + 1] in (")", "]") and at < len(text))


def _whole(group: list[Literal]) -> list[Literal]:
    """The parts of one value, each judged by the whole of it; beside strings a name is a name."""
    group = [x for x in group if not x.is_name] or group
    if len(group) < 2:
        return group
    value = "".join(x.value for x in group)
    return [Literal(x.start, x.end, value) for x in group]


def lexed_spans(text: str) -> list[Span]:
    """Literals that reach a sensitive name, themselves or through other names."""
    if not _HINT.search(text):
        return []
    found = assignments(text)
    # the assignment that a name stands for, and which ones each takes up
    held: dict[str, int] = {}
    taken = []
    for i, (name, _, refs) in enumerate(found):
        taken.append([held[ref] for ref in refs if ref in held])
        held[name] = i
    # from the last back, so that each has met all it flows into; of equals the first name counts
    weights = [(sensitivity(name), name) for name, _, _ in found]
    best: dict[tuple[int, int], Span] = {}
    for i in range(len(found) - 1, -1, -1):
        weight, name = weights[i]
        if not weight:
            continue
        for earlier in taken[i]:
            own = sensitivity(found[earlier][0])
            if weight > own and weight >= weights[earlier][0]:
                weights[earlier] = weight, name
        for x in found[i][1]:
            score, place = secrecy(weight, x.value), (x.start, x.end)
            if score >= SCORE_LEAST and (place not in best or best[place].score <= round(score, 4)):
                best[place] = Span("literal", *place, name=name, score=round(score, 4))
    return sorted(best.values(), key=_order)


def find_spans(text: str | None) -> list[Span]:
    """Base spans and, where no base span covers them already, lexed literals."""
    text = text or ""
    base = base_spans(text)
    more, at, covered = [], 0, 0
    for s in lexed_spans(text):  # by start, like the base spans
        while at < len(base) and base[at].start <= s.start:
            covered, at = max(covered, base[at].end), at + 1
        if s.end > covered:
            more.append(s)
    return sorted([*base, *more], key=_order)


_SPAN_TYPE = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("name", T.StringType()),
    T.StructField("score", T.DoubleType()),
]))


def secret_spans(text: Column) -> Column:
    """``array<struct<kind, start, end, name, score>>`` by start; null and empty: empty."""

    @F.pandas_udf(_SPAN_TYPE)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([[vars(s) for s in find_spans(t)] for t in batch])

    return run(text_or_empty(text))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key and ``secrets``, the spans in order of start.

    Null and empty texts have none; whole texts are scanned; rows may repeat.
    """
    return docs.select(F.col(key).alias(key), secret_spans(F.col(text)).alias("secrets"))


def redacted(text: str | None, spans: list[Span], mask: str = "*") -> str | None:
    """``text`` with every character inside a span replaced."""
    if text is None:
        return None
    out = list(text)
    for s in spans:
        out[s.start:s.end] = mask * (s.end - s.start)
    return "".join(out)


def span_text(secrets: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest_columns(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda s: s["kind"] != "literal")
    return found.select(
        key, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"),
        count("literal").alias("n_literal"),
    )
