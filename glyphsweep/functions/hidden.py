"""Hidden-character functions: ``Column -> Column``, built-in expressions only.

Every function takes the same options (``typography``, ``keep_zwj``,
``keep_variation_selectors``, ``extra``) and derives its regex from the same rules,
so a text has findings exactly when it contains hidden characters, and exactly then
stripping changes it. All of them are stateless per row and work on streams.

Texts that are not UTF-8 are read as a decoder reads them: a byte that belongs to no
sequence is one unit, stays what it is and counts as one in columns. ``*_bytes``
functions take BINARY and give it back.

``*_sql`` give the SQL text of a function over the value named ``t``.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphsweep.functions import raw
from glyphsweep.functions.bind import as_column, sql_let, sql_over, sql_string
from glyphsweep.functions.dialect import char_class, hidden_class
from glyphsweep.rules import (
    HIDDEN_RULES,
    UNKNOWN_CATEGORY,
    CharRule,
    hidden_rules,
    typography_rules,
)

FINDINGS_TYPE = (
    "array<struct<rune:int,u:string,offset:bigint,line:bigint,col:bigint,category:string>>"
)

# Ranges up to this long are compared as listed code points, longer ones by bounds.
_LISTED = 32



def is_ascii(c: Column | str) -> Column:
    """Whether the text holds ASCII only; such a text has no hidden character."""
    c = as_column(c)
    return F.octet_length(c) == F.char_length(c)


def is_binary(c: Column | str) -> Column:
    """Whether a BINARY column is not text: it has a NUL byte or is not valid UTF-8."""
    c = as_column(c)
    return F.contains(c, F.lit(bytearray(b"\0"))) | ~F.is_valid_utf8(c.cast("string"))


def _ascii_is_clean(rules: Iterable[CharRule]) -> bool:
    return all(lo >= 0x80 for rule in rules for lo, _ in rule.ranges)


def contains_hidden(c: Column | str, **opts) -> Column:
    """Whether the text has any hidden character; stops at the first one."""
    c = as_column(c)
    rules = hidden_rules(**opts)
    hit = c.rlike(hidden_class(rules))
    return ~is_ascii(c) & hit if _ascii_is_clean(rules) else hit


def contains_hidden_sql(**opts) -> str:
    rules = hidden_rules(**opts)
    hit = f"t RLIKE {sql_string(hidden_class(rules))}"
    return f"(octet_length(t) <> char_length(t) AND {hit})" if _ascii_is_clean(rules) else hit


def strip_hidden(c: Column | str, **opts) -> Column:
    """The text with hidden characters deleted or folded to plain ones."""
    c = as_column(c)
    return F.when(contains_hidden(c, **opts), sql_over(c, _rewrite_any_sql(**opts))).otherwise(c)


def strip_hidden_sql(**opts) -> str:
    return f"CASE WHEN {contains_hidden_sql(**opts)} THEN {_rewrite_any_sql(**opts)} ELSE t END"


def contains_hidden_bytes(c: Column | str, **opts) -> Column:
    """``contains_hidden`` of a BINARY column, UTF-8 or not."""
    return contains_hidden(as_column(c).cast("string"), **opts)


def strip_hidden_bytes(c: Column | str, **opts) -> Column:
    """``strip_hidden`` of a BINARY column; bytes that are not UTF-8 stay as they are."""
    c = as_column(c)
    return F.when(contains_hidden_bytes(c, **opts), strip_hidden(c.cast("string"), **opts).cast("binary")).otherwise(c)


def _pieces_sql(rules: Iterable[CharRule]) -> str:
    """``t`` cut before each hit: every piece but the first starts with its hit.

    A letter is put in front, so that the first piece is never cut off by a hit at the
    very start, and every piece has a first character to drop.
    """
    before_hit = sql_string(f"(?={hidden_class(rules, lead='x')})")
    return f"split(concat('x', t), {before_hit})"


def _byte_pieces_sql(rules: Iterable[CharRule]) -> str:
    """The same for a text that is not UTF-8; the pieces have one character per byte."""
    before_hit = sql_string(f"(?={raw.hidden_bytes(rules, lead='x')})")
    return f"split(concat('x', {raw.text_sql('CAST(t AS BINARY)')}), {before_hit})"


def _rewrite_any_sql(**opts) -> str:
    return f"CASE WHEN is_valid_utf8(t) THEN {_rewrite_sql(**opts)} ELSE {_rewrite_sql(as_bytes=True, **opts)} END"


def _rewrite_sql(as_bytes: bool = False, **opts) -> str:
    # One pass cuts the text, whatever the number of rules, and the hits are those of
    # the input: a byte-order mark that only comes to lead by a deletion still goes.
    rules = hidden_rules(**opts)
    folds: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for rule in rules:
        if rule.replacement:
            folds[rule.replacement].extend(rule.ranges)
    rune = raw.rune_sql("piece") if as_bytes else "ascii(piece)"
    cases = " ".join(
        f"WHEN {_in_ranges(rune, ranges)} THEN {sql_string(fold)}" for fold, ranges in folds.items()
    )
    fold = f"CASE WHEN i = 0 THEN '' {cases} ELSE '' END"
    if not as_bytes:
        rejoined = f"transform({_pieces_sql(rules)}, (piece, i) -> concat({fold}, substr(piece, 2)))"
        return f"array_join({rejoined}, '')"
    kept = f"substr(piece, CASE WHEN i = 0 THEN 2 ELSE {raw.unit_size_sql('piece')} + 1 END)"
    rejoined = f"transform({_byte_pieces_sql(rules)}, (piece, i) -> concat({fold}, {kept}))"
    joined = f"array_join({rejoined}, '')"
    return f"CAST({raw.bytes_sql(joined)} AS STRING)"


def _in_ranges(cp: str, ranges: Iterable[tuple[int, int]]) -> str:
    points = [str(p) for lo, hi in ranges if hi - lo < _LISTED for p in range(lo, hi + 1)]
    spans = [f"{cp} BETWEEN {lo} AND {hi}" for lo, hi in ranges if hi - lo >= _LISTED]
    return " OR ".join([*([f"{cp} IN ({', '.join(points)})"] if points else []), *spans])


def count_hidden(c: Column | str, **opts) -> Column:
    """How many hidden characters the text has."""
    c = as_column(c)
    rules = hidden_rules(**opts)
    n = F.regexp_count(c, F.lit(hidden_class(rules)))
    return F.when(is_ascii(c), F.lit(0)).otherwise(n) if _ascii_is_clean(rules) else n


def count_hidden_sql(**opts) -> str:
    return f"regexp_count(t, {sql_string(hidden_class(hidden_rules(**opts)))})"


def first_hidden(c: Column | str, **opts) -> Column:
    """The first hidden character of the text, null if there is none."""
    return F.regexp_substr(as_column(c), F.lit(hidden_class(hidden_rules(**opts))))


def first_hidden_position(c: Column | str, **opts) -> Column:
    """1-based character position of the first hidden character, 0 if there is none."""
    c = as_column(c)
    # regexp_instr counts UTF-16 units, so measure the text ahead of the hit instead.
    rules = hidden_rules(**opts)
    ahead = F.get(F.split(c, hidden_class(rules), 2), F.lit(0))
    ahead_bytes = sql_over(c, f"split({raw.text_sql('CAST(t AS BINARY)')}, {sql_string(raw.hidden_bytes(rules))}, 2)[0]")
    units = F.when(F.is_valid_utf8(c), F.char_length(ahead)).otherwise(sql_over(ahead_bytes, raw.units_sql("t")))
    return F.when(contains_hidden(c, **opts), units + 1).otherwise(F.char_length(c) * 0)


def hidden_hits(c: Column | str, **opts) -> Column:
    """All hidden characters of the text in order, as an array of one-character strings."""
    return F.regexp_extract_all(
        as_column(c), F.lit(hidden_class(hidden_rules(**opts))), F.lit(0)
    )


def codepoint(ch: Column | str) -> Column:
    """The code point of a one-character string."""
    return F.ascii(as_column(ch))


def u_plus(ch: Column | str) -> Column:
    """``U+200B`` style text for a one-character string."""
    return sql_over(codepoint(ch), u_plus_sql("t"))


def _ranges_by_category(extra: Iterable[CharRule]) -> dict[str, list[tuple[int, int]]]:
    ranges: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for rule in (*HIDDEN_RULES, *typography_rules(), *extra):
        ranges[rule.category].extend(rule.ranges)
    return ranges


def category_classes(extra: Iterable[CharRule] = ()) -> dict[str, str]:
    """A regex class per category; a character belongs to the first that covers it."""
    classes, taken = {}, []
    for category, ranges in _ranges_by_category(extra).items():
        own = char_class(ranges)
        overlaps = any(a <= hi and lo <= b for lo, hi in ranges for a, b in taken)
        classes[category] = f"[{own}&&[^{char_class(taken)[1:-1]}]]" if overlaps else own
        taken += ranges
    return classes


def category_sql(cp: str, extra: Iterable[CharRule] = ()) -> str:
    """SQL text for the category label of the code point ``cp``."""
    cases = " ".join(
        f"WHEN {_in_ranges(cp, sorted(pairs))} THEN {sql_string(category)}"
        for category, pairs in _ranges_by_category(extra).items()
    )
    return f"CASE {cases} ELSE {sql_string(UNKNOWN_CATEGORY)} END"


def category_of_codepoint(cp: Column | str, extra: Iterable[CharRule] = ()) -> Column:
    """The category label of a code point, ``unknown`` when no rule covers it."""
    return sql_over(cp, category_sql("t", extra))


def category_of(ch: Column | str, extra: Iterable[CharRule] = ()) -> Column:
    """The category label of a one-character string."""
    return category_of_codepoint(codepoint(ch), extra)


# --- Positions ---------------------------------------------------------------------


def _measures_sql(rules: Iterable[CharRule]) -> str:
    measure = """CASE WHEN contains(piece, '\\n') THEN named_struct(
        'rune', ascii(p[i + 1]),
        'bytes', CAST(octet_length(piece) AS BIGINT),
        'lines', CAST(octet_length(piece) - octet_length(replace(piece, '\\n', '')) AS BIGINT),
        'chars', CAST(char_length(substring_index(piece, '\\n', -1)) AS BIGINT))
      ELSE named_struct(
        'rune', ascii(p[i + 1]),
        'bytes', CAST(octet_length(piece) AS BIGINT),
        'lines', 0L,
        'chars', CAST(char_length(piece) AS BIGINT)) END"""
    ahead = "slice(p, 1, size(p) - 1)"
    return sql_let(_pieces_sql(rules), "p", f"transform({ahead}, (piece, i) -> {measure})")


def _byte_measures_sql(rules: Iterable[CharRule]) -> str:
    """The measures of a text that is not UTF-8; columns count its units."""
    last_line = "substring_index(piece, '\\n', -1)"
    measure = f"""named_struct(
        'rune', {raw.rune_sql("p[i + 1]")},
        'bytes', CAST(char_length(piece) AS BIGINT),
        'lines', CAST(char_length(piece) - char_length(replace(piece, '\\n', '')) AS BIGINT),
        'chars', CAST({raw.units_sql(last_line)} AS BIGINT))"""
    ahead = "slice(p, 1, size(p) - 1)"
    return sql_let(_byte_pieces_sql(rules), "p", f"transform({ahead}, (piece, i) -> {measure})")


def pieces(c: Column | str, **opts) -> Column:
    """The text cut in front of every hit.

    The first piece has a letter put in front, so its measures have one byte and, on
    the first line, one character too many. The pieces of a text that is not UTF-8 have
    one character per byte.
    """
    rules = hidden_rules(**opts)
    return sql_over(c, f"CASE WHEN is_valid_utf8(t) THEN {_pieces_sql(rules)} ELSE {_byte_pieces_sql(rules)} END")


def _measures_any_sql(rules: Iterable[CharRule]) -> str:
    return f"CASE WHEN is_valid_utf8(t) THEN {_measures_sql(rules)} ELSE {_byte_measures_sql(rules)} END"


def _running_sql(measures: str) -> str:
    """Running totals along an array of measures.

    A doubling scan: after pass k every element covers the 2^k measures up to it, so n
    hits need log2(n) linear passes.
    """

    def combined(before: str) -> str:
        return f"""named_struct(
          'rune', x.rune,
          'bytes', {before}.bytes + x.bytes,
          'lines', {before}.lines + x.lines,
          'chars', CASE WHEN x.lines > 0 THEN x.chars ELSE {before}.chars + x.chars END)"""

    one_pass = (
        "transform(acc, (x, i) -> CASE WHEN i >= shiftleft(1, k) "
        f"THEN {combined('acc[i - shiftleft(1, k)]')} ELSE x END)"
    )
    passes = "sequence(0, char_length(bin(size(m) - 1)) - 1)"
    return sql_let(
        measures, "m",
        f"CASE WHEN size(m) < 2 THEN m ELSE aggregate({passes}, m, (acc, k) -> {one_pass}) END",
    )


def u_plus_sql(cp: str) -> str:
    return f"concat('U+', CASE WHEN {cp} > 65535 THEN hex({cp}) ELSE lpad(hex({cp}), 4, '0') END)"


def find_hidden_sql(**opts) -> str:
    rules = hidden_rules(**opts)
    # Byte 0 and, on the first line, character 1 are those of the letter put in front.
    finding = f"""named_struct(
        'rune', f.rune, 'u', {u_plus_sql("f.rune")}, 'offset', f.bytes - 1,
        'line', f.lines + 1, 'col', CASE WHEN f.lines = 0 THEN f.chars ELSE f.chars + 1 END,
        'category', {category_sql("f.rune", opts.get("extra", ()))})"""
    return f"transform({_running_sql(_measures_any_sql(rules))}, f -> {finding})"


def find_hidden_array(c: Column | str, **opts) -> Column:
    """All findings of the text in order: rune, u, byte offset, line, column, category.

    Offsets are 0-based bytes; lines count line feeds only and, like columns, which
    count code points, start at 1. The array is empty for a clean text.
    """
    return sql_over(c, find_hidden_sql(**opts))


def find_hidden_bytes_array(c: Column | str, **opts) -> Column:
    """``find_hidden_array`` of a BINARY column, UTF-8 or not."""
    return find_hidden_array(as_column(c).cast("string"), **opts)


def format_finding(
    path: Column | str, line: Column | str, col: Column | str,
    category: Column | str, rune: Column | str,
) -> Column:
    """``path:line:col: category U+XXXX``, the report line of one finding."""
    return F.format_string(
        "%s:%d:%d: %s U+%04X",
        as_column(path).cast("string"), as_column(line), as_column(col),
        as_column(category), as_column(rune),
    )
