"""Byte strings that may not be UTF-8, read the way a decoder reads them.

A well-formed sequence is one unit, and so is every byte that belongs to none. Java
replaces such bytes when it decodes them, several at once, so neither their values nor
their number survive in a string. Here a byte string is read as a text of one character
per byte (ISO 8859-1), and the rules' code points are looked for as their UTF-8 bytes.
Nothing can be missed or misread that way: a hit starts with a lead byte, which no
sequence before it can take in, so a decoder that reads unit by unit arrives at it.

The SQL texts are over ``t``, the value as BINARY.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from glyphsweep.functions.bind import sql_string
from glyphsweep.rules import BOM, CharRule

LATIN = "'ISO-8859-1'"
#: Code points by the length of their UTF-8 sequences.
_LENGTHS = ((0x0, 0x7F), (0x80, 0x7FF), (0x800, 0xFFFF), (0x10000, 0x10FFFF))
_SURROGATES = (0xD800, 0xDFFF)


def _byte(lo: int, hi: int) -> str:
    return rf"\x{lo:02X}" if lo == hi else rf"[\x{lo:02X}-\x{hi:02X}]"


def _between(lo: bytes, hi: bytes) -> list[list[tuple[int, int]]]:
    """Byte ranges, position by position, whose products are the strings from lo to hi.

    Both have one length; positions after the first differing one run over all
    continuation bytes but at the two ends.
    """
    if len(lo) == 1:
        return [[(lo[0], hi[0])]]
    if lo[0] == hi[0]:
        return [[(lo[0], lo[0]), *rest] for rest in _between(lo[1:], hi[1:])]
    least, most = b"\x80" * (len(lo) - 1), b"\xbf" * (len(lo) - 1)
    found, first, last = [], lo[0], hi[0]
    if lo[1:] != least:
        found += [[(first, first), *rest] for rest in _between(lo[1:], most)]
        first += 1
    tail = []
    if hi[1:] != most:
        tail = [[(last, last), *rest] for rest in _between(least, hi[1:])]
        last -= 1
    if first <= last:
        found.append([(first, last), *[(0x80, 0xBF)] * (len(lo) - 1)])
    return found + tail


def byte_sequences(ranges: Iterable[tuple[int, int]]) -> list[str]:
    """Regexes over bytes that together match the UTF-8 forms of the code points."""
    patterns = []
    for lo, hi in sorted(set(ranges)):
        for first, last in _LENGTHS:
            for a, b in ((max(lo, first), min(hi, last, _SURROGATES[0] - 1)), (max(lo, first, _SURROGATES[1] + 1), min(hi, last))):
                if a <= b:
                    for sequence in _between(chr(a).encode(), chr(b).encode()):
                        patterns.append("".join(_byte(*r) for r in sequence))
    return list(dict.fromkeys(patterns))


def hidden_bytes(rules: Iterable[CharRule], lead: str = "") -> str:
    """One match per character the rules cover, a leading byte-order mark excepted."""
    ranges = [r for rule in rules for r in rule.ranges]
    if not ranges:
        return r"(?!)"
    sequences = byte_sequences(ranges)
    # one class decides at most bytes that none of the sequences begins here
    firsts = "".join(dict.fromkeys(re.match(r"\[[^]]*\]|\\x..", x)[0].strip("[]") for x in sequences))
    body = f"(?=[{firsts}])(?:{'|'.join(sequences)})"
    has_bom = any(lo <= BOM <= hi for lo, hi in ranges)
    return body + (rf"(?<!\A{lead}\xEF\xBB\xBF)" if has_bom else "")


#: One decoded unit: a well-formed sequence (no overlong one, no surrogate) or a single byte.
UNIT = "(?s)(?:" + "|".join(byte_sequences([(0x0, 0x10FFFF)])) + "|.)"


#: The same for units that begin with a byte beyond ASCII.
_HIGH_UNIT = "(?=[\\x80-\\xFF])(?:" + "|".join(byte_sequences([(0x80, 0x10FFFF)])) + "|[\\x80-\\xFF])"


def units_sql(text: str) -> str:
    """SQL text for the number of decoded units of a text of one character per byte.

    Characters beyond ASCII take two bytes there, so those of ASCII, each a unit, are
    counted by lengths and only the others are matched.
    """
    return (f"CASE WHEN octet_length({text}) = char_length({text}) THEN char_length({text}) ELSE "
            f"2 * char_length({text}) - octet_length({text}) + regexp_count({text}, {sql_string(_HIGH_UNIT)}) END")


def text_sql(t: str = "t") -> str:
    """SQL text for the bytes as one character each."""
    return f"decode({t}, {LATIN})"


def bytes_sql(text: str) -> str:
    """SQL text for the bytes of a text of one character each."""
    return f"encode({text}, {LATIN})"


def unit_size_sql(piece: str) -> str:
    """SQL text for the bytes of the well-formed unit that ``piece`` starts with."""
    lead = f"ascii({piece})"
    return f"(CASE WHEN {lead} >= 240 THEN 4 WHEN {lead} >= 224 THEN 3 WHEN {lead} >= 192 THEN 2 ELSE 1 END)"


def rune_sql(piece: str) -> str:
    """SQL text for the code point of the well-formed unit that ``piece`` starts with."""
    head = bytes_sql(f"substr({piece}, 1, {unit_size_sql(piece)})")
    return f"ascii(decode({head}, 'UTF-8'))"
