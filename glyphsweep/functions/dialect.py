"""Regex text for Spark (Java) from the rule data.

The rule patterns are written in RE2 syntax. Java reads some of it differently
(``\\b``, ``.``, ``\\s``, ``$`` and case folding), so those parts are spelled out.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from glyphsweep.rules import BLANK_RANGES, BOM, CharRule, LineRule

# A word boundary over ASCII word characters only.
_WORD = "[0-9A-Za-z_]"
_BOUNDARY = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"
_SPACE = r"\t\n\f\r "
# Letters whose simple case folding leaves ASCII.
_FOLDS = {"s": r"[s\x{17F}]", "k": r"[k\x{212A}]"}
_TOKEN = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\.\*|.", re.DOTALL)


def char_class(ranges: Iterable[tuple[int, int]]) -> str:
    """``[...]`` for inclusive code-point ranges; valid in Java and in RE2."""
    parts = (
        rf"\x{{{lo:X}}}" if lo == hi else rf"\x{{{lo:X}}}-\x{{{hi:X}}}"
        for lo, hi in sorted(set(ranges))
    )
    return f"[{''.join(parts)}]"


def blank_class() -> str:
    return char_class(BLANK_RANGES)


def hidden_class(rules: Iterable[CharRule], lead: str = "") -> str:
    """One match per character the rules cover, a leading byte-order mark excepted.

    The intersection lets Java reject everything below the first covered code point,
    ASCII above all, with a single comparison. ``lead`` is what was put in front of the
    text.
    """
    ranges = [r for rule in rules for r in rule.ranges]
    if not ranges:
        return r"(?!)"
    lowest = min(lo for lo, _ in ranges)
    body = rf"[[\x{{{lowest:X}}}-\x{{10FFFF}}]&&{char_class(ranges)}]"
    has_bom = any(lo <= BOM <= hi for lo, hi in ranges)
    return body + (rf"(?<!\A{lead}\x{{{BOM:X}}})" if has_bom else "")


def _boundary(before: str, after: str, then: str) -> str:
    """``\\b`` between two tokens, cheaper where one of them is a plain word character."""
    if len(after) == 1 and re.match(_WORD, after) and then[:1] not in ("*", "?", "{"):
        return f"(?<!{_WORD})"
    if len(before) == 1 and re.match(_WORD, before):
        return f"(?!{_WORD})"
    return _BOUNDARY


def java(pattern: str) -> str:
    """A case-insensitive RE2 pattern in Java syntax (without the flags)."""
    tokens = _TOKEN.findall(pattern)
    padded = ["", *tokens, "", ""]
    out = []
    for i, token in enumerate(tokens, start=1):
        if token == r"\b":
            out.append(_boundary(padded[i - 1], padded[i + 1], padded[i + 2]))
        elif token == r"\s":
            out.append(f"[{_SPACE}]")
        elif token == "$":
            out.append(r"\z")
        elif token.startswith("["):
            out.append(token.replace(r"\s", _SPACE))
        else:
            out.append(_FOLDS.get(token.lower(), token))
    return "".join(out)


def _core(pattern: str) -> str:
    """The pattern without a leading or trailing ``.*``, which no search needs."""
    core = pattern.removeprefix(".*")
    return core[:-2] if core.endswith(".*") and not core.endswith(r"\.*") else core


def line_search(rules: Iterable[LineRule], trusted: Iterable[LineRule] = ()) -> list[str]:
    """Java regexes of which at least one finds any line that one of ``rules`` matches.

    ``A.*B`` in a built-in (``trusted``) rule becomes "the first A of the line, then B":
    no built-in A can match later yet end earlier, so nothing is lost, and a long line
    with many As is scanned once instead of once for each A.
    """
    known = set(trusted)
    floating, anchored = [], []
    for rule in rules:
        core = _core(rule.regex)
        head, gap, tail = core.partition(".*")
        if rule in known and gap:
            anchored.append(f"(?>.*?{java(head)}).*{java(tail)}")
        else:
            floating.append(java(core))
    found = []
    if floating:
        found.append("(?id)" + "|".join(f"(?:{p})" for p in floating))
    if anchored:
        found.append("(?idm)^(?:" + "|".join(f"(?:{p})" for p in anchored) + ")")
    return found


def search_any(rules: Iterable[LineRule]) -> str:
    """One Java regex that finds any of ``rules`` in a text."""
    return "(?id)" + "|".join(f"(?:{java(r.regex)})" for r in rules) if rules else r"(?!)"

