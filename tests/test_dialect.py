from __future__ import annotations

import re

import pytest

from glyphsweep.functions.dialect import char_class, java, line_search
from glyphsweep.rules import LineRule
from tests.brute import ascii_re

TEXTS = ["", "a", "-x", "a-x", "b-x", "éa", "aé", "a b", "ab", "e", "fe", "e_", "e.", "1", "12", "1a", "\u017F", "K", "SS",
         "a\u000bb", "a\tb", "x\ny", "[a]", "a\r", "*", "a.*b", "\u0130", "\u0131", "i"]
PATTERNS = [
    r"\ba?-x", r"e\b", r"\d\b", r"\ba", r"\ba\b", r"\b(a|b)\b", r"\be*\b", r"a\sb", r"[a\s]b", r"a$", r"s", r"k$",
    r"a.b", r"\[a\]", r"\b-", r"a{2}\b|1\b", r"ss", r"i",
]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_keep_their_meaning(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = {r.t for r in df.where(df.t.rlike("(?id)" + java(pattern))).collect()}
    assert got == {t for t in TEXTS if ascii_re(pattern).search(t)}


def test_char_class():
    assert char_class([(0x61, 0x61), (0x200B, 0x200D)]) == r"[\x{61}\x{200B}-\x{200D}]"
    assert re.fullmatch(r"\[.*\]", char_class([(1, 2)]))


def test_user_rules_are_not_rewritten(spark):
    # "a+" then "ab": only backtracking into the first part finds it.
    rule = LineRule("u", "user", r"a+.*ab")
    (pattern,) = line_search([rule])
    assert spark.createDataFrame([("aaab",)], "t string").where(f"t RLIKE '{pattern}'").count() == 1
    assert line_search([]) == []
