"""Hidden characters in bytes that are not UTF-8, unit by unit as a decoder reads them."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphsweep.functions import hidden as H
from glyphsweep.functions import raw
from glyphsweep.operators import text as ops
from glyphsweep.rules import CharRule, hidden_rules
from tests import brute

OPTIONS = [{}, {"typography": True}, {"keep_zwj": True, "keep_variation_selectors": True}]
PARTS = [b"a", b" ", b"\n", "é".encode(), "中".encode(), "😀".encode(), "﻿".encode(), *(bytes([x]) for x in range(0x80, 0x100)),
         b"\xe2\x80", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xc0\xaf", b"\xe0\x80\x8b", b"\xf4\x90\x80\x80"]


def contents(n, seed):
    rnd = random.Random(seed)
    marks = [ch.encode() for ch in brute.lookup(typography=True)]
    made = [b"".join(rnd.choice(marks if rnd.random() < 0.3 else PARTS) for _ in range(rnd.choice([0, 1, 2, 3, 8, 60]))) for _ in range(n)]
    return [*made, b"", b"plain", b"\xff" * 9, "﻿".encode() * 2 + b"\xff", b"\xff" + "﻿".encode()]


@pytest.mark.parametrize("opts", OPTIONS, ids=str)
def test_against_plain_decoding(spark, opts):
    given = contents(400, len(opts))
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(given)], "id int, b binary")
    cleaned = ops.with_findings(ops.clean_text(df, "b", **opts), "b", **opts).select(
        "*", H.contains_hidden_bytes("b", **opts).alias("c"), H.find_hidden_bytes_array("b", **opts).alias("f"),
        H.strip_hidden(F.col("b").cast("string"), **opts).cast("binary").alias("by_text"),
        H.count_hidden(F.col("b").cast("string"), **opts).alias("n"),
        H.first_hidden_position(F.col("b").cast("string"), **opts).alias("at"),
        H.strip_hidden_bytes(H.strip_hidden_bytes("b", **opts), **opts).alias("twice"))
    for r in cleaned.collect():
        content = bytes(r.b)
        want = brute.find_in_bytes(content, **opts)
        assert [tuple(x) for x in r.findings] == [tuple(x) for x in r.f] == want, content
        assert bytes(r.cleaned) == bytes(r.by_text) == brute.strip_bytes(content, **opts), content
        assert r.changed == r.c == bool(want) == (content != bytes(r.cleaned)) and r.n == len(want)
        if not brute.find_in_bytes(bytes(r.cleaned), **opts):
            assert bytes(r.twice) == bytes(r.cleaned)
        firsts = [k for k, (at, *_) in enumerate(brute.units(content), 1) if want and at == want[0][2]]
        assert r.at == (firsts[0] if want else 0)
    flat = sorted(tuple(r) for r in ops.find_hidden(df, "id", "b", **opts).collect())
    assert flat == sorted((i, *f) for i, c in enumerate(given) for f in brute.find_in_bytes(c, **opts))
    assert flat == sorted(tuple(r) for r in ops.running_positions(df, "id", "b", **opts).collect())


def test_units_are_what_a_decoder_reads():
    unit = re.compile(raw.UNIT.removeprefix("(?s)"), re.DOTALL)
    for content in [*contents(300, 9), bytes(range(256)), *(chr(c).encode() for c in range(0x20, 0x11000, 37) if not 0xD800 <= c < 0xE000)]:
        assert [m[0].encode("latin-1") for m in unit.finditer(content.decode("latin-1"))] == [u for _, u, _ in brute.units(content)]


def test_units_are_counted_without_matching_ascii(spark):
    given = [*contents(300, 9), bytes(range(256)), "a\u00e9\u4e2d\U0001f600".encode() + b"\xc3a\xa9\xe2\x80"]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(given)], "id int, b binary")
    counted = df.selectExpr("id", f"{raw.text_sql('b')} AS t").selectExpr("id", f"{raw.units_sql('t')} AS n").collect()
    assert {r.id: r.n for r in counted} == {i: len(list(brute.units(c))) for i, c in enumerate(given)}
    assert raw.hidden_bytes(hidden_rules()).startswith("(?=[")  # most bytes meet one class, not every alternative


def test_byte_patterns_match_the_ranges_alone():
    ranges = [r for rule in hidden_rules(typography=True) for r in rule.ranges]
    pattern = re.compile("|".join(raw.byte_sequences(ranges)))
    table = brute.lookup(typography=True)
    for cp in (*range(0x80, 0xD800), *range(0xE000, 0x11000), *range(0xDFFFF, 0xE0300)):
        assert bool(pattern.fullmatch(chr(cp).encode().decode("latin-1"))) == (chr(cp) in table), hex(cp)


def test_user_characters_and_nulls(spark):
    extra = (CharRule("user", ((0x61, 0x61), (0x7F0, 0x810)), "<>"),)
    df = spark.createDataFrame([(1, bytearray(b"\xffa" + "߿ࠀ".encode() + b"b")), (2, None)], "id int, b binary")
    rows = ops.with_findings(ops.clean_text(df, "b", extra=extra), "b", extra=extra).orderBy("id").collect()
    assert bytes(rows[0].cleaned) == b"\xff<><><>b" and [f.offset for f in rows[0].findings] == [1, 2, 4]
    assert (rows[1].cleaned, rows[1].changed, rows[1].findings) == (None, None, None)


def test_long_stray_text(spark):
    content = (b"\xff\x80x" * 20000 + "​\n".encode()) * 3
    df = spark.createDataFrame([(1, bytearray(content))], "id int, b binary")
    assert [(r.offset, r.line, r.col) for r in ops.find_hidden(df, "id", "b").collect()] == [
        (60000, 1, 60001), (120004, 2, 60001), (180008, 3, 60001)]
