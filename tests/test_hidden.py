from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from glyphsweep.functions import hidden as H
from glyphsweep.functions.bind import sql_over
from glyphsweep.operators import text as ops
from glyphsweep.rules import CATEGORIES, HIDDEN_RULES, CharRule, hidden_rules
from tests import brute

BOM = "\uFEFF"
OPTIONS = [
    {},
    {"typography": True},
    {"keep_zwj": True},
    {"keep_variation_selectors": True},
    {"typography": True, "keep_zwj": True, "keep_variation_selectors": True},
]
BOTH = {"keep_zwj": True, "keep_variation_selectors": True}

#: Both ends of every range, by category, and what takes their place.
RANGE_ENDS = {
    "exotic-space": ("\u00A0\u1680\u2000\u200A\u202F\u205F\u3000", " "),
    "separator": ("\u2028\u2029", "\n"),
    "zero-width": ("\u00AD\u034F\u115F\u1160\u17B4\u17B5\u180E\u200B\u200C\u200D\u2060\u3164\uFEFF\uFFA0\uFFF9\uFFFB", ""),
    "bidi-control": ("\u061C\u200E\u200F\u202A\u202E\u2066\u206F", ""),
    "tag-block": ("\U000E0000\U000E007F", ""),
    "variation-selector": ("\uFE00\uFE0F\U000E0100\U000E01EF", ""),
    "invisible-math": ("\u2061\u2064", ""),
}
FOLDED = {"\u2013": "-", "\u2014": "--", "\u2015": "--", "\u2018": "'", "\u201B": "'", "\u201C": '"', "\u201F": '"',
          "\u2026": "...", "\u2032": "'", "\u2033": '"', "\u2212": "-"}
#: Neighbours of the ranges that stay.
OUTSIDE = "\u009F\u00A1\u200A\u2010\u202F\u2065\u2070\u180B\u180D\uFDFF\uFE10\U000E0080\U000E00FF\U000E01F0\u0085\u2800"
SHAPES = ("{0}kl", "k{0}l", "kl{0}", "{0}", "k{0}{0}l", "\u00F1{0} \u4E2D{0}")


def strip_grid(opts):
    """Every range end at every place, with what these options leave."""
    marks = [(ch, new, c) for c, (chars, new) in RANGE_ENDS.items() for ch in chars]
    marks += [(ch, new, "typography") for ch, new in FOLDED.items()]
    for ch, new, category in marks:
        stays = (category == "typography" and not opts.get("typography")
                 or category == "variation-selector" and opts.get("keep_variation_selectors")
                 or ch == "\u200D" and opts.get("keep_zwj"))
        for shape in SHAPES:
            text, want = shape.format(ch), shape.format(ch if stays else new)
            yield text, (BOM + want if text.startswith(BOM) else want)
    for text in ("", "plain\tlines\r\n", *(f"p{ch}q" for ch in OUTSIDE if ch not in "\u200A\u202F")):
        yield text, text
    yield BOM + BOM + "t", BOM + "t"
    yield "\u2060" + BOM + "t", "t"


def random_texts(n, seed):
    rng = random.Random(seed)
    hidden = list(brute.lookup(typography=True))
    plain = list("ab \n\t\r") + ["é", "你", "\U0001f600", "\n", BOM, "\u0085", "\u2065"]
    return [
        "".join(rng.choice(hidden if rng.random() < 0.3 else plain) for _ in range(rng.choice([0, 1, 5, 40, 300])))
        for _ in range(n)
    ]


@pytest.mark.parametrize("opts", OPTIONS + [BOTH], ids=str)
def test_strip_grid(spark, opts):
    cases = dict(strip_grid(opts))
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    rows = ops.clean_text(df, "t", **opts).collect()
    assert {r.t: (r.cleaned, r.changed) for r in rows} == {t: (want, want != t) for t, want in cases.items()}


@pytest.mark.parametrize("opts", OPTIONS, ids=str)
def test_everything_agrees_with_brute_force(spark, opts):
    texts = random_texts(250, seed=len(str(opts))) + [t for t, _ in strip_grid(opts)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    rows = df.select(
        "id", "t",
        H.strip_hidden("t", **opts).alias("s"), H.contains_hidden("t", **opts).alias("c"),
        H.count_hidden("t", **opts).alias("n"), H.find_hidden_array("t", **opts).alias("f"),
        H.first_hidden("t", **opts).alias("first"),
        H.first_hidden_position("t", **opts).alias("at"),
        H.strip_hidden(H.strip_hidden("t", **opts), **opts).alias("twice"),
        sql_over("t", H.strip_hidden_sql(**opts)).alias("sql_s"),
        sql_over("t", H.contains_hidden_sql(**opts)).alias("sql_c"),
    ).collect()
    for r in rows:
        found = brute.find(r.t, **opts)
        assert [tuple(x) for x in r.f] == found, repr(r.t)
        assert r.s == r.sql_s == brute.strip(r.t, **opts)
        assert r.c == r.sql_c == (r.s != r.t) == bool(found)
        assert r.n == len(found)
        assert r.first == (chr(found[0][0]) if found else None)
        leading = [i + 1 for i, ch in enumerate(r.t) if found and ch == chr(found[0][0])]
        if found and found[0][0] != 0xFEFF:
            assert r.at == leading[0]
        assert r.twice == r.s
    flat = sorted(map(tuple, ops.find_hidden(df, "id", "t", **opts).collect()))
    assert flat == sorted((r.id, *x) for r in rows for x in r.f)
    assert flat == sorted(map(tuple, ops.running_positions(df, "id", "t", **opts).collect()))
    relabelled = ops.categorize(ops.find_hidden(df, "id", "t", **opts))
    assert flat == sorted(map(tuple, relabelled.collect()))


def test_long_runs_of_hits(spark):
    text = ("a\u200B" * 700 + "\n") * 3 + "\u202E" * 900
    df = spark.createDataFrame([(1, text)], "id int, t string")
    assert [tuple(x) for x in df.select(H.find_hidden_array("t").alias("f")).first().f] == brute.find(text)


def test_positions(spark):
    text = "\u00E9t\u00E9\n\u20ACuro\u2064s\n\n\uFFF9z"
    df = spark.createDataFrame([(1, text), (2, "one\ntwo three\u2067 four\n")], "id int, t string")
    rows = ops.find_hidden(df, "id", "t", ordered=True).collect()
    assert [(r.id, r.rune, r.offset, r.line, r.col, r.category) for r in rows] == [
        (1, 0x2064, 12, 2, 5, "invisible-math"),
        (1, 0xFFF9, 18, 4, 1, "zero-width"),
        (2, 0x2067, 13, 2, 10, "bidi-control"),
    ]
    report = ops.find_hidden(df.where("id = 2"), "id", "t").select(
        H.format_finding(F.lit("notes/b.txt"), "line", "col", "category", "rune")
    )
    assert report.first()[0] == "notes/b.txt:2:10: bidi-control U+2067"


def test_every_code_point_has_its_category(spark):
    rows = spark.range(0x110000).where("NOT id BETWEEN 55296 AND 57343").select(
        "id", H.category_of_codepoint(F.col("id").cast("int")).alias("category")
    ).where("category <> 'unknown'").collect()
    table = {ord(ch): category for ch, (category, _) in brute.lookup(typography=True).items()}
    assert {r.id: r.category for r in rows} == table
    assert set(table.values()) == set(CATEGORIES)
    sizes = {rule.category: sum(hi - lo + 1 for lo, hi in rule.ranges) for rule in HIDDEN_RULES}
    assert sizes == {
        "zero-width": 17, "bidi-control": 18, "tag-block": 128, "variation-selector": 256,
        "invisible-math": 4, "exotic-space": 16, "separator": 2,
    }


def test_category_and_code_point_of_characters(spark):
    df = spark.createDataFrame([("\u200B",), ("\U000e0041",), ("a",)], "ch string")
    got = df.select(H.category_of("ch"), H.codepoint("ch"), H.u_plus("ch")).collect()
    assert [tuple(r) for r in got] == [
        ("zero-width", 0x200B, "U+200B"), ("tag-block", 0xE0041, "U+E0041"), ("unknown", 97, "U+0061"),
    ]


def test_binary(spark):
    cases = [(b"a\0b", True), ("héllo \u2014 world".encode(), False), (b"\xff\xfeA", True),
             (b"", False), (b"hello", False), (b"\xe2\x80", True)]
    df = spark.createDataFrame([(i, bytearray(c)) for i, (c, _) in enumerate(cases)], "id int, b binary")
    got = {r.id: r.x for r in df.select("id", H.is_binary("b").alias("x")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_null_and_clean_texts(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "café")], "id int, t string")
    rows = ops.with_findings(ops.clean_text(df, "t"), "t").orderBy("id").collect()
    assert [(r.cleaned, r.changed, r.findings) for r in rows] == [
        (None, None, None), ("", False, []), ("café", False, []),
    ]
    assert ops.find_hidden(df, "id", "t").count() == 0


def test_user_characters(spark):
    extra = (CharRule("user", ((0x61, 0x61), (0x78, 0x78)), "[$1\\]"), CharRule("dropped", ((0x4E00, 0x9FFF),)))
    df = spark.createDataFrame([("xax一b\u200B",)], "t string")
    row = df.select(
        H.strip_hidden("t", extra=extra).alias("s"), H.count_hidden("t", extra=extra).alias("n"),
        H.find_hidden_array("t", extra=extra).alias("f"),
    ).first()
    assert row.s == "[$1\\]" * 3 + "b" and row.n == 5
    assert [x.category for x in row.f] == ["user", "user", "user", "dropped", "zero-width"]
    overlapping = (*extra, CharRule("late", ((0x61, 0x62), (0x200B, 0x200B))))
    counts = {r.category: r.n_hits for r in ops.profile_hidden(df, "t", extra=overlapping).collect()}
    assert counts == {"user": 3, "dropped": 1, "zero-width": 1, "late": 1}
    assert len(hidden_rules(extra=extra)) == len(HIDDEN_RULES) + 2


def profile_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_profile(spark):
    texts = random_texts(120, seed=3)
    rows = [(i, f"s{i % 3}" if i % 7 else None, i // 2, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, source string, pair int, t string")
    found = [(s, pair, i, f[5]) for i, s, pair, t in rows for f in brute.find(t)]

    def tally(group, doc):
        out = {}
        for s, pair, i, category in found:
            out.setdefault(group(s, category), []).append(doc(pair, i))
        return sorted(((*g, len(d), len(set(d))) for g, d in out.items()), key=str)

    by_row, by_pair = (lambda pair, i: i), (lambda pair, i: pair)
    assert profile_rows(ops.profile_hidden(df, "t", "source")) == tally(lambda s, c: (s, c), by_row)
    assert profile_rows(ops.profile_hidden(df, "t", "source", key="pair")) == tally(
        lambda s, c: (s, c), by_pair)
    for key, doc in ((None, by_row), ("pair", by_pair)):
        want = sorted(
            [(s, 0, c, n, d) for s, c, n, d in tally(lambda s, c: (s, c), doc)]
            + [(s, 1, None, n, d) for s, n, d in tally(lambda s, c: (s,), doc)]
            + [(None, 2, None, n, d) for n, d in tally(lambda s, c: (), doc)], key=str)
        assert profile_rows(ops.profile_hidden(df, "t", "source", key=key, rollup=True)) == want
    rates = {r.source: (r.n_rows, r.n_dirty) for r in ops.hidden_rate(df, "t", "source").collect()}
    dirty = {i for _, _, i, _ in found}
    assert rates == {
        s: (sum(r[1] == s for r in rows), sum(r[1] == s and r[0] in dirty for r in rows))
        for s in {r[1] for r in rows}
    }


def test_categorize_by_a_given_table(spark):
    ranges = spark.createDataFrame([(0x200B, 0x20FF, "mine"), (0xE0000, 0xE01EF, "far")],
                                   "lo int, hi int, category string")
    df = spark.createDataFrame([(0x200B,), (0x2100,), (0xE0100,), (None,)], "rune int")
    got = {r.rune: r.category for r in ops.categorize(df, ranges).collect()}
    assert got == {0x200B: "mine", 0x2100: "unknown", 0xE0100: "far", None: "unknown"}


def test_overlapping_ranges_are_cut(spark):
    rnd = random.Random(4)
    given = [(lo := rnd.randint(-50, 3000), lo + rnd.randint(-5, 700), rnd.choice("abcd"), rnd.choice([None, 1, 2])) for _ in range(60)]
    given += [(0x10FFF0, 0x200000, "end", 1), (None, 5, "x", 1), (5, None, "x", 1), (0xE0000, 0xE0FFF, "far", None)] * 2
    ranges = spark.createDataFrame(given, "lo int, hi int, category string, priority int")
    pieces = sorted((r.lo, r.hi, r.category) for r in ops.disjoint_ranges(ranges).collect())
    assert all(a[1] < b[0] for a, b in zip(pieces, pieces[1:], strict=False))
    known = [(lo, hi, c, p) for lo, hi, c, p in given if lo is not None and hi is not None]

    def best(cp):
        over = [(p is None, p or 0, hi - lo, lo, c) for lo, hi, c, p in known if lo <= cp <= hi]
        return min(over)[-1] if over else None

    of = {cp: c for lo, hi, c in pieces for cp in range(lo, hi + 1)}
    for cp in (*range(0, 4000), *range(0xE0000 - 3, 0xE1003), *range(0x10FFE0, 0x110000)):
        assert of.get(cp) == best(cp), hex(cp)
    plain = ops.disjoint_ranges(ranges.drop("priority").where("category = 'far'")).collect()
    assert {(r.lo, r.hi) for r in plain} == {(b * 256, b * 256 + 255) for b in range(0xE00, 0xE10)}
