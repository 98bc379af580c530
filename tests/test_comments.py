from __future__ import annotations

import random

from pyspark.sql import functions as F

from glyphsweep.functions import comments as C
from glyphsweep.operators import files as ops
from glyphsweep.rules import LineRule
from tests import brute
from workload.expected import SOURCE_STYLES

STYLE_OF = {ext: style for style, ends in SOURCE_STYLES.items() for ext in ends}
#: One comment text for each token rule, and some that only look like one.
MARKED = ["claude", "Anthropic", "at claude.ai", "claude.com", "anthropic.com", "CODEX", "chatgpt", "OpenAI", "openai.com",
          "chatgpt.com", "ai-assisted", "AI  created", "powered by AI", "built with codex", "generated by", "Assisted with"]
UNMARKED = ["plain", "claudette", "said aid", "generated", "by the way", "codexes", ""]
OPENINGS = [("//", ""), ("#", ""), ("/*", "*/"), ('"""', '"""'), ("<!--", "-->"), ("/*", "")]
#: Where a comment stands: ``{0}`` is the comment.
PLACES = ["{0}", "{0}\n", "a\n{0}\nb\n", "a\n\t {0}\nb\n", "a = 1 {0}\nb\n", "a {0} b {0}\n", 's = "{0}"\nb\n', "s = '{0}' {0}\n",
          "s = `{0}`\n", "\n\n{0}\n\n\n{0}\n\nb", "a{0}{0}\n \n", "\\{0}\n", "\u3000{0}\nb\r\n{0}\r\n"]


def sources():
    for start, end in OPENINGS:
        for text in [*MARKED, *UNMARKED]:
            for body in {text, f"one\n{text}\n  three"} if end else {text}:
                yield from (place.format(f"{start} {body} {end}".rstrip(" ")) for place in PLACES)


def test_every_style_place_and_token(spark):
    texts = sorted(set(sources()))
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    one_of_each = {style: F.lit(ends[-1]) for style, ends in SOURCE_STYLES.items()}
    rows = df.select("t", *[C.clean_comments("t", e).alias(style) for style, e in one_of_each.items()],
                     C.clean_comments("t", F.lit(".txt")).alias("other")).collect()
    changed = dict.fromkeys(SOURCE_STYLES, 0)
    for r in rows:
        assert r.other == r.t
        for style in SOURCE_STYLES:
            assert r[style] == brute.without_comments(r.t, style), (style, r.t)
            changed[style] += r[style] != r.t
    assert min(changed.values()) > 100


def test_every_extension_has_its_style(spark):
    text = "\n".join(f"v{i} {start} by codex {end}" for i, (start, end) in enumerate(OPENINGS[:5])) + "\n"
    ends = [*STYLE_OF, ".txt", "", ".kt"]
    df = spark.createDataFrame([(e,) for e in ends], "ext string")
    got = {r.ext: r.c for r in df.select("ext", C.clean_comments(F.lit(text), "ext").alias("c")).collect()}
    assert got == {e: brute.without_comments(text, STYLE_OF[e]) if e in STYLE_OF else text for e in ends}


def random_sources(n, seed):
    rng = random.Random(seed)
    parts = ["/*", "*/", "//", "#", '"""', "<!--", "-->", "claude", " by ", "generated", "AI", "x", "\n", "\n", "\n",
             " ", "\t", '"', "'", "`", "\\", "/", "*", "-", "\u3000", "é", "\r", "word "]
    return ["".join(rng.choices(parts, k=rng.randint(0, 45))) for _ in range(n)]


def test_against_brute_force(spark):
    texts = random_sources(2500, seed=9)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    styles = {"go": ".go", "ts": ".ts", "py": ".py", "rb": ".rb"}
    rows = df.select(
        "t", *[C.clean_comments("t", F.lit(e)).alias(n) for n, e in styles.items()],
        C.strip_blocks("t", "/*", "*/").alias("b"), C.strip_blocks("t", '"""', '"""').alias("d"),
        C.strip_blocks("t", "<!--", "-->").alias("h"), C.strip_line_comments("t", "//").alias("l"),
        C.strip_line_comments("t", "#").alias("s"), C.collapse_blank_lines("t").alias("c"),
        C.has_ai_token("t").alias("a"), C.trim_trailing("t").alias("w"),
    ).collect()
    edited = 0
    for r in rows:
        for name in styles:
            assert r[name] == brute.without_comments(r.t, name), (name, r.t)
            edited += r[name] != r.t
        assert r.b == brute.without_blocks(r.t, "/*", "*/"), r.t
        assert r.d == brute.without_blocks(r.t, '"""', '"""'), r.t
        assert r.h == brute.without_blocks(r.t, "<!--", "-->"), r.t
        assert r.l == brute.without_line_comments(r.t, "//"), r.t
        assert r.s == brute.without_line_comments(r.t, "#"), r.t
        assert r.c == brute.collapsed(r.t), repr(r.t)
        assert r.a == brute.has_token(r.t)
        assert r.w == r.t.rstrip(" \t")
    assert edited > 300


def test_large_texts_neither_overflow_nor_crawl(spark):
    texts = [
        "/* open " * 30_000 + "// claude\n",
        "x" * 800_000 + " // claude\n",
        '"a" ' * 100_000 + "// claude\n",
        "\n" * 200_000 + "// claude\n",
        "/* claude */\n" * 20_000,
        "\\" * 200_000 + '" // claude\n',
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    got = {r.id: r.c for r in df.select("id", C.clean_comments("t", F.lit(".go")).alias("c")).collect()}
    assert got[0] == ("/* open " * 30_000).rstrip() + "\n"
    assert got[1] == "x" * 800_000 + "\n"
    assert got[2] == ('"a" ' * 100_000).rstrip() + "\n"
    assert got[3] == ""
    assert got[4] == ""
    assert got[5] == texts[5]


def test_user_tokens(spark):
    df = spark.createDataFrame([("x // TODO remove\ny // claude\nz // by codex\n",)], "t string")
    extra = [LineRule("todo", "user", r"\btodo\b")]
    row = df.select(C.clean_comments("t", F.lit(".go"), extra=extra, exclude=["token-1"])).first()
    assert row[0] == "x\ny // claude\nz\n"


def test_files_that_are_not_utf8(spark):
    rows = [("r", "a.py", None, bytearray(b"s = 1 # by claude \xff\nt = '\xfe'\n")),
            ("r", "vendor/b.py", None, bytearray(b"# claude\n")), ("r", "c.md", None, bytearray(b"# claude\n"))]
    df = spark.createDataFrame(rows, "repo string, path string, mode int, content binary")
    got = {r.path: (bytes(r.cleaned), r.changed) for r in ops.clean_comment_files(df).collect()}
    assert got == {"a.py": (b"s = 1\nt = '\xfe'\n", True)}
