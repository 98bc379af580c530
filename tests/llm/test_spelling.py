from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

from glyphsweep.llm import spelling as S


def brute(rows):
    counts = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 6:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= 5}
    near, gaps = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            short = w[:i] + w[i + 1:]
            if short in n:
                near[w].add(short)
                near[short].add(w)
            gaps[i, short].add(w)
    for group in gaps.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        if near[w]:
            best = min(near[w], key=lambda x: (-n[x], x))
            if n[best] >= 5 * n[w]:
                form[w] = best
    out = set()
    for w in n:
        last = w
        while last in form:
            last = form[last]
        out.add((w, form.get(w), last, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def found(spark, rows, **extra):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in extra.items():
        docs = docs.selectExpr("*", f"'{value}' AS `{name}`")
    got = [tuple(r) for r in S.variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    assert len(got) == len(set(got))
    return set(got)


def near_words(rnd, base, letters):
    w = rnd.choice(base)
    i, kind = rnd.randrange(len(w)), rnd.randrange(4)
    if kind == 0:
        return w[:i] + w[i + 1:]
    if kind == 1:
        return w[:i] + rnd.choice(letters) + w[i:]
    return w[:i] + rnd.choice(letters) + w[i + 1:] if kind == 2 else w


def test_against_brute_force(spark):
    rnd = random.Random(5)
    letters = "abczéÿ×Z"
    base = ["".join(rnd.choice(letters) for _ in range(rnd.randint(5, 11))) for _ in range(60)]
    many = [w for w in base for _ in range(rnd.randint(1, 40))]
    rows = [(i, " ".join(near_words(rnd, many, letters) for _ in range(60)) + "-") for i in range(250)]
    want = brute(rows)
    assert sum(w[1] is not None for w in want) > 20 and any(w[1] not in (None, w[2]) for w in want)
    assert found(spark, rows) == want


def test_chains_ties_repeats_and_equal_letters(spark):
    texts = {"aaaaaa": 700, "aaaaaaa": 140, "aaaaaaaa": 28, "aaaaaaaaa": 5, "abcdef": 50, "abcdeg": 50, "abcdeh": 10,
             "xbcdef": 4, "prefix": 5, "prefixes": 30}
    rows = [(1, " ".join([w] * n)) for w, n in texts.items()] + [(None, "stringy " * 7), (None, "stringy"), (1, None), (2, "")]
    want = brute(rows)
    assert {(w, root) for w, _, root, *_ in want} >= {("aaaaaaaaa", "aaaaaa"), ("abcdeh", "abcdef"), ("prefix", "prefix")}
    assert found(spark, rows) == want


def test_long_words_and_clashing_columns(spark):
    word = "".join(random.Random(1).choice("abcdefgh") for _ in range(5000))
    rows = [(i, f"{word} {word[:4000] + word[4001:]} {word[:-1]} q{word}") for i in range(6)]
    got = found(spark, rows, word="x", n="y", id="z", node="v", letter="u")
    assert got == brute(rows) and {len(w) for w, *_ in got} == {4999, 5000, 5001}


def test_empty_table(spark):
    assert found(spark, []) == set() and found(spark, [(1, "short w")]) == set()
