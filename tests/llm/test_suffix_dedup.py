from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from glyphsweep.llm import suffix_dedup as S


def brute(texts: list[str | None], length: int) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    windows = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        covered = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if windows[d[i:i + length]] > 1:
                covered[i:i + length] = b"\1" * length
        runs = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        kept = bytes(b for b, c in zip(d, covered, strict=True) if not c)
        out.append((len(d), sum(covered), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed: int) -> list[str | None]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = prose(120)
    texts: list[str | None] = [prose(rnd.randint(1, 400)) for _ in range(20)]
    texts += [texts[0], texts[1], texts[1]]
    for _ in range(12):
        ws = texts[2].split(" ")
        for _ in range(rnd.randint(1, 3)):
            ws[rnd.randrange(len(ws))] = rnd.choice(words)
        texts.append(" ".join(ws))
        cut = rnd.randint(0, 30)
        texts.append(prose(rnd.randint(0, 40)) + passage[cut:len(passage) - rnd.randint(0, 90)] + prose(rnd.randint(0, 40)))
    texts += [None, "", "a" * 199, "ab" * 150, "b" * 700, "x" + "b" * 450, passage + passage, "é" * 120]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    texts = corpus(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in S.suffix_dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, S.LENGTH)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "z" * 250, 5, "q")], "doc_id long, text string, id int, hash string")
    assert [r["n_removed"] for r in S.suffix_dedup(docs).collect()] == [250]
    assert S.suffix_dedup(docs.limit(0)).count() == 0


def test_trie_and_quicksort_sort():
    rnd = random.Random(5)
    strings = ["".join(rnd.choice("ab") for _ in range(rnd.randint(0, 60))).encode() for _ in range(400)]
    strings += [b"a" * 80, b"a" * 80, b"a" * 90]
    ranks = S.order_of(strings)
    placed = sorted(range(len(strings)), key=ranks.__getitem__)
    assert [strings[i] for i in placed] == sorted(strings)
