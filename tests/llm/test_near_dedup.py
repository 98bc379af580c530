from __future__ import annotations

import random
from collections import Counter

import numpy as np

from glyphsweep.llm import near_dedup as N


def bag(text: str | None) -> Counter:
    ws = N.words(text or "")
    if not ws:
        return Counter()
    n = min(5, len(ws))
    return Counter(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1))


def brute(texts: dict) -> dict:
    bags, root = {k: bag(t) for k, t in texts.items()}, {k: k for k in texts}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(texts)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            either = sum((bags[a] | bags[b]).values())
            if either and sum((bags[a] & bags[b]).values()) / either >= 0.8:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in texts}


def corpus() -> dict:
    rnd = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    texts = {}
    for g in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randint(3, 250))]
        for _ in range(rnd.randint(1, 12)):
            ws = list(base)
            for _ in range(rnd.randint(0, max(1, len(ws) // 30))):
                ws[rnd.randrange(len(ws))] = rnd.choice(words)
            texts[len(texts) * 3 + 1] = " ".join(ws)
    texts |= {9000: None, 9001: "", 9002: "!!", 9003: "a b", 9004: "A  b.", 9005: "the same " * 300, 9006: "the same " * 310,
              9007: "the same " * 600}
    return texts


def test_against_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in N.near_dedup(docs).collect()}
    assert got == brute(texts)


def test_signature_estimates_weighted_jaccard():
    rnd = np.random.default_rng(1)
    errors = []
    for _ in range(60):
        elements = rnd.integers(1, 2**63, 40, dtype=np.uint64)
        a, b = rnd.integers(1, 12, 40), rnd.integers(1, 12, 40)
        exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        errors.append((N.bag_min_hash(elements, a) == N.bag_min_hash(elements, b)).mean() - exact)
    assert abs(np.mean(errors)) < 0.02


def test_odd_tables(spark):
    rows = [(1, "one two three four five six", 1), (1, "one two three four five six", 2), (None, "one two three four five six", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int")
    got = sorted(map(tuple, N.near_dedup(docs).collect()), key=str)
    assert got == [(1, 1, 2, True), (1, 1, 2, True), (None, None, 1, True)]
    assert N.near_dedup(docs.limit(0)).count() == 0
    assert N.drop_near_copies(docs).columns == docs.columns


def test_one_key_with_many_texts(spark):
    """The texts of a key are one document, and near copies of each of them are found."""
    rnd = random.Random(6)

    def text():
        return " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "eta"]) + str(rnd.randrange(400)) for _ in range(60))

    a, b, c, d = (text() for _ in range(4))
    rows = [(1, a), (1, b), (2, a + " tail"), (3, b + " tail"), (4, c), (5, c + " end"), (5, d), (6, d + " end"), (7, text()), (7, None), (8, None)]
    rows += [(9, t) for t in (text() for _ in range(300))] + [(9, a + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS node", "2 AS name", "3 AS root")
    got = N.near_dedup(docs).collect()
    assert len(got) == len(rows)
    classes = {}
    for r in got:
        classes.setdefault(r["doc_id"], set()).add(r["class_id"])
    assert classes == {1: {1}, 2: {1}, 3: {1}, 4: {4}, 5: {4}, 6: {4}, 7: {7}, 8: {8}, 9: {1}}
    sizes = {r["class_id"]: r["class_size"] for r in got}
    assert sizes == {1: 305, 4: 4, 7: 2, 8: 1}
    assert sorted({r["doc_id"] for r in N.drop_near_copies(docs).collect()}) == [1, 4, 7, 8]
