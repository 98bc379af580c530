from __future__ import annotations

import random

import numpy as np
import xxhash

from glyphsweep.llm import simhash as S


def plain_fingerprint(text):
    ws = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or "")).translate(
        {c: " " for c in range(9, 14)}).split(" ") if w]
    if not ws:
        return 0
    runs = [" ".join(ws[i:i + 3]) for i in range(len(ws) - 2)] if len(ws) >= 3 else [" ".join(ws)]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(keys, prints):
    root = list(range(len(keys)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [least.get(find(i)) for i in range(len(keys))]


def corpus():
    rnd = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(30):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 400))]
        for _ in range(rnd.randint(1, 8)):
            ws = list(base)
            for _ in range(rnd.randint(0, 2)):
                ws[rnd.randrange(len(ws))] = rnd.choice(vocabulary)
            rows.append((len(rows) * 7 + 3, rnd.choice([" ", "\t ", "\x0b\n"]).join(ws)))
    odd = [None, "", " \t", "One", "one two", "ONE  two", "Été a b c", "x y z " * 20000]
    return rows + [(2000 + i, t) for i, t in enumerate(odd)] + [(None, "one"), (None, "lonely words"), (2003, "one two")]


def test_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS print", "'x' AS root", "'y' AS key")
    prints = [plain_fingerprint(t) for _, t in rows]
    want = sorted(zip((k for k, _ in rows), (f"{p:016x}" for p in prints), least_reachable([k for k, _ in rows], prints), strict=True), key=str)
    assert sum(p == 0 for p in prints) >= 3 and len(set(prints)) < len(prints)
    got = sorted((tuple(r) for r in S.near_components(docs).select("doc_id", "fingerprint", "component_id").collect()), key=str)
    assert got == want


def clustered(n, seed=1):
    """Prints around few centres, and a dense block whose five upper bytes agree."""
    rnd = np.random.default_rng(seed)
    centres = rnd.integers(0, 2**63, 12, dtype=np.uint64)
    flips = [np.bitwise_xor.reduce([np.uint64(1) << np.uint64(b) for b in rnd.integers(0, 64, rnd.integers(1, 9))]) for _ in range(n)]
    loose = centres[rnd.integers(0, 12, n)] ^ np.array(flips, np.uint64)
    dense = (centres[0] & ~np.uint64(2**24 - 1)) | rnd.integers(0, 2**24, n, dtype=np.uint64)
    return np.unique(np.concatenate([loose, dense]))


def classes(prints, pairs):
    at = {int(p): i for i, p in enumerate(prints)}
    return S._roots(len(prints), np.array([[at[int(a)], at[int(b)]] for a, b in pairs]).reshape(-1, 2))


def test_index_links_what_all_pairs_link(spark, monkeypatch):
    prints = clustered(700)
    i, j = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3, 1))
    want = S._roots(len(prints), np.stack([i, j], axis=1))
    table = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long").repartition(5)
    for meeting in (2000, 20, 1):  # the last meets nearly all lists again with five positions
        monkeypatch.setattr(S, "MEETING", meeting)
        links = [(r["a"] % 2**64, r["b"] % 2**64) for r in S.linked_prints(table).collect()]
        assert np.array_equal(classes(prints, links), want)
        assert len(links) < 8 * 10 * len(prints)


def test_flipped_bits_find_the_tallied_links(monkeypatch):
    prints = clustered(900, 3)
    upper, counts = np.unique(prints >> np.uint64(24), return_counts=True)
    block = prints[prints >> np.uint64(24) == upper[counts.argmax()]]
    assert len(block) > 800
    want = S._roots(len(block), S.tallied(block))
    monkeypatch.setattr(S, "FLIPS_FROM", 2)
    assert np.array_equal(classes(block, S.forest(block)), want)


def test_one_large_group_and_empty_table(spark):
    rows = [(i, "the same few words here") for i in range(3000)] + [(5000, "others entirely in this text")]
    got = S.near_components(spark.createDataFrame(rows, "doc_id long, text string")).groupBy("component_id").count().collect()
    assert {(r[0], r[1]) for r in got} == {(0, 3000), (5000, 1)}
    assert S.near_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []
