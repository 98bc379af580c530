"""Near-duplicate components by SimHash fingerprints and an index of their bytes.

A fingerprint has 64 bits, the majorities of the hashes of a text's three-word shingles.
Its eight bytes, each with its position, are terms of an inverted index. Two fingerprints
that differ in at most three bits share at least five positional bytes, so of the first or
of the last four positions they share at least three: it is enough to read the index where
three lists of one half meet. There are eight such meetings a fingerprint. Each pair in a
meeting gets its shared positional bytes tallied over all eight positions; those that
reach five are verified by the bits that differ.

A meeting of more than ``MEETING`` fingerprints is met again with two more positions, in
ten ways, since a pair needs two more of the other five. Then five bytes are fixed and
three are free: a list of that kind holds at most 2**24 fingerprints whatever the corpus,
and a large one is searched by flipping up to three of its free bits, a bounded number of
lookups per fingerprint. A list hands on a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphsweep.llm.common import staged, text_or_empty
from glyphsweep.llm.components import components

SHINGLE, SEED = 3, 42
BITS, BYTES = 64, 8
#: Bits that linked fingerprints may differ in; positional bytes that they share at least.
DIFFER = 3
SHARED = BYTES - DIFFER
#: Fingerprints of a meeting of three lists that are tallied with each other; larger ones
#: are met with two more lists.
MEETING = 2000
#: A list that fixes five bytes is searched by flipped bits from this size on.
FLIPS_FROM = 6000
_CHUNK = 64
#: The meetings: a half of the positions with one left out.
TRIPLES = [c for half in (range(0, 4), range(4, 8)) for c in combinations(half, 3)]


def words(text: str) -> list[bytes]:
    """Words as bytes; A-Z become a-z, white space is a space or one of 09 to 0D."""
    return text.encode("utf-8", "replace").lower().split()


def fingerprint(text: str) -> int:
    """The unsigned fingerprint; zero for a text without words."""
    found = words(text)
    if not found:
        return 0
    if len(found) < SHINGLE:
        whole = [b" ".join(found)]
    else:
        whole = map(b" ".join, zip(found, found[1:], found[2:]))  # noqa: B905 - one list, shifted
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in whole], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.ascontiguousarray(hashes[at:at + (1 << 16)]).view(np.uint8).reshape(-1, BYTES)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


# --- links within one list ------------------------------------------------------------

def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    """The least index of each component of ``pairs``, an array of index pairs."""
    root = np.arange(n)
    while len(pairs):
        a, b = root[pairs[:, 0]], root[pairs[:, 1]]
        apart = a != b
        if not apart.any():
            break
        pairs, a, b = pairs[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(nearer := root[root], root):
            root = nearer
    return root


def tallied(prints: np.ndarray) -> np.ndarray:
    """Index pairs of ``prints`` that share enough positional bytes and pass by their bits."""
    found = []
    for at in range(0, len(prints), _CHUNK):
        rows = prints[at:at + _CHUNK]
        apart = rows[:, None] ^ prints[None, at:]
        tally = (apart.view(np.uint8).reshape(len(rows), -1, BYTES) == 0).sum(axis=2, dtype=np.uint8)
        i, j = np.nonzero(tally >= SHARED)
        good = (i < j) & (np.bitwise_count(apart[i, j]) <= DIFFER)
        found.append(np.stack([i[good] + at, j[good] + at], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def flipped(prints: np.ndarray) -> Iterator[np.ndarray]:
    """The same pairs in a list whose members agree in all but a few bytes, by flipping
    the free bits; one array of pairs for each set of flipped bits."""
    order = np.argsort(prints)
    ranked = prints[order]
    free = [i for i in range(BITS) if (int(np.bitwise_or.reduce(prints ^ prints[0])) >> i) & 1]
    for k in range(1, DIFFER + 1):
        for bits in combinations(free, k):
            other = ranked ^ np.uint64(sum(1 << b for b in bits))
            at = np.searchsorted(ranked, other)
            there = np.flatnonzero(ranked[np.minimum(at, len(ranked) - 1)] == other)
            there = there[there < at[there]]
            yield np.stack([order[there], order[at[there]]], axis=1)


def forest(prints: np.ndarray) -> np.ndarray:
    """``member, root`` for the members of a list that are linked to its earlier ones."""
    if len(prints) < FLIPS_FROM:
        root = _roots(len(prints), tallied(prints))
    else:
        root = np.arange(len(prints))
        for pairs in flipped(prints):
            if len(pairs):
                seen = root[pairs]
                joined = _roots(len(prints), seen[seen[:, 0] != seen[:, 1]])
                root = joined[root]
    linked = np.flatnonzero(root != np.arange(len(prints)))
    return np.stack([prints[linked], prints[root[linked]]], axis=1)


# --- Spark ----------------------------------------------------------------------------

def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.array([fingerprint(t.as_py()) for t in batch.column(1)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["key", "print"])


def _list_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of lists whose rows, sorted by list, follow each other over batches."""
    held_list, held = None, []

    def links() -> Iterator[pa.RecordBatch]:
        pairs = forest(np.concatenate(held).view(np.uint64)).view(np.int64)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        lists, prints = (np.asarray(batch.column(i)) for i in (0, 1))
        cuts = [0, *(np.flatnonzero(lists[1:] != lists[:-1]) + 1).tolist(), len(lists)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if held and lists[lo] != held_list:
                yield from links()
                held = []
            held_list = lists[lo]
            held.append(prints[lo:hi])
    if held:
        yield from links()


def _byte(position: int) -> Column:
    return F.shiftrightunsigned("print", 8 * position).bitwiseAND(0xFF)


def _meeting(positions: tuple[int, ...], number: int) -> Column:
    """One number for the list: which positions meet, and their bytes."""
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


def _links(postings: DataFrame) -> DataFrame:
    return postings.select("list", "print").repartition("list").sortWithinPartitions("list").mapInArrow(
        _list_links, "a long, b long")


def linked_prints(prints: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all of the distinct values of the stored column
    ``print`` that differ in at most three bits."""
    met = F.explode(F.array(*(F.struct(F.lit(i).alias("triple"), _meeting(t, i).alias("list")) for i, t in enumerate(TRIPLES))))
    postings = staged(prints.select("print", met.alias("m")).select("print", "m.triple", "m.list"), "postings")
    sizes = staged(postings.groupBy("list").agg(F.count("*").alias("size")).where("size > 1"), "lists")
    small = postings.join(sizes.where(F.col("size") <= MEETING), "list")
    large = postings.join(sizes.where(F.col("size") > MEETING), "list", "left_semi")
    # the meeting's own three positions and two of the other five; a set of five positions
    # is numbered by its bits, so that meetings which lead to the same list share it
    fives = []
    for i, triple in enumerate(TRIPLES):
        five = [tuple(sorted((*triple, *two))) for two in combinations([p for p in range(BYTES) if p not in triple], 2)]
        fives.append(F.when(F.col("triple") == i, F.array(*(_meeting(f, sum(1 << p for p in f)) for f in five))))
    finer = large.select("print", F.explode(F.coalesce(*fives)).alias("list")).distinct()
    return _links(small).unionByName(_links(finer))


def near_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the key, ``fingerprint`` (16 hexadecimal digits),
    ``component_id`` (the smallest key reachable over links).

    Texts without words, null and empty ones too, have fingerprint zero and are linked
    like any other. Rows without key are documents too; a component of such rows alone
    has a null id. Rows that share a key are each linked by their own text. Other columns
    are not looked at; an empty table gives an empty result.
    """
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("key"), text_or_empty(F.col(text)).alias("text"))
    rows = staged(named.mapInArrow(_fingerprints, f"key {kind}, print long"), "fingerprints")
    prints = staged(rows.groupBy("print").agg(F.min("key").alias("least")), "prints")
    roots = components(staged(linked_prints(prints), "print-links"), "a", "b")
    rooted = staged(prints.join(roots, F.col("print") == F.col("node"), "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")), "rooted")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.join(ids, "root").select("print", "component_id")
    return rows.join(of, "print").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
