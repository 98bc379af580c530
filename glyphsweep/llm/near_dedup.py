"""Near-duplicate classes by weighted-Jaccard signatures (BagMinHash).

A text is the multiset of its runs of ``SHINGLE`` words. Each shingle owns Poisson
processes over its possible counts, laid out hierarchically: counts (0,1], (1,2], (2,4],
(4,8] and so on, each with a rate of its width; a point falls into one unit of its
interval and counts if the shingle occurs that often. Points come in order of time, and
each falls into one of the signature's components, which keeps its earliest point. Two
texts agree in a component with the probability of their weighted Jaccard similarity. A
process ends as soon as its next point is later than all components.

Bands of components propose pairs. First every text is compared with the least of each of
its buckets; what is similar forms components. Then, among texts that buckets connect,
those outside the largest component are compared with the other components' texts, in
blocks of bounded size: by signature, with a margin of several standard deviations, and
what passes by overlap, until a component is reached. Only links leave a block. Every
link is decided by the multiset overlap of whole texts, and pairs within one component
are never looked at, so a group of copies costs about one comparison per copy.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsweep.llm.common import broadcast_measured, staged, text_or_empty
from glyphsweep.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
#: Bands of components. At a similarity of 0.8 a pair shares no band in 3 of 10,000 cases.
BANDS, ROWS = 27, 6
SIZE = BANDS * ROWS
#: Estimates so many standard deviations below the threshold are still compared exactly.
MARGIN = 4.0
#: Texts of one side of a block that a task compares with each other.
BLOCK = 500
#: Bytes of words, A-Z as a-z; all other ASCII stands between words.
_WORD_BYTES = bytes(ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))
_CACHE = 200_000
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.random.default_rng(2024).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < _CACHE:
            self[word] = found
        return found


_word_hashes = _WordHashes()


def _forgetting(rows: Iterator) -> Iterator:
    """``rows``; then the words are forgotten, since the process goes on to tasks of other stages."""
    try:
        yield from rows
    finally:
        _word_hashes.clear()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def words(text: str | bytes) -> list[bytes]:
    content = text.encode("utf-8", "replace") if isinstance(text, str) else text
    return content.translate(_WORD_BYTES).split()


def shingles(found: list[bytes], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts; fewer words than ``n`` are one shingle, no words are none."""
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = np.fromiter(map(_word_hashes.__getitem__, found), np.uint64, len(found))
    size = min(n, len(found))
    runs = len(found) - size + 1
    total = np.zeros(runs, np.uint64)
    for i in range(size):
        total += hashes[i:i + runs] * _ODD[i]
    return np.unique(_mixed(total + np.uint64(size)), return_counts=True)


def bag_min_hash(elements: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The signature as 16-bit values; two sets agree in a component as they are similar."""
    levels = np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64) + 1
    of = np.repeat(np.arange(len(elements)), levels)
    level = np.arange(len(of)) - np.repeat(np.cumsum(levels) - levels, levels)
    floor = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.maximum(floor, 1)
    seed = _mixed(elements[of] + level.astype(np.uint64) * _STEP)
    most = counts[of]
    time = np.zeros(len(of))
    best, winner = np.full(size, np.inf), np.zeros(size, np.uint64)
    active, step = np.arange(len(of)), 0
    while len(active):
        points = max(1, min(64, 2 * size // len(active)))
        counter = (np.arange(step, step + points, dtype=np.uint64) + np.uint64(1)) * _STEP
        first = _mixed(seed[active][:, None] ^ counter[None, :])
        wait = -np.log(((first >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / width[active][:, None]
        at = time[active][:, None] + np.cumsum(wait, axis=1)
        time[active] = at[:, -1]
        second = _mixed(first + _MIX1)
        unit = floor[active][:, None] + ((second & np.uint64(0xFFFFFFFF)).astype(np.int64) * width[active][:, None] >> 32)
        limit = best.max()
        good = (unit < most[active][:, None]) & (at < limit)
        when, point = at[good], second[good]
        place = ((point >> np.uint64(32)) % np.uint64(size)).astype(np.int64)
        order = np.argsort(-when, kind="stable")  # of points in one component the earliest is set last
        when, point, place = when[order], point[order], place[order]
        new, which = np.full(size, np.inf), np.zeros(size, np.uint64)
        new[place], which[place] = when, point
        better = new < best
        best[better], winner[better] = new[better], which[better]
        step += points
        active = active[time[active] < best.max()]
    return (_mixed(winner) >> np.uint64(48)).astype(np.uint16)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard: shared occurrences by occurrences in either; 0 for empty sets."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    either = int(a[1].sum() + b[1].sum()) - shared
    return shared / either if either else 0.0


def band_hashes(signature: np.ndarray) -> np.ndarray:
    rows = signature.reshape(BANDS, ROWS).astype(np.uint64)
    return _mixed((rows * _ODD[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _STEP).view(np.int64)


def _name(found: list[bytes]) -> bytes | None:
    """What texts of the same words have in common; none without words."""
    return hashlib.sha256(b" ".join(found)).digest()[:16] if found else None


# --- Spark ----------------------------------------------------------------------------

def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, signs = [], []
        for text in batch.column(1):
            found = words(text.as_py())
            names.append(_name(found))
            signs.append(bag_min_hash(*shingles(found)).tobytes() if found else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(names, pa.binary()), pa.array(signs, pa.binary())], names=["key", "name", "signature"])


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        bands = np.concatenate([band_hashes(np.frombuffer(s.as_py(), np.uint16)) for s in batch.column(1)])
        nodes = batch.column(0).take(pa.array(np.repeat(np.arange(n), BANDS)))
        yield pa.RecordBatch.from_arrays([pa.array(bands), nodes], names=["bucket", "node"])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()

    def bag(packed: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
        return shingles(words(expand.decompress(packed.as_py())))

    for batch in batches:
        found = [similarity(bag(a), bag(b)) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())],
                                         names=["a", "b", "similarity"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        names, packed = [], []
        for text in batch.column(0):
            content = text.as_py().encode("utf-8", "replace")
            names.append(_name(words(content)))
            packed.append(squeeze.compress(content))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(packed, pa.binary())], names=["name", "packed"])


def texts_of(needed: DataFrame, docs: DataFrame, key: str, text: str) -> DataFrame:
    """``node, packed``: a compressed text of each of the stored nodes (``node, name, key``).

    Their keys choose the rows, which are then told apart by what they say: a key may
    stand in many rows with different texts.
    """
    rows = docs.select(F.col(key).alias("key"), text_or_empty(F.col(text)).alias("text")).join(
        broadcast_measured(staged(needed.select("key").distinct(), "keys")), "key", "left_semi")
    packed = rows.select("text").mapInArrow(_packed, "name binary, packed binary")
    one_each = packed.join(broadcast_measured(needed.select("name", "node")), "name").groupBy("node").agg(F.first("packed").alias("packed"))
    return staged(one_each, "texts")


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, key: str, text: str, similar: float) -> DataFrame:
    """``a, b, similarity`` of those pairs whose whole texts overlap enough."""
    pairs = staged(pairs, "pairs")
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = texts_of(staged(nodes.join(asked, "node", "left_semi").select("node", "name", "key"), "needed"), docs, key, text)
    both = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("packed_a")), "a").join(
        texts.select(F.col("node").alias("b"), F.col("packed").alias("packed_b")), "b")
    found = both.select("a", "b", "packed_a", "packed_b").mapInArrow(lambda batches: _forgetting(_overlaps(batches)), "a long, b long, similarity double")
    return found.where(F.col("similarity") >= similar)


def _across(similar: float, least: float):
    """Links of a block between texts of different components, at most one per text and
    component: candidates by signature are decided by overlap, the closest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for _, rows in groupby(_records(batches), key=lambda r: r[:3]):
            outside, members = [], []
            for row in rows:
                (outside if row[3] else members).append(row[4:])
            if not outside or not members:
                continue
            bags: dict = {}

            def bag(row: tuple) -> tuple[np.ndarray, np.ndarray]:
                if row[0] not in bags:  # noqa: B023
                    bags[row[0]] = shingles(words(expand.decompress(row[3])))  # noqa: B023
                return bags[row[0]]  # noqa: B023

            numbers = {root: i for i, root in enumerate({r[1] for r in outside} | {r[1] for r in members})}
            signs = np.stack([np.frombuffer(m[2], np.uint16) for m in members])
            roots = np.array([numbers[m[1]] for m in members])
            links = []
            for row in outside:
                agree = (signs == np.frombuffer(row[2], np.uint16)).mean(axis=1)
                close = np.flatnonzero((agree >= least) & (roots != numbers[row[1]]))
                met: set[int] = set()
                for i in close[np.argsort(-agree[close], kind="stable")].tolist():
                    if roots[i] not in met and (value := similarity(bag(row), bag(members[i]))) >= similar:
                        met.add(roots[i])
                        links.append((min(row[0], members[i][0]), max(row[0], members[i][0]), value))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*links, strict=True)], names=["a", "b", "similarity"])

    return lambda batches: _forgetting(run(batches))


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def near_pairs(nodes: DataFrame, docs: DataFrame, key: str, text: str, similar: float) -> DataFrame:
    """Similar pairs that connect all similar texts; the stored ``nodes`` have ``node, name,
    key, signature``: a number, what tells the text from others, a key it stands under."""
    buckets = nodes.select("node", "signature").mapInArrow(_band_rows, "bucket long, node long")
    shared = staged(buckets.groupBy("bucket").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = staged(buckets.join(shared.select("bucket", "a"), "bucket"), "members")
    stars = members.where("node <> a").select("a", F.col("node").alias("b")).distinct()
    first = staged(verified(stars, nodes, docs, key, text, similar), "links")
    roots = staged(components(first, "a", "b"), "roots")

    # texts that buckets connect, similar or not; where such a cluster holds several
    # components, all but the largest are compared with the rest, block by block
    clusters = staged(components(stars, "a", "b"), "clusters")
    held = staged(clusters.select("node", F.col("root").alias("cluster")).join(roots, "node", "left").select(
        "cluster", "node", F.coalesce("root", "node").alias("root")), "held")
    sizes = held.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    mixed = sizes.groupBy("cluster").agg(F.max(F.struct("n", "root")).alias("top"), F.count("*").alias("roots"),
                                         F.sum("n").alias("members")).where("roots > 1")
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    parts = F.ceil((F.col("members") - F.col("top.n")) / BLOCK).cast("int")
    mixed = mixed.select("cluster", F.col("top.root").alias("largest"), blocks.alias("blocks"), parts.alias("parts"))
    open_nodes = staged(held.join(mixed, "cluster"), "open")
    needed = staged(nodes.join(open_nodes.select("node"), "node", "left_semi").select("node", "name", "key"), "needed")
    rows = open_nodes.join(texts_of(needed, docs, key, text), "node").join(nodes.select("node", "signature"), "node")
    place = F.xxhash64("node")
    inside = rows.select(
        "cluster", F.pmod(place, F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(False).alias("outside"),
        "node", "root", "signature", "packed")
    outside = rows.where(F.col("root") != F.col("largest")).select(
        "cluster", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
        F.pmod(place, F.col("parts")).cast("int").alias("part"), F.lit(True).alias("outside"),
        "node", "root", "signature", "packed")
    least = similar - MARGIN * float(np.sqrt(similar * (1 - similar) / SIZE))
    order = ["cluster", "block", "part"]
    across = inside.unionByName(outside).repartition(*order).sortWithinPartitions(*order).mapInArrow(
        _across(similar, least), "a long, b long, similarity double")
    return first.unionByName(across)


def near_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """One row per document: the key, ``class_id, class_size, kept``.

    Documents are in one class if similar pairs connect them; the class has the smallest
    key of its documents as id, and that document is kept. Texts with the same words are
    similar; fewer than five words are similar only to the same words. Texts without
    words (null and empty ones too) and rows without key are classes of their own. Rows
    that share a key are one document: their classes are one, and each is kept if one is.
    """
    kind = docs.schema[key].dataType.simpleString()
    named = docs.select(F.col(key).alias("key"), text_or_empty(F.col(text)).alias("text"))
    rows = staged(named.mapInArrow(lambda batches: _forgetting(_signatures(batches)), f"key {kind}, name binary, signature binary"), "signatures")
    worded = rows.where("name IS NOT NULL AND key IS NOT NULL")
    nodes = staged(worded.groupBy("name").agg(F.min(F.struct("key", "signature")).alias("least")).select(
        F.monotonically_increasing_id().alias("node"), "name", F.col("least.key").alias("key"),
        F.col("least.signature").alias("signature")), "nodes")
    similar_texts = near_pairs(nodes, docs, key, text, similar).select("a", "b")
    # the texts of one key are one document
    keyed = staged(worded.select("key", "name").join(nodes.select("name", "node"), "name").select("key", "node").distinct(), "keyed")
    several = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("key", "a")
    same_key = keyed.join(several, "key").select("a", F.col("node").alias("b")).where("a <> b")
    roots = staged(components(staged(similar_texts.unionByName(same_key).distinct(), "all-links"), "a", "b"), "classes")
    of_key = staged(keyed.join(roots, "node", "left").groupBy("key").agg(F.min(F.coalesce("root", "node")).alias("root")), "of-key")
    ids = of_key.groupBy("root").agg(F.min("key").alias("class_id"))
    rooted = staged(rows.select("key").join(of_key.join(ids, "root").select(F.col("key").alias("_key"), "class_id"),
                                            F.col("key") == F.col("_key"), "left").select(
        "key", F.coalesce("class_id", "key").alias("class_id")), "rooted")
    sizes = rooted.where("class_id IS NOT NULL").groupBy("class_id").agg(F.count("*").alias("class_size"))
    return rooted.join(sizes, "class_id", "left").select(
        F.col("key").alias(key), "class_id", F.coalesce("class_size", F.lit(1).cast("long")).alias("class_size"),
        F.col("key").eqNullSafe(F.col("class_id")).alias("kept"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one document of each class, all columns kept; rows without key stay."""
    gone = staged(near_dedup(docs, key, text, similar).where("NOT kept").select(F.col(key).alias("_gone")).distinct(), "gone")
    return docs.join(broadcast_measured(gone), F.col(key) == F.col("_gone"), "left_anti")
