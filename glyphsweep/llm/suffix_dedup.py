"""Removal of repeated byte strings with a sparse, distributed suffix sort.

Every window of ``length`` bytes belongs to one anchor: the position in it whose
``SHALLOW`` bytes have the smallest hash. Equal windows have equal anchors at the same
place, so they meet under the anchor's hash, and windows in a row with the same anchor
travel as one segment. Segments whose hash occurs once in the corpus hold nothing that
repeats and never leave their task; equal segments travel once with their number.

The segments of one hash are suffixes and prefixes around the anchor. They are ordered
by deep-shallow sorting: multikey quicksort on eight-byte words to a shallow depth, then
blind tries for the groups whose common prefix is longer. A node of the trie gives the
bytes its suffixes share behind the anchor, the order of the reversed prefixes those in
front of it; a window repeats if both add up to its length.

Texts are compared as UTF-8 bytes. Copies of a whole text are one text with a count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsweep.llm.common import staged, text_or_empty

LENGTH = 200
#: Bytes of an anchor, and the depth of the multikey quicksort.
SHALLOW = 32
_WORD = 8
_BYTES = np.random.default_rng(12345).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BATCH_BYTES = 8 * 1024 * 1024


# --- Anchors and segments -------------------------------------------------------------

def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done, step = 1, base
    while done < n:
        take = min(done, n - done)
        np.multiply(out[:take], np.uint64(step), out=out[done:done + take])
        done, step = done + take, step * step % (1 << 64)
    return out


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of every run of ``k`` bytes: differences of one running sum."""
    n = len(data)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * _powers(_BASE, n), out=total[1:])
    found = (total[k:] - total[:-k]) * _powers(_INVERSE, n - k + 1)
    found ^= found >> np.uint64(29)
    found *= _MIX
    return found ^ (found >> np.uint64(32))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], before[width - 1:n])


def segments(data: bytes, length: int = LENGTH, k: int = SHALLOW) -> tuple[np.ndarray, ...]:
    """``hash, anchor, first, last``: runs of window starts that have the same anchor.

    Of equal smallest hashes the leftmost is the anchor.
    """
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, none
    width = length - k + 1
    hashes = gram_hashes(np.frombuffer(data, np.uint8), k)
    least = _sliding_min(hashes, width)
    # the anchor of window s is the first position at or behind s that holds its minimum
    n = len(least)
    at = np.flatnonzero(hashes == _padded_max(least, len(hashes), width))
    order = np.lexsort((at, hashes[at]))
    sorted_hash, sorted_at = hashes[at][order], at[order]
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    ends = np.concatenate([starts[1:], [n]])
    firsts, lasts, anchors = [], [], []
    lo = np.searchsorted(sorted_hash, least[starts], "left")
    hi = np.searchsorted(sorted_hash, least[starts], "right")
    for s, e, a, b in zip(starts.tolist(), ends.tolist(), lo.tolist(), hi.tolist(), strict=True):
        places = sorted_at[a:b]
        i = int(np.searchsorted(places, s)) if b - a > 1 else 0
        while s < e:
            anchor = int(places[i])
            last = min(e - 1, anchor)
            firsts.append(s)
            lasts.append(last)
            anchors.append(anchor)
            s, i = last + 1, i + 1
    anchors = np.array(anchors, np.int64)
    return hashes[anchors], anchors, np.array(firsts, np.int64), np.array(lasts, np.int64)


def _padded_max(least: np.ndarray, n: int, width: int) -> np.ndarray:
    """For each position the largest minimum of the windows over it: an anchor equals it."""
    flipped = np.full(n + width - 1, np.iinfo(np.uint64).max, np.uint64)
    flipped[width - 1:width - 1 + len(least)] = ~least
    return ~_sliding_min(flipped, width)


# --- Deep-shallow sorting -------------------------------------------------------------

def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    if a == b:
        return n
    different = int.from_bytes(a, "big") ^ int.from_bytes(b, "big")
    return n - (different.bit_length() + 7) // 8


class BlindTrie:
    """A trie that stores depths and branching bytes only.

    A node is ``[depth, children]`` with children by byte (-1: the string ends there), a
    leaf a list of equal strings' numbers. A search compares no bytes but the branching
    ones; one comparison with the leaf it ends in gives the place to insert.
    """

    def __init__(self, strings: list[bytes]) -> None:
        self.strings, self.root = strings, None

    def insert(self, number: int) -> None:
        new = self.strings[number]
        if self.root is None:
            self.root = (number,)
            return
        node = self.root
        while isinstance(node, list):
            depth, children = node
            node = children.get(new[depth] if depth < len(new) else -1) or next(iter(children.values()))
        shared = common_prefix(new, self.strings[node[0]])
        old = self.strings[node[0]]
        if shared == len(new) == len(old):
            self._replace(new, node, (*node, number))
            return
        parent, edge, node = None, None, self.root
        while isinstance(node, list) and node[0] < shared:
            parent, edge = node, new[node[0]] if node[0] < len(new) else -1
            node = node[1][edge]
        branch = new[shared] if shared < len(new) else -1
        if isinstance(node, list) and node[0] == shared:
            node[1][branch] = (number,)
            return
        other = old[shared] if shared < len(old) else -1
        split = [shared, {other: node, branch: (number,)}]
        if parent is None:
            self.root = split
        else:
            parent[1][edge] = split

    def _replace(self, new: bytes, leaf: tuple, now: tuple) -> None:
        parent, edge, node = None, None, self.root
        while isinstance(node, list):
            parent, edge = node, new[node[0]] if node[0] < len(new) else -1
            node = node[1][edge]
        if parent is None:
            self.root = now
        else:
            parent[1][edge] = now

    def walk(self) -> Iterator[tuple[int, list[int]]]:
        """Every node's depth and the numbers below it in order, children before parents.

        The last item is the whole order; a leaf's depth is the length of its string.
        """
        stack: list[tuple[object, list | None, list[int]]] = [(self.root, None, [])]
        results: list[list[int]] = []
        while stack:
            node, todo, got = stack.pop()
            if not isinstance(node, list):
                leaf = list(node)
                if len(leaf) > 1:
                    yield len(self.strings[leaf[0]]), leaf
                results.append(leaf)
                continue
            if todo is None:
                todo = sorted(node[1], reverse=True)
            else:
                got.extend(results.pop())
            if todo:
                edge = todo.pop()
                stack.append((node, todo, got))
                stack.append((node[1][edge], None, []))
            else:
                yield node[0], got
                results.append(list(got))


def multikey_quicksort(strings: list[bytes], numbers: list[int], shallow: int) -> Iterator[list[int]]:
    """Groups of ``numbers`` in order of their strings' first ``shallow`` bytes.

    Strings of a group agree in those bytes (a shorter one in all it has).
    """
    stack = [(numbers, 0)]
    while stack:
        some, depth = stack.pop()
        if len(some) <= 1 or depth >= shallow:
            if some:
                yield some
            continue
        words = [strings[i][depth:depth + _WORD] for i in some]
        pivot = words[len(words) // 2]
        less = [i for i, w in zip(some, words, strict=True) if w < pivot]
        equal = [i for i, w in zip(some, words, strict=True) if w == pivot]
        greater = [i for i, w in zip(some, words, strict=True) if w > pivot]
        stack += [(greater, depth), (equal, depth + _WORD if len(pivot) == _WORD else shallow), (less, depth)]


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> Iterator[tuple[int, list[int]]]:
    """Nodes of the sorted order whose strings share at least ``shallow`` bytes: their
    common depth and the numbers below them in order, children first."""
    for group in multikey_quicksort(strings, list(range(len(strings))), shallow):
        if len(group) > 1:
            trie = BlindTrie(strings)
            for number in group:
                trie.insert(number)
            yield from trie.walk()


def order_of(strings: list[bytes]) -> list[int]:
    """The rank of each string, by deep-shallow sorting; equal strings have any order."""
    ranked: list[int] = []
    for group in multikey_quicksort(strings, list(range(len(strings))), SHALLOW):
        trie = BlindTrie(strings)
        for number in group:
            trie.insert(number)
        whole = group if len(group) == 1 else None
        if whole is None:
            for _, whole in trie.walk():
                pass
        ranked += whole
    ranks = [0] * len(strings)
    for rank, number in enumerate(ranked):
        ranks[number] = rank
    return ranks


def repeated_windows(classes: list[tuple[int, bytes, int]], length: int) -> list[list[tuple[int, int]]]:
    """For each ``(anchor place, segment, count)`` the runs of window starts, relative to
    the segment, that occur in another segment or in a copy of it."""
    found: list[list[tuple[int, int]]] = [[] for _ in classes]
    open_ones = set()
    for i, (_, segment, count) in enumerate(classes):
        if count > 1:
            found[i].append((0, len(segment) - length))
        else:
            open_ones.add(i)
    if not open_ones or len(classes) < 2:
        return found
    behind = [segment[at:] for at, segment, _ in classes]
    before = [segment[:at][::-1] for at, segment, _ in classes]
    ranks = order_of(before)
    for shared, members in deep_shallow(behind):
        if open_ones.isdisjoint(members):
            continue
        members = sorted(members, key=ranks.__getitem__)
        in_front = [common_prefix(before[a], before[b]) for a, b in zip(members, members[1:], strict=False)]
        for n, i in enumerate(members):
            if i in open_ones:
                most = max(in_front[n - 1] if n else 0, in_front[n] if n < len(in_front) else 0)
                # windows that begin so many bytes in front of the anchor
                least = max(0, length - shared)
                if least <= most:
                    at, segment, _ = classes[i]
                    first, last = max(0, at - most), min(at - least, len(segment) - length)
                    if first <= last:
                        found[i].append((first, last))
    return found


# --- Spark ----------------------------------------------------------------------------

def _batches(rows: Iterator[tuple], schema: pa.Schema, weight=None) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 if weight is None else 64 + weight(row)
        if size >= _BATCH_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _anchors(length: int):
    """``hash, route, n``: each text's hashes once, texts of a batch that are equal together."""
    schema = pa.schema([("hash", pa.int64()), ("route", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            copies: dict[bytes, list[int]] = {}
            for route, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                copies.setdefault(data.as_py(), [route, 0])[1] += 1
            columns: list[list[np.ndarray]] = [[], [], []]
            for data, (route, n) in copies.items():
                hashes, counts = np.unique(segments(data, length)[0], return_counts=True)
                columns[0].append(hashes.view(np.int64))
                columns[1].append(np.full(len(hashes), route, np.int64))
                columns[2].append(counts * n)
            if copies:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], schema=schema)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([squeeze.compress(x.as_py()) for x in batch.column(2)], type=pa.binary())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), packed], names=["route", "id", "packed"])


def distinct_texts(docs: DataFrame, text: str) -> DataFrame:
    """``route, id, packed, copies``: every distinct text once, compressed."""
    rows = docs.select(*_ids(text), F.encode(text_or_empty(F.col(text)), "utf-8").alias("data"))
    packed = rows.mapInArrow(_packed, "route long, id binary, packed binary")
    return packed.groupBy("route", "id").agg(F.first("packed").alias("packed"), F.count("*").alias("copies"))


def _ids(text: str) -> list:
    digest = F.unhex(F.sha2(text_or_empty(F.col(text)), 256))
    return [F.xxhash64(text_or_empty(F.col(text))).alias("route"), F.substring(digest, 1, 16).alias("id")]


_CANDIDATES = ("hash long, class binary, id binary, start int, anchor int, segment binary, copies long")


def _candidates(length: int):
    schema = pa.schema([("hash", pa.int64()), ("class", pa.binary()), ("id", pa.binary()), ("start", pa.int32()),
                        ("anchor", pa.int32()), ("segment", pa.binary()), ("copies", pa.int64())])

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        expand = zstandard.ZstdDecompressor()
        met: dict[bytes, list] = {}
        ids, packed, copies, shared = (batch.column(i) for i in range(4))
        for i in range(batch.num_rows):
            data = expand.decompress(packed[i].as_py())
            key, n = ids[i].as_py(), copies[i].as_py()
            wanted = shared[i].values.to_numpy(zero_copy_only=False)
            hashes, anchors, firsts, lasts = segments(data, length)
            hashes = hashes.view(np.int64)
            keep = np.flatnonzero(np.isin(hashes, wanted))
            for h, at, a, b in zip(*(x[keep].tolist() for x in (hashes, anchors, firsts, lasts)), strict=True):
                segment = data[a:b + length]
                name = hashlib.blake2b(segment, digest_size=16, salt=(at - a).to_bytes(4, "little")).digest()
                if name in met:
                    met[name][6] += n
                    yield h, name, key, a, None, None, None
                else:
                    met[name] = [h, name, key, a, at - a, segment, n]
        for row in met.values():
            yield tuple(row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(rows(batch), schema, lambda r: len(r[5] or b""))

    return run


def _solved(length: int):
    schema = pa.schema([("class", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, group in groupby(records(batches), key=lambda r: r[0]):
            classes: dict[bytes, list] = {}
            for _, name, at, segment, copies in group:
                if name in classes:
                    classes[name][2] += copies
                else:
                    classes[name] = [at, segment, copies]
            for name, runs in zip(classes, repeated_windows([tuple(c) for c in classes.values()], length), strict=True):
                for first, last in runs:
                    yield name, first, last

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(rows(batches), schema)

    return run


_REMOVED = "id binary, n_removed long, n_spans long, kept_sha256 string"


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of bytes of spans that may overlap or touch."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, end in spans:
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    schema = pa.schema([("id", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
    for batch in batches:
        rows = []
        for key, packed, spans in zip(*(batch.column(i) for i in range(3)), strict=True):
            runs = merged([(s["start"], s["end"]) for s in spans.as_py()])
            data = expand.decompress(packed.as_py())
            rows.append((key.as_py(), sum(b - a for a, b in runs), len(runs),
                         hashlib.sha256(kept_bytes(data, runs)).hexdigest()))
        if rows:
            yield _batch(rows, schema)


def repeated_spans(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``id, start, end``: bytes covered by windows that also start elsewhere, by text.

    ``id`` is the first half of the text's SHA-256; spans of a text may overlap.
    """
    data = docs.select(*_ids(text), F.encode(text_or_empty(F.col(text)), "utf-8").alias("data"))
    anchors = data.select("route", "data").mapInArrow(_anchors(length), "hash long, route long, n long")
    shared = anchors.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1").select("hash")
    wanted = anchors.select("hash", "route").join(shared, "hash").groupBy("route").agg(F.collect_set("hash").alias("hashes"))
    texts = distinct_texts(docs, text).join(wanted, "route").select("id", "packed", "copies", "hashes")
    found = staged(texts.mapInArrow(_candidates(length), _CANDIDATES), "segments")
    classes = found.where("segment IS NOT NULL").select("hash", "class", "anchor", "segment", "copies")
    solved = classes.repartition("hash").sortWithinPartitions("hash").mapInArrow(
        _solved(length), "class binary, first int, last int")
    return found.select("class", "id", "start").join(solved, "class").select(
        "id", (F.col("start") + F.col("first")).alias("start"), (F.col("start") + F.col("last") + length).alias("end"))


def suffix_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: the key, ``n_bytes, n_removed, n_spans, kept_sha256``.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in
    this or another text; all strings are judged on the input. Null counts as empty;
    texts shorter than ``length`` lose nothing; rows with equal texts get equal results
    and, being copies of each other, lose all bytes if long enough.
    """
    spans = repeated_spans(docs, text, length).groupBy("id").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))
    removed = distinct_texts(docs, text).join(spans, "id").select("id", "packed", "spans").mapInArrow(_removed, _REMOVED)
    whole = docs.select(F.col(key).alias("_key"), *_ids(text),
                        F.octet_length(F.encode(text_or_empty(F.col(text)), "utf-8")).cast("long").alias("n_bytes"),
                        F.sha2(text_or_empty(F.col(text)), 256).alias("whole_sha256"))
    zero = F.lit(0).cast("long")
    return whole.join(removed, "id", "left").select(
        F.col("_key").alias(key), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"),
        F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "whole_sha256").alias("kept_sha256"))
