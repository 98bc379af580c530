"""Byte-pair encoding and decoding with a given vocabulary file.

Merging uses a segment tree over the ranks of adjacent pairs: a leaf is a pair's rank and
place, an inner node the smaller of its children, so the root names the leftmost pair of
lowest rank. A merge changes at most three leaves, each in logarithmic time, until the
root holds no mergeable pair.

Encoding reads vocabulary, merges, word-end suffix and added tokens from the file. Text
is cut at added tokens, brought to NFC, lower-cased and cut into words, words into
UTF-8 bytes. A task encodes the words that are new in a run of texts together, one
segment tree a row of an array, and remembers a bounded number.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphsweep.llm.common import text_or_empty

#: Fixed values of the word-level vocabulary format: how a text is cut into words.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Unicode white space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: Controls that Python, other than the vocabulary's normaliser, takes for white space.
_NOT_WHITE = re.compile("[\x1c-\x1f]")
_SPLIT = re.compile(f"[{WHITE_SPACE}]+")
#: Chunks whose encoding a task remembers before it begins anew: a bound on memory only.
CACHE_WORDS = 300_000
#: Characters of texts whose new words are encoded together.
TOGETHER = 2_000_000
#: Words of more bytes are merged one at a time.
LONG_WORD = 128
_NO_PAIR = 1 << 62


def byte_characters() -> list[str]:
    """The character that stands for each byte in vocabulary entries."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    return [rest.get(b, chr(b)) for b in range(256)]


def merge(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """``symbols`` after all merges; ``ranks`` holds each pair's rank times 2 to the 32."""
    n, rank = len(symbols), ranks.get
    level = [rank(pair, _NO_PAIR) for pair in zip(symbols, symbols[1:], strict=False)]
    level = [value | i if value < _NO_PAIR else value for i, value in enumerate(level)]
    size = 1 << max(0, (n - 2).bit_length())
    level += [_NO_PAIR] * (size - len(level))
    tree = level
    while len(level) > 1:
        level = list(map(min, level[::2], level[1::2]))
        tree = level + tree
    tree = [_NO_PAIR, *tree]  # the root is 1, the children of i are 2i and 2i + 1
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while (root := tree[1]) < _NO_PAIR:
        left = root & 0xFFFFFFFF
        right = after[left]
        symbols[left] += symbols[right]
        following = after[left] = after[right]
        changed = []
        if right < n - 1:
            changed.append((right, _NO_PAIR))
        value = _NO_PAIR
        if following < n:
            before[following] = left
            value = rank((symbols[left], symbols[following]), _NO_PAIR)
        changed.append((left, value | left if value < _NO_PAIR else value))
        earlier = before[left]
        if earlier >= 0:
            value = rank((symbols[earlier], symbols[left]), _NO_PAIR)
            changed.append((earlier, value | earlier if value < _NO_PAIR else value))
        for at, value in changed:
            at += size
            while tree[at] != value:
                tree[at] = value
                if at == 1:
                    break
                other = tree[at ^ 1]
                if other < value:
                    value = other
                at >>= 1
    out, at = [], 0
    while at < n:
        out.append(symbols[at])
        at = after[at]
    return out


class Merges:
    """The merges of a vocabulary over numbered symbols, for many words at a time."""

    def __init__(self, symbols: dict[str, int], pairs: list[tuple[str, str]]) -> None:
        self.count = len(symbols)
        keys = np.array([symbols[a] * self.count + symbols[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([symbols[a + b] for a, b in pairs], np.int64)

    def _values(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What stands in the tree for pairs of symbols: rank, then place; none for -1."""
        keys = left * self.count + right
        found = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        good = (left >= 0) & (right >= 0) & (self.keys[found] == keys)
        return np.where(good, self.rank[found] << 32 | at, _NO_PAIR)

    def merge(self, words: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all words after all merges, and how many each word has.

        One row of ``tree`` is the segment tree of one word: the root is 1, the children of
        i are 2i and 2i + 1, the leaves are the pairs. In each round every word that has a
        pair left merges its root's, and the three leaves concerned are set anew.
        """
        n = np.array([len(w) for w in words])
        size = 1 << max(0, int(n.max()) - 2).bit_length()
        rows, places = len(words), np.arange(size + 1)
        symbols = np.full((rows, size + 2), -1, np.int64)
        symbols[:, :size + 1][places < n[:, None]] = np.fromiter(chain.from_iterable(words), np.int64, int(n.sum()))
        head = symbols >= 0
        after = np.tile(np.arange(1, size + 3), (rows, 1))
        before = np.tile(np.arange(-1, size + 1), (rows, 1))
        tree = np.full((rows, 2 * size), _NO_PAIR, np.int64)
        tree[:, size:] = self._values(symbols[:, :size], symbols[:, 1:size + 1], places[:size])
        level = size // 2
        while level:
            tree[:, level:2 * level] = np.minimum(tree[:, 2 * level:4 * level:2], tree[:, 2 * level + 1:4 * level:2])
            level //= 2
        todo = np.flatnonzero(tree[:, 1] < _NO_PAIR)
        while len(todo):
            root = tree[todo, 1]
            left = root & 0xFFFFFFFF
            right = after[todo, left]
            symbols[todo, left] = self.made[root >> 32]
            head[todo, right] = False
            following = np.minimum(after[todo, right], size + 1)  # behind the last stands no symbol
            after[todo, left], before[todo, following] = following, left
            earlier = before[todo, left]
            self._set(tree, todo, size, np.where(right < size, right, left), np.full(len(todo), _NO_PAIR))
            self._set(tree, todo, size, left, self._values(symbols[todo, left], symbols[todo, following], left))
            known = earlier >= 0
            self._set(tree, todo[known], size, earlier[known], self._values(
                symbols[todo[known], earlier[known]], symbols[todo[known], left[known]], earlier[known]))
            todo = todo[tree[todo, 1] < _NO_PAIR]
        return symbols[head], head.sum(axis=1)

    @staticmethod
    def _set(tree: np.ndarray, rows: np.ndarray, size: int, at: np.ndarray, value: np.ndarray) -> None:
        """Set one leaf of each row, and the nodes above it."""
        at = at + size
        tree[rows, at] = value
        while size > 1:
            at, size = at >> 1, size >> 1
            tree[rows, at] = np.minimum(tree[rows, 2 * at], tree[rows, 2 * at + 1])


class Vocabulary:
    """What a vocabulary file says, and the chunks encoded so far."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank << 32 for rank, pair in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        self.tokens = {i: t for t, i in (self.ids | self.added).items()}
        self.cut = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.words = regex.compile(WORD_PATTERN)
        self.bytes = byte_characters()
        every = [*self.ids, *self.bytes, *(b + self.suffix for b in self.bytes), *chain.from_iterable(pairs), *(a + b for a, b in pairs)]
        self.numbers = {symbol: i for i, symbol in enumerate(dict.fromkeys(every))}
        self.last = [self.numbers[b + self.suffix] for b in self.bytes]
        self.inner = [self.numbers[b] for b in self.bytes]
        self.id_of = np.array([self.ids.get(symbol, -1) for symbol in self.numbers], np.int64)
        self.merges = Merges(self.numbers, pairs) if pairs else None
        self.known: dict[str, tuple[bytes, str]] = {}

    def _encoded(self, words: list[str]) -> dict[str, bytes]:
        """The ids of distinct words; those of similar length are merged together."""
        groups: dict[int, list[str]] = {}
        found = {}
        for word in words:
            n = len(word.encode("utf-8"))
            if n > LONG_WORD or self.merges is None:
                symbols = [self.bytes[b] for b in word.encode("utf-8")]
                symbols[-1] += self.suffix
                found[word] = b"".join(struct.pack("<I", self.ids[s]) for s in merge(symbols, self.ranks) if s in self.ids)
            else:
                groups.setdefault(max(n - 2, 0).bit_length(), []).append(word)
        for group in groups.values():
            rows = []
            for word in group:
                content = word.encode("utf-8")
                rows.append([self.inner[b] for b in content[:-1]] + [self.last[content[-1]]])
            symbols, counts = self.merges.merge(rows)
            ids = self.id_of[symbols]
            ends = np.cumsum(counts)
            held = np.concatenate([[0], np.cumsum(ids >= 0)])  # symbols that the vocabulary lacks have no id
            packed = ids[ids >= 0].astype("<u4").tobytes()
            for word, lo, hi in zip(group, (4 * held[ends - counts]).tolist(), (4 * held[ends]).tolist(), strict=True):
                found[word] = packed[lo:hi]
        return found

    def _cut_words(self, text: str) -> list[str]:
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if text[:-1].isalpha():  # most often letters, perhaps with one mark behind
            return [text] if text[-1].isalpha() else [text[:-1], *self.words.findall(text[-1])]
        return [text] if len(text) == 1 and text.isalpha() else self.words.findall(text)

    def _parts(self, chunk: str) -> list[str | int]:
        """The words of what stands between white space, and the ids of added tokens."""
        if self.cut is None or "<" not in chunk:
            return self._cut_words(chunk)
        parts, at = [], 0
        for m in self.cut.finditer(chunk):
            parts += [*self._cut_words(chunk[at:m.start()]), self.added[m[0]]]
            at = m.end()
        return parts + self._cut_words(chunk[at:])

    def learn(self, chunks: set[str]) -> None:
        """Encode those of the chunks that are not remembered."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        parts = {c: self._parts(c) for c in chunks - self.known.keys()}
        words = self._encoded(list({w for found in parts.values() for w in found if isinstance(w, str)}))
        for chunk, found in parts.items():
            ids = b"".join([words[w] if isinstance(w, str) else struct.pack("<I", w) for w in found])
            self.known[chunk] = ids, self.decode(ids)

    def encode_all(self, texts: Iterable[str]) -> Iterator[tuple[bytes, str]]:
        """For each text the ids as little-endian 32-bit integers, and the text they decode
        to. Texts are taken together up to a number of characters, for their new words."""
        held, size = [], 0
        for text in texts:
            held.append(_SPLIT.split(text) if _NOT_WHITE.search(text) else text.split())
            size += len(text)
            if size >= TOGETHER:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def _joined(self, held: list[list[str]]) -> Iterator[tuple[bytes, str]]:
        self.learn(set(chain.from_iterable(held)))
        for chunks in held:
            found = [x for x in map(self.known.__getitem__, chunks) if x[0]]
            yield b"".join([x[0] for x in found]), " ".join([x[1] for x in found])

    def encode(self, text: str) -> tuple[bytes, str]:
        return next(self.encode_all([text]))

    def decode(self, ids: bytes) -> str:
        """Tokens joined by spaces, special ones included: the file names no decoder."""
        tokens = self.tokens
        return " ".join([tokens[i] for (i,) in struct.iter_unpack("<I", ids)])


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(text: Column, path: str) -> Column:
    """``struct<ids array<int>, decoded string>`` of a text column; null counts as empty."""
    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        try:
            for batch in batches:
                rows = list(words.encode_all(batch))
                yield pd.DataFrame({
                    "ids": [[i for (i,) in struct.iter_unpack("<I", ids)] for ids, _ in rows],
                    "decoded": [d for _, d in rows],
                })
        finally:
            words.known.clear()

    return run(text_or_empty(text))


def digests(text: Column, path: str) -> Column:
    """``struct<n_tokens, ids_sha256, decoded_sha256>``: ids hashed as little-endian 32-bit."""
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                         T.StructField("decoded_sha256", T.StringType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = vocabulary(path)
        try:
            for batch in batches:
                rows = []
                for ids, decoded in words.encode_all(batch):
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(),
                                 hashlib.sha256(decoded.encode("utf-8")).hexdigest()))
                yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
        finally:  # the process goes on to tasks of other stages
            words.known.clear()

    return run(text_or_empty(text))


def decode(ids: Column, path: str) -> Column:
    """The text of an array of ids; null gives null, unknown ids are an error."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokens = vocabulary(path).tokens
        for batch in batches:
            yield pd.Series([None if row is None else " ".join([tokens[i] for i in row]) for row in batch])

    return run(ids)


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row the key, ``n_tokens, ids_sha256, decoded_sha256``; rows may repeat.

    A null or empty text has no tokens and decodes to the empty text. Texts are encoded
    whole, whatever their length. No rows give no rows.
    """
    return docs.select(F.col(key).alias(key), digests(F.col(text), path).alias("_")).select(key, "_.*")
