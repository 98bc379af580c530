"""Exact deduplication with Grace hash tables.

Texts are compared after every run of ASCII white space became one space. A task reads
its texts into an open-addressing hash table whose slots point at complete contents; a
hit counts only if the bytes are equal. When the contents in the table reach the memory
budget, texts that are not in it go to spill files chosen by the next bits of their
hash, and each file is worked off the same way, recursively, until it fits. Texts that
are in the table never spill, so a text with any number of copies takes one slot.

This runs twice: over the texts of every input partition, so that a text held by a third
of all rows leaves each task once, and over the distinct texts of each shuffle partition.
What travels per row besides is the key and a digest. Where only the kept rows are
wanted, they travel themselves, one per text and task, and nothing is joined.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphsweep.llm.common import text_or_empty

#: Bytes of distinct content a table holds before it spills.
TABLE_BYTES = 64 * 1024 * 1024
#: Spill files of one level: four bits of the hash.
FAN_OUT_BITS = 4
_WHITE = r"[\x20\x09-\x0D]+"
#: Result rows and bytes of one Arrow batch.
_BATCH_ROWS, _BATCH_BYTES = 2000, 8 * 1024 * 1024

Entry = tuple  # content, smallest key, rows that have this key, rows, a row of this key if rows are carried


def normalised(text: Column) -> Column:
    return F.regexp_replace(text_or_empty(text), _WHITE, " ")


def least(a: tuple, b: tuple) -> tuple:
    """The smaller key with its number of rows; null comes last, equal keys add up."""
    if a[0] == b[0]:
        return a[0], a[1] + b[1]
    if a[0] is None or b[0] is None:
        return b if a[0] is None else a
    return a if a[0] < b[0] else b


class ContentTable:
    """Open addressing with linear probing; slots hold entry numbers."""

    def __init__(self, budget: int) -> None:
        self.budget, self.bytes = budget, 0
        self.slots: list[int] = [-1] * 1024
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.keys: list[tuple] = []
        self.counts: list[int] = []
        self.rows: list[tuple | None] = []

    def add(self, hashed: int, content: bytes, key: tuple, count: int, row: tuple | None = None) -> bool:
        """False if the content is new and the budget is used up."""
        mask = len(self.slots) - 1
        at = hashed & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == hashed and self.contents[entry] == content:
                before, self.keys[entry] = self.keys[entry], least(self.keys[entry], key)
                self.counts[entry] += count
                if self.keys[entry][0] != before[0]:
                    self.rows[entry] = row
                return True
            at = (at + 1) & mask
        if self.contents and self.bytes + len(content) > self.budget:
            return False
        self.slots[at] = len(self.contents)
        self.hashes.append(hashed)
        self.contents.append(content)
        self.keys.append(key)
        self.counts.append(count)
        self.rows.append(row)
        self.bytes += len(content) * (1 if row is None else 2)  # a row holds its text once more
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, hashed in enumerate(self.hashes):
            at = hashed & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def entries(self) -> Iterator[Entry]:
        for content, (key, ties), count, row in zip(self.contents, self.keys, self.counts, self.rows, strict=True):
            yield (content, key, ties, count) if row is None else (content, key, ties, count, row)


def grace(records: Iterable[Entry], budget: int = TABLE_BYTES, level: int = 0) -> Iterator[Entry]:
    """One entry per distinct content. Every level takes other bits of the hash."""
    table, files = ContentTable(budget), {}
    shift = 64 + FAN_OUT_BITS * level  # the table itself uses the low bits
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        for content, key, ties, count, *carried in records:
            row = carried[0] if carried else None
            hashed = int.from_bytes(hashlib.blake2b(content, digest_size=32).digest(), "little")
            if not table.add(hashed, content, (key, ties), count, row):
                part = (hashed >> shift) % (1 << FAN_OUT_BITS)
                if part not in files:
                    files[part] = open(os.path.join(folder, str(part)), "wb")  # noqa: SIM115
                pickle.dump((content, key, ties, count, *carried), files[part], protocol=5)
        yield from table.entries()
        del table
        for part, file in sorted(files.items()):
            file.close()
            yield from grace(_spilled(os.path.join(folder, str(part))), budget, level + 1)
            os.unlink(os.path.join(folder, str(part)))


def _spilled(path: str) -> Iterator[Entry]:
    with open(path, "rb") as file:
        while True:
            try:
                yield pickle.load(file)
            except EOFError:
                return


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[Entry]:
    for batch in batches:
        columns = [batch.column(i) for i in range(4)]
        for i in range(batch.num_rows):
            content, key, ties, count = (c[i].as_py() for c in columns)
            yield content, key, ties, count


def _table_udf(schema: pa.Schema, budget: int, with_content: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for content, key, ties, count in grace(_entries(batches), budget):
            digest = hashlib.sha256(content).hexdigest()
            rows.append((digest, key, ties, count, content) if with_content else (digest, key, ties, count))
            size += len(content) if with_content else 0
            if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                yield _batch(rows, schema)
                rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def content_classes(docs: DataFrame, key: str = "doc_id", text: str = "text",
                    table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per distinct normalised text: ``digest, keep_id, ties, group_size``.

    ``keep_id`` is the smallest key of the rows with that text (null only if all are
    null), ``ties`` the number of rows that carry it.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    key_type = docs.schema[key].dataType
    arrow_key = to_arrow_type(key_type)
    fields = [("digest", pa.string()), ("key", arrow_key), ("ties", pa.int64()), ("rows", pa.int64())]
    names = [T.StructField("digest", T.StringType()), T.StructField("key", key_type),
             T.StructField("ties", T.LongType()), T.StructField("rows", T.LongType())]
    local = docs.select(
        F.encode(normalised(F.col(text)), "utf-8").alias("content"),
        F.col(key).alias("key"), F.lit(1).cast("long").alias("ties"), F.lit(1).cast("long").alias("rows"),
    ).mapInArrow(
        _table_udf(pa.schema([*fields, ("content", pa.binary())]), table_bytes, True),
        T.StructType([*names, T.StructField("content", T.BinaryType())]),
    )
    met = local.repartition("digest").select("content", "key", "ties", "rows")
    classes = met.mapInArrow(_table_udf(pa.schema(fields), table_bytes, False), T.StructType(names))
    return classes.select("digest", F.col("key").alias("keep_id"), "ties", F.col("rows").alias("group_size"))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text",
                table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per input row: the key, ``keep_id, group_size, kept, text_sha256``.

    Of the rows whose normalised texts are equal the one with the smallest key is kept.
    Null texts are empty texts and equal each other; a null key is larger than any other.
    Rows that repeat key and text are copies like others: exactly one row of a group has
    ``kept``. An empty table gives no rows.
    """
    members = docs.select(F.col(key).alias("_key"), F.sha2(normalised(F.col(text)), 256).alias("digest"))
    repeated = Window.partitionBy("digest", "_key").orderBy(F.lit(0))
    numbered = members.withColumn("_copy", F.row_number().over(repeated))
    classes = content_classes(docs, key, text, table_bytes)
    return numbered.join(classes, "digest").select(
        F.col("_key").alias(key), "keep_id", "group_size",
        (F.col("_key").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def _plain(text: str | None) -> bytes:
    """``normalised`` of a text, as bytes: every run of white space is one space."""
    content = (text or "").encode("utf-8", "surrogatepass")
    words = content.split()
    if not words:
        return b" " if content else b""
    return b"".join((b" " if content[:1].isspace() else b"", b" ".join(words), b" " if content[-1:].isspace() else b""))


def _row_udf(schema: pa.Schema, key_at: int, text_at: int, budget: int):
    """Whole rows through the table: one of the smallest key for each text, with its digest."""

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[Entry]:
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(schema) - 1)), strict=True):
                yield _plain(row[text_at]), row[key_at], 1, 1, row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for content, *_, row in grace(entries(batches), budget):
            rows.append((*row, hashlib.sha256(content).digest()))
            size += len(content)
            if len(rows) >= _BATCH_ROWS or size >= _BATCH_BYTES:
                yield _batch(rows, schema)
                rows, size = [], 0
        if rows:
            yield _batch(rows, schema)

    return run


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text",
                table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``docs`` without its exact copies, all columns kept.

    Exactly one row of each text stays, one of the smallest key; where the same key and
    text occur in several rows, which of them is open. The rows themselves go through the
    tables, so they are shuffled once, after copies within a task are gone.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    names = [f"c{i}" for i in range(len(docs.columns))]  # names may repeat or clash
    kept = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, docs.schema, strict=True)])
    carried = T.StructType([*kept, T.StructField("digest", T.BinaryType())])
    udf = _row_udf(to_arrow_schema(carried), docs.columns.index(key), docs.columns.index(text), table_bytes)
    local = docs.toDF(*names).mapInArrow(udf, carried)
    return local.repartition("digest").select(*names).mapInArrow(udf, carried).select(*names).toDF(*docs.columns)
