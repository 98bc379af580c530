"""WARC archives: writing pages as records and reading them back.

One gzip member per record. The writer runs in tasks and rotates files by size; a file
appears under its final name when it is complete, and only files named in the manifest
count, so a task that is run again leaves nothing that is read. The reader walks a file
from start to end: it inflates member after member in small pieces, frames records by
their content length and verifies block and payload digests.

Pages with equal payloads are written once: the page with the smallest key is the
response, the others are revisit records that name it.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsweep.llm.common import staged
from glyphsweep.sources.scratch import new_path

#: A file is closed when it holds this many compressed bytes.
FILE_BYTES = 64 * 1024 * 1024
PIECE = 64 * 1024
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_KEY_URN = "urn:x-page:"
_NO_KEY_URN = "urn:uuid:"

MANIFEST = "path string, records long, bytes long"
RECORDS = ("path string, offset long, record_type string, record_id string, target_uri string, "
           "page_key string, payload_bytes long, payload_digest string, refers_to string, payload binary")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _file_system(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path)


def _urn(key: str | None) -> str:
    """The record id of a page: its key, or a random id for a page without key."""
    return _NO_KEY_URN + str(uuid.uuid4()) if key is None else _KEY_URN + quote(key, safe="")


def _key(urn: str | None) -> str | None:
    return unquote(urn[len(_KEY_URN):]) if urn and urn.startswith(_KEY_URN) else None


def record(kind: str, key: str | None, url: str | None, payload: bytes,
           refers_to: str | None = None, date: str = DATE) -> bytes:
    """One record: header fields, HTTP header and, unless it is a revisit, the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if kind == "revisit" else http + payload
    headers = [
        ("WARC-Type", kind), ("WARC-Record-ID", f"<{_urn(key)}>"), ("WARC-Date", date),
        ("WARC-Block-Digest", "sha1:" + base32_sha1(block)), ("WARC-Payload-Digest", "sha1:" + base32_sha1(payload)),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block))),
    ]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    if kind == "revisit":
        headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{_urn(refers_to)}>")]
    lines = b"".join(f"{name}: {value}\r\n".encode() for name, value in headers)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload_bytes: int = 0
    payload: bytes | None = None
    parts: list[bytes] = field(default_factory=list)


class _Members:
    """Reads one gzip member after the other from a stream, a piece at a time."""

    def __init__(self, stream: io.RawIOBase) -> None:
        self.stream, self.rest, self.at = stream, b"", 0

    def next(self) -> bool:
        """Go to the next member; False at the end of the file."""
        self.rest = self.rest or self.stream.read(PIECE)
        self.inflate = zlib.decompressobj(31)
        return bool(self.rest)

    def pieces(self) -> Iterator[bytes]:
        while not self.inflate.eof:
            data = self.rest or self.stream.read(PIECE)
            if not data:
                raise ValueError(f"archive ends inside the record at {self.at}")
            out = self.inflate.decompress(data, PIECE)
            left = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
            self.at += len(data) - len(left)
            self.rest = left
            if out:
                yield out


def read_records(stream: io.RawIOBase, with_payload: bool = True) -> Iterator[Record]:
    """The records of an archive in order. A record that is cut off, framed wrongly or
    does not have the digests it states is an error."""
    members = _Members(stream)
    while members.next():
        offset, buffer = members.at, b""
        pieces = members.pieces()
        while b"\r\n\r\n" not in buffer:
            piece = next(pieces, None)
            if piece is None:
                raise ValueError(f"no header in the record at {offset}")
            buffer += piece
        head, _, rest = buffer.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if lines[0].encode() != VERSION:
            raise ValueError(f"not a record at {offset}: {lines[0][:40]!r}")
        headers = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
        yield _framed(Record(offset, headers), rest, pieces, with_payload)


def _framed(found: Record, rest: bytes, pieces: Iterator[bytes], with_payload: bool) -> Record:
    length = int(found.headers["content-length"])
    block, payload = hashlib.sha1(), hashlib.sha1()
    http, taken, tail, body = b"", 0, b"", 0
    in_body = False
    kept: list[bytes] = []
    while True:
        part = rest[:length - taken]
        tail += rest[len(part):]
        block.update(part)
        taken += len(part)
        if not in_body:
            http += part
            head, mark, part = http.partition(b"\r\n\r\n")
            in_body = bool(mark)
            if in_body:
                http = head
            else:
                part = b""
        payload.update(part)
        body += len(part)
        if with_payload and part:
            kept.append(part)
        following = next(pieces, None)
        if following is None:
            break
        rest = following
    if taken != length or tail != b"\r\n\r\n":
        raise ValueError(f"wrong content length in the record at {found.offset}")
    if found.headers["warc-block-digest"] != _stated(block):
        raise ValueError(f"block digest differs in the record at {found.offset}")
    if found.headers["warc-type"] == "revisit":
        fields = dict(line.lower().split(b": ", 1) for line in http.split(b"\r\n")[1:])
        found.payload_bytes = int(fields[b"content-length"])
        return found
    if found.headers["warc-payload-digest"] != _stated(payload):
        raise ValueError(f"payload digest differs in the record at {found.offset}")
    found.payload_bytes, found.payload = body, b"".join(kept) if with_payload else None
    return found


def _stated(digest) -> str:
    return "sha1:" + base64.b32encode(digest.digest()).decode()


def with_revisits(pages: DataFrame, key: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """``pages`` as ``key, url, payload, refers_to``: the smallest key with the same payload.

    ``refers_to`` is null for responses: payloads that occur once, that are smaller than
    ``min_bytes``, or whose page has the smallest key. Rows that share that key and the
    payload are all responses, and a page without key never is referred to.
    """
    typed = pages.withColumn("_payload", F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8"))
    typed = typed.select(F.col(key).alias("key"), "url", "_payload", F.sha1("_payload").alias("sha"))
    groups = typed.where(F.octet_length("_payload") >= min_bytes).groupBy("sha").agg(
        F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    other = F.when(~F.col("key").eqNullSafe(F.col("first")), F.col("first"))
    return typed.join(groups, "sha", "left").select(
        "key", "url", F.col("_payload").alias("payload"), other.alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``key, url, payload, refers_to`` rows below ``folder``; returns the manifest.

    The manifest (``path, records, bytes``) is itself a table in the shared folder and
    lists finished files only. ``folder`` is a URI or path all executors can write to.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _file_system(folder)
        files.create_dir(root, recursive=True)
        out, done, path = None, [], ""
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            for i in range(batch.num_rows):
                key, url, payload, refers_to = (c[i].as_py() for c in columns)
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out, records, size = files.open_output_stream(path + ".open"), 0, 0
                kind = "response" if refers_to is None else "revisit"
                data = member(record(kind, key, url, payload, refers_to))
                out.write(data)
                records, size = records + 1, size + len(data)
                if size >= file_bytes:
                    done.append(_finished(files, out, path, records, size, folder))
                    out = None
        if out is not None:
            done.append(_finished(files, out, path, records, size, folder))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=pa.schema(
                [("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    text_keys = pages.select(F.col("key").cast("string"), "url", "payload", F.col("refers_to").cast("string"))
    return staged(text_keys.mapInArrow(write, MANIFEST), "warc-manifest")


def _finished(files, out, path: str, records: int, size: int, folder: str) -> dict:
    out.close()
    files.move(path + ".open", path)
    return {"path": f"{folder.rstrip('/')}/{path.rsplit('/', 1)[1]}", "records": records, "bytes": size}


def read_warc(spark: SparkSession, paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives in column ``path``, a file at a time per task."""
    schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()),
                        ("record_id", pa.string()), ("target_uri", pa.string()), ("page_key", pa.string()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()),
                        ("payload", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, inner = _file_system(path)
                rows, size = [], 0
                with files.open_input_stream(inner, compression=None) as stream:
                    for found in read_records(stream, with_payload):
                        h = found.headers
                        rows.append({
                            "path": path, "offset": found.offset, "record_type": h["warc-type"],
                            "record_id": h["warc-record-id"][1:-1], "target_uri": h.get("warc-target-uri"),
                            "page_key": _key(h["warc-record-id"][1:-1]), "payload_bytes": found.payload_bytes,
                            "payload_digest": h["warc-payload-digest"].removeprefix("sha1:"),
                            "refers_to": _key(h.get("warc-refers-to", "<>")[1:-1]), "payload": found.payload,
                        })
                        size += found.payload_bytes if with_payload else 0
                        if len(rows) >= 2000 or size >= 8 * 1024 * 1024:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    n = max(1, paths.count())
    return paths.select("path").repartition(n).mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
               min_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``pages`` as archives, read them back: one row per page.

    ``payload_bytes`` and ``payload_digest`` are those of the full payload, also for
    revisits. Null html is an empty payload, a null url leaves the field out, a null key
    gets a random record id and comes back null. No pages give no rows.
    """
    spark = pages.sparkSession
    kind = pages.schema[key].dataType
    named = pages.select(F.col(key).alias("page"), F.col(url).alias("url"), F.col(html).alias("html"))
    manifest = write_warc(with_revisits(named, "page", "html", min_bytes), folder or new_path(spark, "warc"))
    return read_warc(spark, manifest, with_payload=False).select(
        F.col("page_key").cast(kind).alias(key), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"))
