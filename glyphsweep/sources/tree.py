"""File trees as a table: ``spark.read.format("tree")``, by Spark's Python data sources.

Columns are repo, path, modificationTime, length, mode and content. Unlike Spark's own
file sources it returns names that begin with a dot or an underscore, and links are
neither followed nor returned.

Conditions on all columns but the content are pushed into the scan: directories that no
wanted path can lie in are not listed, and files that fail are not opened. Planning lists
from the root only until there are enough units of work or a bounded number of entries
has been seen; a unit is a batch of files, or a directory that its task goes on listing.
A directory too large for the bound is one that several tasks list and share by name.
Nothing is read while a table is only being defined.
"""

from __future__ import annotations

import datetime
import fnmatch
import os
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

from glyphsweep.rules import UNVISITED_DIRS

SCHEMA = "repo string, path string, modificationTime timestamp, length bigint, mode int, content binary"
_ARROW = pa.schema([
    ("repo", pa.string()), ("path", pa.string()), ("modificationTime", pa.timestamp("us", tz="UTC")), ("length", pa.int64()),
    ("mode", pa.int32()), ("content", pa.binary()),
])
_BATCH_BYTES = 16 * 1024 * 1024


class Entry(NamedTuple):
    """A file or directory below the root."""

    path: str
    is_dir: bool
    length: int
    modified: datetime.datetime | None
    mode: int | None


# --- conditions ------------------------------------------------------------------------

_TESTS: dict[type, Callable] = {
    ds.EqualTo: lambda a, b: a == b, ds.EqualNullSafe: lambda a, b: a == b,
    ds.GreaterThan: lambda a, b: a > b, ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.In: lambda a, b: a in b,
    ds.StringStartsWith: str.startswith, ds.StringEndsWith: str.endswith, ds.StringContains: str.__contains__,
}
_COLUMNS = {"path": "path", "length": "length", "modificationTime": "modified", "mode": "mode"}


@dataclass(frozen=True)
class Condition:
    """One pushed condition on a column of the listing."""

    column: str
    kind: type
    value: object
    negated: bool = False

    def holds(self, entry: Entry) -> bool:
        value, wanted = getattr(entry, self.column), self.value
        if self.kind is ds.IsNull:
            return (value is None) != self.negated
        if value is None or wanted is None:
            return self.kind is ds.EqualNullSafe and (value is wanted) != self.negated
        return _TESTS[self.kind](value, wanted) != self.negated

    def reaches(self, directory: str) -> bool:
        """Whether a path below the directory can meet the condition."""
        if self.column != "path" or self.negated:
            return True
        below = f"{directory}/" if directory else ""
        if self.kind in (ds.EqualTo, ds.EqualNullSafe):
            return str(self.value).startswith(below)
        if self.kind is ds.In:
            return any(str(v).startswith(below) for v in self.value)
        if self.kind is ds.StringStartsWith:
            return below.startswith(str(self.value)) or str(self.value).startswith(below)
        return True


def condition_of(pushed: ds.Filter) -> Condition | None:
    """A pushed filter as a condition, None where the listing cannot answer it."""
    negated = isinstance(pushed, ds.Not)
    inner = pushed.child if negated else pushed
    column = _COLUMNS.get(inner.attribute[0]) if getattr(inner, "attribute", None) and len(inner.attribute) == 1 else None
    if column is None:
        return None
    if isinstance(inner, (ds.IsNull, ds.IsNotNull)):
        return Condition(column, ds.IsNull, None, negated != isinstance(inner, ds.IsNotNull))
    if type(inner) not in _TESTS:
        return None
    value = tuple(inner.value) if isinstance(inner, ds.In) else inner.value
    if isinstance(value, datetime.datetime) and value.tzinfo is None:
        return None
    if negated and (value is None or isinstance(value, tuple) and None in value):
        return None
    return Condition(column, type(inner), value, negated)


# --- listing ---------------------------------------------------------------------------

def _system(root: str):
    from pyarrow import fs

    system, base = fs.FileSystem.from_uri(root if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", root) else os.path.abspath(root))
    return system, base.rstrip("/"), isinstance(system, fs.LocalFileSystem)


def entries_of(root: str, directory: str) -> Iterator[Entry]:
    """The entries of one directory, links and special files left out; lazily on local disks."""
    system, base, local = _system(root)
    place = f"{base}/{directory}".rstrip("/")
    if local:
        with os.scandir(place or "/") as found:
            for e in found:
                is_dir = e.is_dir(follow_symlinks=False)
                if is_dir or e.is_file(follow_symlinks=False):
                    stat = e.stat(follow_symlinks=False)
                    modified = datetime.datetime.fromtimestamp(stat.st_mtime_ns // 1000 / 1e6, datetime.timezone.utc)
                    path = f"{directory}/{e.name}" if directory else e.name
                    yield Entry(path, is_dir, 0 if is_dir else stat.st_size, modified, stat.st_mode & 0o7777)
        return
    from pyarrow import fs

    for e in system.get_file_info(fs.FileSelector(place)):
        if e.type in (fs.FileType.Directory, fs.FileType.File):
            yield Entry(e.path[len(base) + 1:], e.type == fs.FileType.Directory, e.size or 0, e.mtime, None)


@dataclass
class Unit(ds.InputPartition):
    """A task's work: files, or a directory to list, of which it takes one share."""

    files: tuple[Entry, ...] = ()
    directory: str | None = None
    share: int = 0
    shares: int = 1

    def __init__(self, files: Iterable[Entry] = (), directory: str | None = None, share: int = 0, shares: int = 1):
        super().__init__(None)
        self.files, self.directory, self.share, self.shares = tuple(files), directory, share, shares


@dataclass
class Scan:
    """What is wanted of a tree, and how its listing is cut into units."""

    root: str
    repo: str
    skip: frozenset[str]
    glob: str | None = None
    max_bytes: int = 64 * 1024 * 1024
    units: int = 256
    listed: int = 50_000
    conditions: list[Condition] = field(default_factory=list)

    def wanted(self, entry: Entry) -> bool:
        name = entry.path.rpartition("/")[2]
        return (self.glob is None or fnmatch.fnmatchcase(name, self.glob)) and all(c.holds(entry) for c in self.conditions)

    def entered(self, entry: Entry) -> bool:
        return entry.path.rpartition("/")[2] not in self.skip and all(c.reaches(entry.path) for c in self.conditions)

    def plan(self) -> list[Unit]:
        """Units that cover the tree; at most ``listed`` entries are looked at for it."""
        units: list[Unit] = []
        open_dirs, files, seen = deque([""]), [], 0
        while open_dirs and len(open_dirs) < self.units and seen < self.listed:
            directory, here, below = open_dirs.popleft(), [], []
            for entry in entries_of(self.root, directory):
                seen += 1
                if seen > self.listed:
                    break
                if entry.is_dir:
                    if self.entered(entry):
                        below.append(entry.path)
                elif self.wanted(entry):
                    here.append(entry)
            if seen > self.listed:  # cut short: tasks list this directory, each for a share of its names
                shares = max(1, self.units // (len(open_dirs) + 1))
                units += [Unit(directory=directory, share=i, shares=shares) for i in range(shares)]
                break
            files += here
            open_dirs.extend(below)
        units += [Unit(directory=d) for d in open_dirs]
        return units + [Unit(files=batch) for batch in self.batches(files)] or [Unit()]

    def batches(self, files: Sequence[Entry]) -> Iterator[list[Entry]]:
        batch, size = [], 0
        for entry in files:
            if batch and size + entry.length > self.max_bytes:
                yield batch
                batch, size = [], 0
            batch.append(entry)
            size += entry.length
        if batch:
            yield batch

    def files_of(self, unit: Unit) -> Iterator[Entry]:
        """The files of a unit; directories are listed one after the other, never all at once."""
        yield from unit.files
        todo = [] if unit.directory is None else [unit.directory]
        while todo:
            directory = todo.pop()
            for entry in entries_of(self.root, directory):
                # of a shared directory each entry, file or subtree, belongs to one task
                if directory == unit.directory and zlib.crc32(entry.path.encode("utf-8", "surrogateescape")) % unit.shares != unit.share:
                    continue
                if entry.is_dir:
                    if self.entered(entry):
                        todo.append(entry.path)
                elif self.wanted(entry):
                    yield entry

    def read(self, unit: Unit) -> Iterator[pa.RecordBatch]:
        """The rows of a unit, a bounded number of bytes at a time (a file is one row)."""
        system, base, _ = _system(self.root)
        rows, size = [], 0
        for entry in self.files_of(unit):
            with system.open_input_stream(f"{base}/{entry.path}", compression=None) as stream:
                content = stream.read()
            rows.append((self.repo, entry.path, entry.modified, entry.length, entry.mode, content))
            size += len(content) + 200
            if size >= _BATCH_BYTES:
                yield _record_batch(rows)
                rows, size = [], 0
        if rows:
            yield _record_batch(rows)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


# --- the data source -------------------------------------------------------------------

class TreeReader(ds.DataSourceReader):
    def __init__(self, scan: Scan):
        self.scan = scan

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for pushed in filters:
            condition = condition_of(pushed)
            if condition is None:
                yield pushed
            else:
                self.scan.conditions.append(condition)

    def partitions(self) -> Sequence[Unit]:
        return self.scan.plan()

    def read(self, partition: Unit) -> Iterator[pa.RecordBatch]:
        return self.scan.read(partition)


class TreeSource(ds.DataSource):
    """Options: ``path`` (a folder or URI), ``repo``, ``pathGlobFilter`` on names,
    ``skipDirs`` (comma-separated), ``maxPartitionBytes``, ``units``, ``maxListed``."""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        skip = self.options.get("skipDirs")
        return TreeReader(Scan(
            root=self.options["path"], repo=self.options.get("repo", ""),
            skip=frozenset(UNVISITED_DIRS if skip is None else (s for s in skip.split(",") if s)),
            glob=self.options.get("pathGlobFilter"),
            max_bytes=int(self.options.get("maxPartitionBytes", 64 * 1024 * 1024)),
            units=int(self.options.get("units", 256)), listed=int(self.options.get("maxListed", 50_000)),
        ))


def register_tree(spark: SparkSession) -> None:
    """Make ``format("tree")`` known to the session, with conditions pushed into it."""
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_tree_table(spark: SparkSession, root: str, repo: str = "", **options) -> DataFrame:
    """The files below ``root`` as a lazy table; conditions go into the scan."""
    register_tree(spark)
    return spark.read.format("tree").options(repo=repo, **options).load(root)
