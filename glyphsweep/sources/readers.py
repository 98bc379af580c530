"""Sources: text tables, commit tables, file tables, file trees."""

from __future__ import annotations

import fnmatch
import os
import re
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsweep.rules import UNVISITED_DIRS
from glyphsweep.sources.scratch import new_path

COMMITS_SCHEMA = "repo string, sha string, message string"
_CONTENT_BATCH = 16 * 1024 * 1024
_LISTING_BATCH = 10_000
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def read_text(
    spark: SparkSession, path: str, key: str | Sequence[str], text: str,
    keep: Sequence[str] = (), fmt: str = "parquet",
) -> DataFrame:
    """The key, the text and ``keep`` of a text table; other columns are not read."""
    keys = [key] if isinstance(key, str) else list(key)
    return spark.read.format(fmt).load(path).select(*keys, text, *keep)


def read_commits(
    spark: SparkSession, path: str, fmt: str = "parquet", order_by: str | None = None
) -> DataFrame:
    """Exported commits (repo, sha, message), oldest first by ``order_by`` if given."""
    schema = COMMITS_SCHEMA + (f", {order_by} bigint" if order_by else "")
    commits = spark.read.schema(schema).format(fmt).load(path)
    return commits.orderBy("repo", order_by) if order_by else commits


def read_files(
    spark: SparkSession, root: str, repo: str = "", glob: str | None = None
) -> DataFrame:
    """The files below ``root`` as (repo, path, mode, length, content), whatever their names.

    ``glob`` is matched against the name; only the matching files are read.
    """
    if not re.match(_SCHEME, root):
        root = os.path.abspath(root)
    where = None
    if glob:
        where = F.element_at(F.split("path", "/"), -1).rlike(fnmatch.translate(glob).replace(r"\z", r"\Z"))
    return read_tree(spark, {repo: root}, where=where)


def _expand(skip_dirs: frozenset[str]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The entries of directories, a batch of entries at a time.

    Directories to be skipped are not listed; links are not followed nor returned.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        columns = ["repo", "root", "path", "length", "is_dir"]
        for batch in batches:
            for row in batch.itertuples(index=False):
                system, base = fs.FileSystem.from_uri(row.root)
                local = isinstance(system, fs.LocalFileSystem)
                base = base.rstrip("/")
                rows = []
                for e in system.get_file_info(fs.FileSelector(f"{base}/{row.path}".rstrip("/"))):
                    is_dir = e.type == fs.FileType.Directory
                    regular = is_dir or e.type == fs.FileType.File
                    if not regular or (local and os.path.islink(e.path)) or (is_dir and e.base_name in skip_dirs):
                        continue
                    rows.append((row.repo, row.root, e.path[len(base) + 1:], e.size or 0, is_dir))
                    if len(rows) == _LISTING_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return run


def _read_contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    columns = ["repo", "path", "length", "content"]
    for batch in batches:
        rows, size = [], 0
        for row in batch.itertuples(index=False):
            system, base = fs.FileSystem.from_uri(row.root)
            with system.open_input_stream(f"{base.rstrip('/')}/{row.path}", compression=None) as stream:
                content = stream.read()
            rows.append((row.repo, row.path, row.length, content))
            size += len(content)
            if size >= _CONTENT_BATCH:
                yield pd.DataFrame(rows, columns=columns)
                rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)


def list_tree(
    spark: SparkSession, roots: Mapping[str, str] | DataFrame, skip_dirs: Iterable[str] = UNVISITED_DIRS,
) -> DataFrame:
    """The regular files of many trees (repo, root, path, length), dot names included.

    ``roots`` is a table or mapping of repository name to the URI of its tree. Trees are
    expanded level by level until no directory is left: every level is one job whose
    directories are dealt to all tasks and whose entries are written to the shared
    folder, so no task walks a subtree and a lost executor repeats part of a level.
    Directories named in ``skip_dirs`` are not entered.
    """
    if not isinstance(roots, DataFrame):
        roots = spark.createDataFrame(list(roots.items()), "repo string, root string")
    schema = "repo string, root string, path string, length bigint, is_dir boolean"
    level = roots.select(
        "repo", "root", F.lit("").alias("path"), F.lit(0).cast("long").alias("length"),
        F.lit(True).alias("is_dir"),
    )
    place, depth = new_path(spark, "listing"), 0
    while True:
        entries = level.where("is_dir").repartition("repo", "path").mapInPandas(_expand(frozenset(skip_dirs)), schema)
        entries.write.parquet(f"{place}/level={depth}")
        level = spark.read.schema(schema).parquet(f"{place}/level={depth}")
        if level.where("is_dir").isEmpty():
            break
        depth += 1
    levels = [f"{place}/level={i}" for i in range(depth + 1)]
    return spark.read.schema(schema).parquet(*levels).where("NOT is_dir").select("repo", "root", "path", "length")


def read_tree(
    spark: SparkSession, roots: Mapping[str, str] | DataFrame, where: Column | None = None,
    modes: DataFrame | None = None, skip_dirs: Iterable[str] = UNVISITED_DIRS,
) -> DataFrame:
    """The files of many trees as (repo, path, mode, length, content), dot names included.

    ``where`` is a condition on repo, path and length; only files that meet it are read.
    ``modes`` is an inventory (repo, path, mode) that the modes come from; else they are
    null. The listing is dealt by file, so all tasks read the files of a large tree.
    """
    listing = list_tree(spark, roots, skip_dirs)
    if where is not None:
        listing = listing.where(where)
    contents = listing.repartition("repo", "path").mapInPandas(
        _read_contents, "repo string, path string, length bigint, content binary"
    )
    if modes is None:
        contents = contents.withColumn("mode", F.lit(None).cast("int"))
    else:
        contents = contents.join(modes.select("repo", "path", F.col("mode").cast("int")), ["repo", "path"], "left")
    return contents.select("repo", "path", "mode", "length", "content")
