"""Sinks. None of them writes over anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_cleaned(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a cleaned table to a new place; a place that exists is an error."""
    df.write.format(fmt).mode("errorifexists").save(path)


def write_findings(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write findings as Parquet or JSON lines."""
    if fmt not in ("parquet", "json"):
        raise ValueError(f"findings are written as parquet or json, not {fmt!r}")
    write_cleaned(df, path, fmt)


def write_summary(df: DataFrame, path: str) -> None:
    """Write actions or a summary as JSON lines."""
    write_cleaned(df, path, "json")


LEVELS = ("DEBUG", "INFO", "WARN")


def write_events(events: DataFrame, path: str, closing: DataFrame | None = None, least: str = "DEBUG") -> None:
    """Write events of at least a level as JSON lines to a new place, in one pass.

    ``closing`` events, few, go to a file of their own behind the others.
    """
    shown = list(LEVELS[LEVELS.index(least):])
    write_cleaned(events.where(F.col("level").isin(*shown)), path, "json")
    if closing is not None:
        closing.where(F.col("level").isin(*shown)).coalesce(1).write.mode("append").json(path)


def write_bucketed(files: DataFrame, table: str, path: str, buckets: int) -> DataFrame:
    """Write a file table in buckets of (repo, path) under a catalog name, and read it.

    Joins on these two columns take the files as they lie: a restore moves its originals
    to the files, not the files. A name or place that exists is an error. ``buckets``
    should give files of some hundred megabytes; a repository is spread over all of them.
    """
    files.write.mode("errorifexists").option("path", path).bucketBy(buckets, "repo", "path").sortBy("repo", "path").saveAsTable(table)
    return files.sparkSession.table(table)
