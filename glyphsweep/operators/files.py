"""Operators over file tables (repo, path, mode, content BINARY)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsweep.functions.bind import as_column
from glyphsweep.functions.comments import clean_comments
from glyphsweep.functions.hidden import contains_hidden, is_binary, strip_hidden
from glyphsweep.functions.paths import (
    base_name,
    extension,
    in_skipped_dir,
    in_tool_dir,
    is_prose,
    is_source,
    removed_as_artifact,
    removed_as_markdown,
)
from glyphsweep.rules import COMMENT_SYNTAX, STORE_DIR, TOOL_FILES, TOOL_PATHS, LineRule

KEYS = ("repo", "path")


def syntax_table(spark: SparkSession) -> DataFrame:
    """The comment syntax by extension as a table."""
    rows = [
        (s.ext, s.line_token, s.block_open, s.block_close, s.doc_open, s.doc_close, s.html)
        for s in COMMENT_SYNTAX
    ]
    return spark.createDataFrame(
        rows,
        "ext string, line_token string, block_open string, block_close string, "
        "doc_open string, doc_close string, html boolean",
    )


def with_syntax(files: DataFrame) -> DataFrame:
    """Source files with the comment syntax of their extension; others are dropped.

    The broadcast side is the built-in table, fifteen rows.
    """
    syntax = F.broadcast(syntax_table(files.sparkSession))
    return files.withColumn("ext", extension("path")).join(syntax, "ext", "inner")


def name_rules(spark: SparkSession) -> DataFrame:
    """The exact file names the artifacts step removes."""
    return spark.createDataFrame([(n,) for n in TOOL_FILES], "base string")


def match_rules(files: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Files whose name is in a table of names (``base``), outside skipped directories."""
    if rules is None:
        names = F.broadcast(name_rules(files.sparkSession))
    else:
        names = rules.select("base")
    visited = files.where(~in_skipped_dir("path")).withColumn("base", base_name("path"))
    return visited.join(names, "base", "left_semi").select(*files.columns)


def removals(
    files: DataFrame, root_only: bool = True, store_dir: str = STORE_DIR
) -> DataFrame:
    """Files to remove, with the step and the rule: tool directories, tool files, fixed
    paths and generic Markdown.

    The union of the four rules is one CASE over the path, first rule first, so the
    table is read once, no file appears twice, and nothing is shuffled.
    """
    path = F.col("path")
    rule = (
        F.when(in_tool_dir(path, root_only), F.lit("tool-dir"))
        .when(path.isin(*TOOL_PATHS), F.lit("tool-path"))
        .when(removed_as_artifact(path, root_only, store_dir), F.lit("tool-file"))
        .when(removed_as_markdown(path, store_dir), F.lit("markdown"))
    )
    step = F.when(F.col("rule") == "markdown", F.lit("markdown")).otherwise(F.lit("artifacts"))
    ruled = files.select(*KEYS, rule.alias("rule")).where(F.col("rule").isNotNull())
    return ruled.select(*KEYS, step.alias("step"), "rule")


def apply_removals(files: DataFrame, removed: DataFrame) -> DataFrame:
    """The files that are not removed."""
    return files.join(removed.select(*KEYS), list(KEYS), "left_anti")


def changed(before: Column | str, after: Column | str) -> Column:
    """Whether two values differ, nulls being equal to each other."""
    return ~as_column(before).eqNullSafe(as_column(after))


def text_rows(files: DataFrame, store_dir: str = STORE_DIR) -> DataFrame:
    """Files the hidden-character step reads: outside skipped directories, not binary."""
    return files.where(~in_skipped_dir("path", store_dir) & ~is_binary("content"))


def hidden_in_file(path: Column | str, text: Column, normalize_typography: bool) -> Column:
    """``contains_hidden`` with typography counted in prose files if asked for."""
    if not normalize_typography:
        return contains_hidden(text)
    return F.when(is_prose(path), contains_hidden(text, typography=True)).otherwise(
        contains_hidden(text)
    )


def strip_in_file(path: Column | str, text: Column, normalize_typography: bool) -> Column:
    """``strip_hidden`` with typography folded in prose files if asked for."""
    if not normalize_typography:
        return strip_hidden(text)
    return F.when(is_prose(path), strip_hidden(text, typography=True)).otherwise(
        strip_hidden(text)
    )


def clean_files(
    files: DataFrame, normalize_typography: bool = False, store_dir: str = STORE_DIR
) -> DataFrame:
    """Text files with their cleaned content and whether it differs."""
    text = F.col("content").cast("string")
    return text_rows(files, store_dir).withColumns({
        "cleaned": strip_in_file("path", text, normalize_typography).cast("binary"),
        "changed": hidden_in_file("path", text, normalize_typography),
    })


def source_text(content: Column | str) -> Column:
    """Content as text; bytes that are not UTF-8 are read one character each."""
    content = as_column(content)
    text = content.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(content, "ISO-8859-1"))


def source_bytes(text: Column | str, content: Column | str) -> Column:
    """The bytes of an edited ``source_text(content)``."""
    text, valid = as_column(text), F.is_valid_utf8(as_column(content).cast("string"))
    return F.when(valid, text.cast("binary")).otherwise(F.encode(text, "ISO-8859-1"))


def clean_comment_files(
    files: DataFrame, extra: Iterable[LineRule] = (), exclude: Iterable[str] = (),
    store_dir: str = STORE_DIR,
) -> DataFrame:
    """Source files with their content cleaned of marked comments and whether it differs."""
    sources = files.where(is_source("path") & ~in_skipped_dir("path", store_dir))
    names = files.columns
    edited = sources.select(*names, source_text("content").alias("_text")).select(
        *names, "_text", clean_comments("_text", extension("path"), extra, exclude).alias("_edited")
    )
    return edited.select(
        *names,
        source_bytes("_edited", "content").alias("cleaned"),
        (F.col("_edited") != F.col("_text")).alias("changed"),
    )
