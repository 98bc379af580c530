"""Operators over commit-message tables (repo, sha, message)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsweep.functions.messages import (
    clean_message,
    dropped_lines,
    has_traces,
    is_trace_line,
    matching_rules,
    mentions_trace_word,
)
from glyphsweep.rules import LineRule


def clean_commits(
    commits: DataFrame, extra: Iterable[LineRule] = (), exclude: Iterable[str] = ()
) -> DataFrame:
    """Add the cleaned message, whether it carried traces, and the lines dropped."""
    extra = tuple(extra)
    return commits.withColumns({
        "cleaned": clean_message("message", extra, exclude),
        "has_traces": has_traces("message", extra, exclude),
        "n_dropped": dropped_lines("message", extra, exclude),
    })


def trace_hits(
    commits: DataFrame, extra: Iterable[LineRule] = (), exclude: Iterable[str] = (),
    keys: Sequence[str] = ("repo", "sha"),
) -> DataFrame:
    """Which rule hit which message line: one row per (commit, line, rule).

    The rules are literals of the plan, tried on the line itself; lines are first cut
    to those any rule matches.
    """
    extra = tuple(extra)
    if not extra:
        commits = commits.where(mentions_trace_word("message"))
    lines = commits.select(*keys, F.posexplode(F.split("message", "\n")).alias("pos", "line"))
    return lines.where(is_trace_line("line", extra, exclude)).select(
        *keys,
        (F.col("pos") + 1).alias("line_no"),
        "line",
        F.inline(matching_rules("line", extra, exclude)),
    )


def commit_summary(
    commits: DataFrame, by: Sequence[str] = (), extra: Iterable[LineRule] = (),
    exclude: Iterable[str] = (),
) -> DataFrame:
    """Commits and commits with traces, per group."""
    return commits.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_commits"),
        F.count_if(has_traces("message", extra, exclude)).alias("n_with_traces"),
    )
