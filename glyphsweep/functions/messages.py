"""Commit-message functions.

``*_sql`` give the SQL text of a function over the value named ``t``.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphsweep.functions.bind import as_column, sql_let, sql_over, sql_string
from glyphsweep.functions.dialect import line_search
from glyphsweep.rules import BLANK_RANGES, TRACE_WORDS, LineRule, commit_rules

BLANKS = "".join(chr(cp) for lo, hi in BLANK_RANGES for cp in range(lo, hi + 1))

# Lines of the text ``t``.
_LINES = "split(t, '\\n')"


def mention_sql(text: str = "t") -> str:
    found = " OR ".join(f"contains(low, {sql_string(word)})" for word in TRACE_WORDS)
    return sql_let(f"lower({text})", "low", found)


def mentions_trace_word(c: Column | str) -> Column:
    """A cheap necessary condition for any built-in pattern or comment token to match."""
    return sql_over(c, mention_sql())


def _searches(rules: Iterable[LineRule]) -> list[str]:
    return line_search(rules, trusted=commit_rules())


def _trace_sql(line: str, rules: Iterable[LineRule]) -> str:
    found = " OR ".join(f"{line} RLIKE {sql_string(p)}" for p in _searches(rules))
    if not found:
        return "false"
    built_in = set(rules) <= set(commit_rules())
    return f"({mention_sql(line)} AND ({found}))" if built_in else f"({found})"


def is_trace_line(
    c: Column | str, extra: Iterable[LineRule] = (), exclude: Iterable[str] = ()
) -> Column:
    """Whether one message line matches a commit rule."""
    return sql_over(c, _trace_sql("t", commit_rules(extra, exclude)))


def matching_rules(
    line: Column | str, extra: Iterable[LineRule] = (), exclude: Iterable[str] = ()
) -> Column:
    """The commit rules a line matches, as an array of (rule_id, family)."""
    hits = ", ".join(
        f"CASE WHEN {' OR '.join(f't RLIKE {sql_string(p)}' for p in _searches([rule]))} "
        "THEN named_struct("
        f"'rule_id', {sql_string(rule.rule_id)}, 'family', {sql_string(rule.family)}) END"
        for rule in commit_rules(extra, exclude)
    )
    return sql_over(line, f"array_compact(array({hits}))")


def normalize_message_sql() -> str:
    # White space after the last visible character belongs to its line up to the first
    # line feed.
    rest = "substr(t, char_length(body) + 1)"
    finished = (
        "CASE WHEN body = '' THEN '\\n' "
        f"ELSE concat(body, substring_index({rest}, '\\n', 1), '\\n') END"
    )
    return sql_let(f"rtrim({sql_string(BLANKS)}, t)", "body", finished)


def normalize_message(c: Column | str) -> Column:
    """The message without trailing blank lines, ended by one line feed."""
    return sql_over(c, normalize_message_sql())


def clean_message_sql(extra: Iterable[LineRule] = (), exclude: Iterable[str] = ()) -> str:
    extra = tuple(extra)
    dropped = _trace_sql("line", commit_rules(extra, exclude))
    kept = f"array_join(filter({_LINES}, line -> NOT {dropped}), '\\n')"
    if not extra:
        kept = f"CASE WHEN {mention_sql()} THEN {kept} ELSE t END"
    return sql_let(kept, "t", normalize_message_sql())


def clean_message(
    c: Column | str, extra: Iterable[LineRule] = (), exclude: Iterable[str] = ()
) -> Column:
    """The message without the lines that match a commit rule, normalized."""
    return sql_over(c, clean_message_sql(extra, exclude))


def has_traces(
    c: Column | str, extra: Iterable[LineRule] = (), exclude: Iterable[str] = ()
) -> Column:
    """Whether cleaning changes the message beyond normalizing it."""
    extra = tuple(extra)
    changed = sql_over(c, f"{clean_message_sql(extra, exclude)} <> {normalize_message_sql()}")
    return changed if extra else mentions_trace_word(c) & changed


def dropped_lines(
    c: Column | str, extra: Iterable[LineRule] = (), exclude: Iterable[str] = ()
) -> Column:
    """How many lines of the message match a commit rule."""
    extra = tuple(extra)
    dropped = _trace_sql("line", commit_rules(extra, exclude))
    n = sql_over(c, f"size(filter({_LINES}, line -> {dropped}))")
    return n if extra else F.when(~mentions_trace_word(c), F.lit(0)).otherwise(n)


def short_sha(c: Column | str) -> Column:
    """The first seven characters of a commit id."""
    return F.substring(as_column(c), 1, 7)
