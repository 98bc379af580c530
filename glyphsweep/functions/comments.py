"""Comment functions: remove the comments whose text carries a token.

The functions are SQL text over the value named ``t`` (see ``bind``).
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphsweep.functions.bind import as_column, sql_let, sql_over, sql_string
from glyphsweep.functions.dialect import blank_class, search_any
from glyphsweep.functions.messages import mention_sql, mentions_trace_word
from glyphsweep.rules import (
    COMMENT_SYNTAX,
    SOURCE_EXTENSIONS,
    CommentSyntax,
    LineRule,
    comment_rules,
)

_BLANK = blank_class()
_BLANK_LINE = sql_string(rf"\A{_BLANK}*+\z")
_BLANK_BUT_LF = rf"[{_BLANK}&&[^\n]]"
# The first blank line of a run is kept as it is, the others go.
_BLANK_RUN = rf"(?dm)^({_BLANK_BUT_LF}*+)(?:\n{_BLANK_BUT_LF}*+(?=\n|\z))++"


def has_ai_token(
    c: Column | str, extra: Iterable[LineRule] = (), exclude: Iterable[str] = ()
) -> Column:
    """Whether a comment text carries a token."""
    c = as_column(c)
    extra = tuple(extra)
    found = c.rlike(search_any(comment_rules(extra, exclude)))
    return found if extra else mentions_trace_word(c) & found


def trim_trailing(c: Column | str) -> Column:
    """The text without trailing spaces and tabs."""
    return F.rtrim(as_column(c), F.lit(" \t"))


def _trim_sql(text: str) -> str:
    return f"rtrim(' \\t', {text})"


def _marked_sql(text: str, extra: Iterable[LineRule], exclude: Iterable[str]) -> str:
    """SQL text for ``has_ai_token`` of the value ``text``."""
    extra = tuple(extra)
    found = f"{text} RLIKE {sql_string(search_any(comment_rules(extra, exclude)))}"
    return found if extra else f"({mention_sql(text)} AND {found})"


def _blocks_sql(
    opening: str, closing: str, extra: Iterable[LineRule], exclude: Iterable[str]
) -> str:
    # An unclosed block is matched to the end of the text, so its opening is not tried
    # again from every later one; it is told apart by its end.
    span = sql_string(rf"(?s){re.escape(opening)}.*?(?:{re.escape(closing)}|\z)")
    parts = f"named_struct('gaps', split(t, {span}), 'blocks', regexp_extract_all(t, {span}, 0))"
    verdict = f"""CASE
        WHEN NOT (endswith(block, {sql_string(closing)})
          AND char_length(block) >= {len(opening) + len(closing)}
          AND {_marked_sql("block", extra, exclude)}) THEN 'keep'
        WHEN substring_index(p.gaps[i], '\\n', -1) RLIKE {_BLANK_LINE} THEN 'alone'
        ELSE 'inline' END"""
    # A block alone on its lines takes the line feed after it from the next gap.
    rest = (
        "CASE WHEN get(v, i - 1) = 'alone' AND startswith(gap, '\\n') THEN substr(gap, 2) ELSE gap END"
    )
    piece = f"""CASE get(v, i)
        WHEN 'alone' THEN
          substr(rest, 1, char_length(rest) - char_length(substring_index(rest, '\\n', -1)))
        WHEN 'inline' THEN {_trim_sql("rest")}
        WHEN 'keep' THEN concat(rest, p.blocks[i])
        ELSE rest END"""
    joined = f"array_join(transform(p.gaps, (gap, i) -> {sql_let(rest, 'rest', piece)}), '')"
    verdicts = f"transform(p.blocks, (block, i) -> {verdict})"
    stripped = sql_let(parts, "p", sql_let(verdicts, "v", joined))
    return f"CASE WHEN contains(t, {sql_string(opening)}) THEN {stripped} ELSE t END"


def strip_blocks(
    c: Column | str, opening: str, closing: str,
    extra: Iterable[LineRule] = (), exclude: Iterable[str] = (),
) -> Column:
    """The text without the delimited blocks whose text carries a token.

    A block alone on its lines goes with its indentation and the line feed after it;
    one behind code goes with the blanks before it. A block that is never closed stays.
    """
    return sql_over(c, _blocks_sql(opening, closing, tuple(extra), exclude))


def comment_start_pattern(token: str) -> str:
    """A Java regex splitting a line into code (group 1) and line comment (group 2).

    The comment starts at the first ``token`` outside quotes; a line without one, or
    with an open quote, does not match. The quantifiers are possessive, so a long line
    neither backtracks nor recurses.
    """
    lead = token[0]
    partial = f"|{lead}(?!{re.escape(token[1:])})" if len(token) > 1 else ""
    quoted = r"""|"(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|`[^`]*+`"""
    return rf"""(?s)\A((?:[^"'`{lead}]++{partial}{quoted})*+)({re.escape(token)}.*)\z"""


def _line_comments_sql(
    token: str, extra: Iterable[LineRule], exclude: Iterable[str]
) -> str:
    start = sql_string(comment_start_pattern(token))
    code = f"regexp_extract(line, {start}, 1)"
    # The comment is empty where the line has none.
    marked = sql_let(
        f"regexp_extract(line, {start}, 2)", "comment",
        f"comment <> '' AND {_marked_sql('comment', extra, exclude)}",
    )
    cleaned = f"""CASE
        WHEN NOT (contains(line, {sql_string(token)}) AND {marked}) THEN line
        WHEN {code} RLIKE {_BLANK_LINE} THEN NULL
        ELSE {_trim_sql(code)} END"""
    return f"array_join(array_compact(transform(split(t, '\\n'), line -> {cleaned})), '\\n')"


def strip_line_comments(
    c: Column | str, token: str,
    extra: Iterable[LineRule] = (), exclude: Iterable[str] = (),
) -> Column:
    """The text without the line comments that carry a token.

    A line that is nothing but such a comment goes; behind code, the comment goes with
    the blanks before it.
    """
    return sql_over(c, _line_comments_sql(token, tuple(extra), exclude))


def collapse_blank_lines(c: Column | str) -> Column:
    """The text with every run of blank lines cut to its first."""
    return F.regexp_replace(as_column(c), _BLANK_RUN, "$1")


def _clean_sql(
    syntax: CommentSyntax, extra: Iterable[LineRule], exclude: Iterable[str]
) -> str:
    steps = []
    if syntax.block_open:
        steps.append(_blocks_sql(syntax.block_open, syntax.block_close, extra, exclude))
    if syntax.doc_open:
        steps.append(_blocks_sql(syntax.doc_open, syntax.doc_close, extra, exclude))
    if syntax.html:
        steps.append(_blocks_sql("<!--", "-->", extra, exclude))
    steps.append(_line_comments_sql(syntax.line_token, extra, exclude))
    text = "t"
    for step in steps:
        text = sql_let(text, "t", step)
    collapsed = f"regexp_replace(done, {sql_string(_BLANK_RUN)}, '$1')"
    return sql_let(text, "done", f"CASE WHEN done = t THEN done ELSE {collapsed} END")


def clean_comments(
    c: Column | str, ext: Column | str,
    extra: Iterable[LineRule] = (), exclude: Iterable[str] = (),
) -> Column:
    """A source text without its marked comments, by the syntax of ``ext``.

    Blank runs are collapsed over the whole text if anything was removed. Text with
    another extension, or without any token, comes back as it is.
    """
    c, ext = as_column(c), as_column(ext)
    extra, exclude = tuple(extra), tuple(exclude)

    def style(s: CommentSyntax) -> tuple:
        return (s.line_token, s.block_open or "", s.doc_open or "", s.html)

    known = ext.isin(*SOURCE_EXTENSIONS)
    cleaned = F.when(~(known & has_ai_token(c, extra, exclude)), c)
    for _, group in groupby(sorted(COMMENT_SYNTAX, key=style), key=style):
        members = list(group)
        cleaned = cleaned.when(
            ext.isin(*[s.ext for s in members]),
            sql_over(c, _clean_sql(members[0], extra, exclude)),
        )
    return cleaned.otherwise(c)
