"""Use an expression several times without repeating it in the plan.

The larger functions are written as SQL text over a named value. That keeps a
function one expression, lets its Column form and its SQL name share the text, and
needs a handful of calls to the JVM where building it from Columns needs hundreds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sql_string(value: str) -> str:
    """``value`` as a SQL string literal, unprintable characters as escapes."""
    out = []
    for ch in value:
        if ch in "\\'":
            out.append("\\" + ch)
        elif " " <= ch <= "~":
            out.append(ch)
        else:
            out.append(f"\\u{ord(ch):04X}" if ord(ch) < 0x10000 else f"\\U{ord(ch):08X}")
    return "'" + "".join(out) + "'"


def sql_let(value: str, name: str, body: str) -> str:
    """SQL text of ``body`` with ``name`` standing for ``value``, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sql_over(c: Column | str, body: str, name: str = "t") -> Column:
    """The SQL text ``body`` over a column it calls ``name``, evaluated once per row."""
    bound = F.call_function("transform", F.array(as_column(c)), F.expr(f"{name} -> {body}"))
    return F.get(bound, F.lit(0))


def any_of(conditions: list[Column]) -> Column:
    """OR over ``conditions``; false when there are none."""
    result = F.lit(False)
    for i, condition in enumerate(conditions):
        result = condition if i == 0 else result | condition
    return result


def where_computed(df: DataFrame, flag: str) -> DataFrame:
    """The rows of ``df`` whose boolean column ``flag`` holds, without the column.

    A filter would be pushed below the projection that computes the flag and carry the
    whole computation with it, so an expensive one would run twice. A generator that
    yields something only for the kept rows stays where it is.
    """
    names = [c for c in df.columns if c != flag]
    kept = F.explode_outer(F.when(F.col(flag), F.array(F.lit(True)))).alias("_kept")
    return df.select(*names, kept).where(F.col("_kept").isNotNull()).select(*names)
