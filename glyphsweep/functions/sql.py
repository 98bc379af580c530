"""The functions under SQL names, as Spark SQL functions that Catalyst inlines."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

from pyspark.sql import SparkSession

from glyphsweep.functions.hidden import (
    contains_hidden_sql,
    count_hidden_sql,
    find_hidden_sql,
    strip_hidden_sql,
)
from glyphsweep.functions.messages import clean_message_sql

_FINDING_COLUMNS = "rune INT, u STRING, offset BIGINT, line BIGINT, col BIGINT, category STRING"


#: Options that a call may set, in the order of the parameters.
OPTIONS = ("typography", "keep_zwj", "keep_variation_selectors")


def _by_options(body: Callable[..., str], fixed: dict) -> str:
    """SQL text that takes the body for the options given; with literals one of them is left."""
    cases = []
    for chosen in product((False, True), repeat=len(OPTIONS)):
        test = " AND ".join(name if on else f"NOT {name}" for name, on in zip(OPTIONS, chosen, strict=True))
        cases.append(f"WHEN {test} THEN ({body(**dict(zip(OPTIONS, chosen, strict=True)), **fixed)})")
    return f"CASE {' '.join(cases)} END"


def register_sql_functions(spark: SparkSession, prefix: str = "", **opts) -> list[str]:
    """Create temporary SQL functions and return their names.

    ``strip_hidden``, ``contains_hidden``, ``count_hidden`` and ``clean_message`` are
    scalar; ``find_hidden`` is a table function to be used with ``LATERAL``. All but
    ``clean_message`` take the options as further arguments, by place or by name
    (``strip_hidden(t, keep_zwj => true)``); ``opts`` are what they are if left out.
    """
    fixed = {k: v for k, v in opts.items() if k not in OPTIONS}
    parameters = ", ".join(["t STRING", *(f"{o} BOOLEAN DEFAULT {str(bool(opts.get(o, False))).lower()}" for o in OPTIONS)])

    def found(**chosen) -> str:
        return f"CASE WHEN {contains_hidden_sql(**chosen)} THEN {find_hidden_sql(**chosen)} END"

    bodies = {
        "contains_hidden": (parameters, f"BOOLEAN RETURN {_by_options(contains_hidden_sql, fixed)}"),
        "strip_hidden": (parameters, f"STRING RETURN {_by_options(strip_hidden_sql, fixed)}"),
        "count_hidden": (parameters, f"INT RETURN {_by_options(count_hidden_sql, fixed)}"),
        "clean_message": ("t STRING", f"STRING RETURN {clean_message_sql()}"),
        "find_hidden": (parameters, f"TABLE ({_FINDING_COLUMNS}) RETURN SELECT * FROM inline({_by_options(found, fixed)})"),
    }
    for name, (given, body) in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS {body}")
    return [prefix + name for name in bodies]
