"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

KINDS = {
    "bigint": "int", "int": "int", "string": "str", "boolean": "bool", "double": "float",
    "BIGINT": "int", "VARCHAR": "str", "BOOLEAN": "bool", "DOUBLE": "float",
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return db


def differences(df: DataFrame, db: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a DataFrame and a SQL result, in words; empty if nothing."""
    result = db.sql(sql)
    theirs = dict(zip(result.columns, map(str, result.types), strict=True))
    ours = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    if sorted(ours) != sorted(theirs):
        return [f"columns {sorted(ours)} against {sorted(theirs)}"]
    names = sorted(ours)
    kinds = [f"{n}: {ours[n]} against {theirs[n]}" for n in names
             if KINDS.get(ours[n]) != KINDS.get(theirs[n])]
    if kinds:
        return kinds
    quoted = ", ".join(f'"{n}"' for n in names)
    expected = Counter(db.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
    actual = Counter(tuple(r) for r in df.select(*names).collect())
    missing, extra = expected - actual, actual - expected
    out = []
    if missing:
        out.append(f"{missing.total()} of {expected.total()} rows missing, such as {next(iter(missing))!r:.600}")
    if extra:
        out.append(f"{extra.total()} of {actual.total()} rows extra, such as {next(iter(extra))!r:.600}")
    return out
