"""Originals from a stream of saves: the first save of a file wins, whatever is sent again."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glyphsweep.plans.store import KEYS, ORIGINALS_SCHEMA, Attempt, originals_dir

_KEY = ("run_id", *KEYS)
#: Groups that the files of a stream are dealt to; a checkpoint holds for one number only.
BUCKETS = 1_024
_NAME_BYTES = 32
_ALWAYS = (1 << 63) - 1
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _name() -> Column:
    """32 bytes that stand for a file; null is a value like others."""
    parts = [F.coalesce(F.hex(F.col(k).cast("string")), F.lit("-")) for k in _KEY]
    return F.unhex(F.sha2(F.concat_ws(":", *parts), 256))


def _first(columns: list[str], keep_ms: int):
    def earliest(rows: pd.DataFrame) -> pd.DataFrame:  # of each file the row of least order, of equal ones the first
        return rows.sort_values("_order", kind="stable").drop_duplicates("_name")

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        names, until = state.get if state.exists else (b"", b"")
        names = bytes(names)
        ends = np.frombuffer(bytes(until), "<i8").tolist()
        seen = {names[_NAME_BYTES * i:_NAME_BYTES * (i + 1)]: end for i, end in enumerate(ends)}
        again, best, latest = set(), None, {}
        for batch in batches:
            if not len(batch):  # so it is when only time has passed
                continue
            known = batch["_name"].map(seen.__contains__)  # isin would take bytes without their last zeros
            again.update(batch.loc[known, "_name"])
            batch = batch[~known]
            for name, ms in batch.groupby("_name")["_ms"].max().items():
                latest[name] = max(latest.get(name, now), now if pd.isna(ms) else int(ms))
            best = earliest(batch if best is None else pd.concat([best, earliest(batch)]))
        seen |= {name: _ALWAYS for name in again}
        seen |= {name: ms + keep_ms for name, ms in latest.items()}
        seen = {name: end for name, end in seen.items() if end >= now}
        if seen:
            state.update((b"".join(seen), np.fromiter(seen.values(), "<i8", len(seen)).tobytes()))
            following = min(seen.values())
            if following < _ALWAYS:
                state.setTimeoutTimestamp(following)
        elif state.exists:
            state.remove()
        if latest:
            yield best[columns]

    return run


def first_saved_stream(
    saves: DataFrame, ts: str = "ts", order: str = "step_ord", delay: str = "10 minutes", keep_seconds: int = 86_400,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``first_saved`` of a stream: one row per (run_id, repo, path).

    The first save that arrives wins, of several in one micro-batch the one of the least
    ``order``. What is kept of a file is that it was seen, until the watermark (``delay``
    behind the newest save) is ``keep_seconds`` past its save; a repeat after that would
    count as a first save, a repeat before it has the file remembered for good. Rows later
    than the watermark are taken too.

    Files are dealt to ``buckets`` groups by a hash of their key, since a group costs a task
    milliseconds whatever it holds: 32 + 8 bytes are kept of a file, and a task holds the
    new files of one bucket and one micro-batch at a time. The number stays as it is for as
    long as a checkpoint is used.
    """
    # as text, since pandas would turn whole numbers beside nulls into doubles
    as_text = [f.name for f in saves.schema if isinstance(f.dataType, _INTEGRAL)]
    name = _name()
    watched = saves.withWatermark(ts, delay).select(
        *[F.col(c).cast("string").alias(c) if c in as_text else F.col(c) for c in saves.columns],
        F.col(order).alias("_order"), F.unix_millis(F.col(ts).cast("timestamp")).alias("_ms"), name.alias("_name"),
        F.pmod(F.xxhash64(name), F.lit(buckets)).alias("_bucket"))
    kept = T.StructType([T.StructField(f.name, T.StringType() if f.name in as_text else f.dataType) for f in saves.schema])
    first = watched.groupBy("_bucket").applyInPandasWithState(
        _first(saves.columns, keep_seconds * 1000), kept, "names binary, until binary", "append", GroupStateTimeout.EventTimeTimeout)
    return first.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in saves.schema])


def save_stream(saves: DataFrame, store: str, attempt: Attempt, checkpoint: str, **options) -> Attempt:
    """Write the first saves of a stream as an attempt's originals, as far as there is input.

    Called again with the same attempt and checkpoint it goes on where it ended; files
    that a crash leaves behind are not part of the table. The attempt counts once it is
    recorded, with the number of originals returned here.
    """
    spark = saves.sparkSession
    target = originals_dir(store, attempt.run_id, attempt.attempt)
    first = first_saved_stream(saves, **options).where(F.col("run_id") == attempt.run_id)
    columns = [f.split()[0] for f in ORIGINALS_SCHEMA.split(", ") if f.split()[0] in saves.columns]
    first.select(*columns).writeStream.format("parquet").outputMode("append").option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start(target).awaitTermination()
    return replace(attempt, n_entries=_saved(spark, target))


def _saved(spark: SparkSession, target: str) -> int:
    return spark.read.schema(ORIGINALS_SCHEMA).parquet(target).count()
