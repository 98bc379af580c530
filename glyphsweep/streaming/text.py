"""Text streams.

The column functions are stateless, so ``clean_text``, ``with_findings``,
``find_hidden``, ``clean_commits`` and the predicates take a streaming DataFrame as it
is. What is here is opening a stream and the one aggregation over event time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from glyphsweep.operators.text import profile_categories, profile_counts, unpivot_profile


def read_text_stream(
    spark: SparkSession, path: str, schema: str, fmt: str = "parquet", glob: str | None = None
) -> DataFrame:
    """A stream of the files appearing in a directory."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def profile_hidden_stream(
    df: DataFrame, col: str, ts: str, window: str, delay: str,
    by: Sequence[str] = (), **opts,
) -> DataFrame:
    """Hits and dirty texts per event-time window, category and group.

    The state is one row of counters per open window and group. In append mode a window
    is given once, when the watermark (``delay`` behind the newest event of the batches
    before) has passed its end, and its state is dropped; rows of windows that ended
    before the watermark are left out. In complete and update mode windows are given
    as they stand.
    """
    categories = profile_categories(opts)
    counts = profile_counts(df.withWatermark(ts, delay), col, [ts, *by], **opts)
    wide = counts.groupBy(F.window(ts, window).alias("_w"), *by).agg(
        *[F.sum(f"n_{i}").alias(f"h_{i}") for i in range(len(categories))],
        *[F.count_if(F.col(f"n_{i}") > 0).alias(f"d_{i}") for i in range(len(categories))],
    )
    rows = unpivot_profile(wide, ["_w", *by], categories)
    return rows.select(
        F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"),
        *by, "category", "n_hits", "n_docs",
    )


def append_profile(
    df: DataFrame, target: str, checkpoint: str, col: str, ts: str, window: str, delay: str,
    by: Sequence[str] = (), **opts,
) -> StreamingQuery:
    """Start a profile that appends every closed window to a Parquet table, once each.

    It takes what input there is and ends; started again on the same checkpoint it goes
    on with the open windows and the watermark of before.
    """
    profile = profile_hidden_stream(df, col, ts, window, delay, by, **opts)
    return (
        profile.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)
    )
