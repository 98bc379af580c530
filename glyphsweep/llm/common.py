"""Small helpers of the operators: reading, staging, text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphsweep.sources.scratch import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts its lineage.

    With ``by``, a column of few values, in a folder for each of its values.
    """
    path = new_path(df.sparkSession, name)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


#: A table up to this many bytes of values may be broadcast.
BROADCAST_BYTES = 16 * 1024 * 1024


def broadcast_measured(stored: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``stored``, a written table, with a broadcast hint if its values measure up to ``limit``.

    Beyond that Spark shuffles both sides and splits skewed partitions.
    """
    sizes = [F.lit(16)]
    for name, kind in stored.dtypes:
        sizes.append(F.coalesce(F.octet_length(name), F.lit(0)) if kind in ("string", "binary") else F.lit(16))
    measured = stored.agg(F.sum(sum(sizes[1:], sizes[0]).cast("long")).alias("n")).first()["n"] or 0
    return F.broadcast(stored) if measured <= limit else stored
