"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local threads. Every
query is computed in full (to Spark's ``noop`` sink, or to files where writing is the
point); the fastest of three runs counts, input tables having been planted before.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from glyphsweep.functions.hidden import contains_hidden  # noqa: E402
from glyphsweep.functions.messages import clean_message  # noqa: E402
from glyphsweep.operators import text  # noqa: E402
from glyphsweep.operators.commits import trace_hits  # noqa: E402
from glyphsweep.operators.files import clean_comment_files  # noqa: E402
from glyphsweep.plans import run  # noqa: E402
from glyphsweep.sources.scratch import new_path  # noqa: E402
from workload.plant import commits, dense_docs, files, raw_docs  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def compute(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def inputs(spark: SparkSession) -> dict[str, DataFrame]:
    """The planted tables, written once so that planting is not part of the times."""
    made = {
        "raw": raw_docs(spark, SF_DIR),
        "dense": dense_docs(spark, SF_DIR),
        "commits": commits(spark, SF_DIR),
        "files": files(spark, SF_DIR),
    }
    tables = {}
    for name, df in made.items():
        path = new_path(spark, name)
        df.write.parquet(path)
        tables[name] = spark.read.parquet(path)
    return tables


def apply_and_restore(spark: SparkSession, t: dict[str, DataFrame]) -> DataFrame:
    base = new_path(spark, "run")
    result = run.apply(t["files"], f"{base}/out", f"{base}/store", commits=t["commits"])
    return run.restore_latest(spark, spark.read.parquet(result.files_path), f"{base}/store")


HEADLINES = {
    "strip_planted": ("dense", lambda s, t: text.clean_text(t["dense"], "text").drop("text")),
    "strip_untouched": ("raw", lambda s, t: text.clean_text(t["raw"], "text").drop("text")),
    "contains_untouched": ("raw", lambda s, t: t["raw"].select(contains_hidden("text"))),
    "find_hidden": ("dense", lambda s, t: text.find_hidden(t["dense"], "doc_id", "text")),
    "profile_by_source": ("dense", lambda s, t: text.profile_hidden(t["dense"], "text", "source")),
    "clean_message": ("commits", lambda s, t: t["commits"].select(clean_message("message"))),
    "trace_hits": ("commits", lambda s, t: trace_hits(t["commits"])),
    "clean_comments": ("files", lambda s, t: clean_comment_files(t["files"]).drop("content")),
    "plan": ("files", lambda s, t: run.plan(t["files"], t["commits"])),
    "apply_and_restore": ("files", apply_and_restore),
}


def main() -> None:
    spark = session()
    tables = inputs(spark)
    text_column = {"raw": "text", "dense": "text", "commits": "message", "files": "content"}
    megabytes = {
        name: df.agg(F.sum(F.octet_length(text_column[name]))).first()[0] / 1e6
        for name, df in tables.items()
    }
    seconds, rates = {}, {}
    for name, (source, make) in HEADLINES.items():
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            compute(make(spark, tables))
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        rates[name] = round(megabytes[source] / seconds[name], 1)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "mb_per_sec": rates,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
