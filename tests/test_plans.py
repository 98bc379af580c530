"""The physical plans are the ones meant for large tables."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from glyphsweep.functions.hidden import strip_hidden
from glyphsweep.operators import commits as commit_ops
from glyphsweep.operators import files as file_ops
from glyphsweep.operators import text as text_ops
from glyphsweep.plans import run

SF = "/root/testdata/sf0.001"


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture
def tree(docs):
    return docs.select(
        F.lit("r").alias("repo"), F.concat(F.col("doc_id").cast("string"), F.lit(".go")).alias("path"),
        F.lit(0).alias("mode"), F.col("text").cast("binary").alias("content"),
    )


@pytest.fixture
def commits(docs):
    return docs.select("source", F.lit("r").alias("repo"), F.lit("s").alias("sha"), F.col("text").alias("message"))


def test_row_operators_do_not_shuffle(docs, tree, commits):
    for df in (
        text_ops.clean_text(docs, "text"), text_ops.find_hidden(docs, "doc_id", "text"),
        text_ops.with_findings(docs, "text"), commit_ops.clean_commits(commits),
        commit_ops.trace_hits(commits), file_ops.removals(tree), file_ops.clean_files(tree),
        file_ops.clean_comment_files(tree), run.plan(tree), run.plan(tree, commits),
        run.touched_files(tree, ["comments", "watermarks"]), run.stage_files(tree, ["comments"]),
    ):
        assert "Exchange" not in physical(df)


def test_no_python_and_no_cross_join(docs, tree, commits):
    for df in (
        text_ops.profile_hidden(docs, "text", "source", rollup=True), run.plan(tree, commits),
        text_ops.categorize(text_ops.find_hidden(docs, "doc_id", "text")), commit_ops.trace_hits(commits),
        file_ops.with_syntax(tree), file_ops.match_rules(tree),
    ):
        plan = physical(df)
        assert not re.search("Python|Arrow|CartesianProduct|NestedLoop", plan)


def test_aggregations_combine_before_the_shuffle(docs):
    for df in (text_ops.profile_hidden(docs, "text", "source"), text_ops.hidden_rate(docs, "text", "source")):
        plan = physical(df)
        assert plan.count("Exchange") == 1 and "partial_" in plan


def test_scan_reads_needed_columns(docs):
    plan = physical(docs.select("doc_id", strip_hidden("text").alias("s")))
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)
    plan = physical(text_ops.find_hidden(docs.where("lang = 'en'"), "doc_id", "text"))
    assert "EqualTo(lang,en)" in plan


def test_findings_are_computed_once(docs):
    plan = physical(text_ops.find_hidden(docs, "doc_id", "text"))
    assert plan.count("split(") == 2  # for UTF-8 and for other bytes; a row takes one of them


def test_positions_window_shuffles_once(docs):
    plan = physical(text_ops.running_positions(docs, "doc_id", "text"))
    assert plan.count("Exchange") == 1 and "text" not in plan.split("Exchange")[0].split("Window")[-1]


def test_restore_leaves_the_join_to_adaptive_execution(spark, tree):
    originals = tree.where("path = '1.go'")
    restored = run.restore(tree, originals)
    plan = physical(restored)
    assert "AdaptiveSparkPlan" in plan and "ResolvedHint" not in plan
    assert restored.count() == tree.count()


def test_measures_stand_above_the_explode(docs):
    plan = physical(text_ops.running_positions(docs, "doc_id", "text"))
    assert "named_struct" not in plan


def test_restoring_a_bucketed_table_moves_no_file(spark, tree, tmp_path):
    from glyphsweep.sources.sinks import write_bucketed

    current = write_bucketed(tree, "bucketed_files", f"{tmp_path}/bucketed", 4)
    tree.where("path = '1.go'").repartition(3).write.parquet(f"{tmp_path}/originals")
    originals = spark.read.parquet(f"{tmp_path}/originals")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        restored = run.restore(current, originals)
        plan = physical(restored)
        join = plan[plan.index("LeftAnti"):]
        files, _, rest = join.partition("SelectedBucketsCount")
        assert "Exchange hashpartitioning" not in files and "Exchange hashpartitioning(repo" in rest
        assert restored.count() == tree.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
        spark.sql("DROP TABLE bucketed_files")


def test_pieces_do_not_read_their_text_again(docs):
    """What is worked out of a whole text stands below the generator, once a text."""
    for kind in ("string", "binary"):
        plan = physical(text_ops.running_positions(docs.select("doc_id", F.col("text").cast(kind).alias("c")), "doc_id", "c"))
        above, below = plan.split("Generate ", 1)
        assert "isValid" not in above and "isValid" in below
