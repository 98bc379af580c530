from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from glyphsweep.functions.sql import register_sql_functions
from glyphsweep.operators import text as ops
from glyphsweep.sources import readers, scratch, sinks

TREE = {"a.go": b"x\n", "src/b.md": b"\xff\0", ".mcp.json": b"{}", ".claude/c.md": b"tool", "_d.txt": b""}


@pytest.fixture
def tree(tmp_path):
    for name, content in TREE.items():
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(tmp_path / "repo")


def test_read_files(spark, tree):
    rows = {r.path: bytes(r.content) for r in readers.read_files(spark, tree, repo="r").collect()}
    assert rows == TREE
    assert [r.path for r in readers.read_files(spark, f"file://{tree}/", glob="b.*").collect()] == ["src/b.md"]


def test_read_tree_prunes_skips_links_and_takes_modes(spark, tree, tmp_path):
    deep = tmp_path / "repo" / "k" / "l" / "m" / "n"
    deep.mkdir(parents=True)
    (deep / "leaf").write_bytes(b"leaf")
    (tmp_path / "repo" / "k" / "node_modules").mkdir()
    (tmp_path / "repo" / "k" / "node_modules" / "x.js").write_bytes(b"")
    (deep / "up").symlink_to(tmp_path / "repo")
    (tmp_path / "repo" / "again").symlink_to(tmp_path / "repo" / "a.go")
    want = {**TREE, "k/l/m/n/leaf": b"leaf"}
    modes = spark.createDataFrame([("r", "a.go", 0o755)], "repo string, path string, mode int")
    got = readers.read_tree(spark, {"r": f"file://{tree}", "same": tree}, modes=modes).collect()
    assert len(got) == 2 * len(want)
    assert {(r.repo, r.path): bytes(r.content) for r in got} == {
        (repo, p): content for repo in ("r", "same") for p, content in want.items()
    }
    assert {r.path: r.mode for r in got if r.repo == "r" and r.mode} == {"a.go": 0o755}
    everything = readers.list_tree(spark, {"r": tree}, skip_dirs=())
    assert "k/node_modules/x.js" in {r.path for r in everything.collect()}
    some = readers.read_tree(spark, {"r": tree}, where=F.col("path").startswith(".claude"))
    assert [r.path for r in some.collect()] == [".claude/c.md"]


def test_read_commits(spark, tmp_path):
    rows = [("r", "b", "two", 2), ("r", "a", "one", 1)]
    df = spark.createDataFrame(rows, "repo string, sha string, message string, n bigint")
    df.write.parquet(f"{tmp_path}/c")
    df.write.json(f"{tmp_path}/j")
    assert readers.read_commits(spark, f"{tmp_path}/c").columns == ["repo", "sha", "message"]
    ordered = readers.read_commits(spark, f"{tmp_path}/j", fmt="json", order_by="n")
    assert [r.sha for r in ordered.collect()] == ["a", "b"]


def test_read_text_reads_only_its_columns(spark, tmp_path):
    spark.range(5).select("id", F.lit("t").alias("t"), F.lit("x").alias("unused")).write.parquet(f"{tmp_path}/t")
    df = readers.read_text(spark, f"{tmp_path}/t", "id", "t")
    assert df.columns == ["id", "t"]
    assert "unused" not in df._jdf.queryExecution().executedPlan().toString()


def test_sinks_do_not_overwrite_unasked(spark, tmp_path):
    df = spark.createDataFrame([(1, "\u200B")], "id int, t string")
    target = f"{tmp_path}/out"
    sinks.write_cleaned(df, target)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.write_cleaned(df, target)
    sinks.write_findings(ops.find_hidden(df, "id", "t"), f"{tmp_path}/f", "json")
    text = "".join(part.read_text() for part in (tmp_path / "f").glob("part*.json"))
    assert json.loads(text) == {"id": 1, "rune": 8203, "u": "U+200B", "offset": 0, "line": 1, "col": 1,
                                "category": "zero-width"}
    with pytest.raises(ValueError):
        sinks.write_findings(df, target, "csv")
    sinks.write_summary(df.groupBy().count(), f"{tmp_path}/s")
    assert spark.read.json(f"{tmp_path}/s").first()["count"] == 1


def test_shared_dir_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert scratch.shared_dir(spark) == configured
    a, b = scratch.new_path(spark, "x"), scratch.new_path(spark, "x")
    assert a != b and a.startswith(configured + "/x-")


def test_sql_names(spark):
    names = register_sql_functions(spark, prefix="lenient_", typography=True, keep_zwj=True)
    assert names[0] == "lenient_contains_hidden"
    row = spark.sql("SELECT lenient_strip_hidden('a\\u200D\\u2014\\u200B'), lenient_count_hidden('\\u200B'),"
                    " lenient_clean_message('x\\n- Claude\\n'), lenient_contains_hidden('a')").first()
    assert tuple(row) == ("a\u200D--", 1, "x\n", False)
    rows = spark.sql("SELECT d.i, f.col, f.category FROM VALUES (1, 'a\\u2014'), (2, 'b') AS d(i, s),"
                     " LATERAL lenient_find_hidden(d.s) AS f").collect()
    assert [tuple(r) for r in rows] == [(1, 2, "typography")]
