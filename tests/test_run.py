from __future__ import annotations

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from glyphsweep.plans import run
from glyphsweep.plans.steps import parse_step_list, select_steps
from glyphsweep.rules import STEPS

GO = "package tool\n\n// Codex drew this up\nvar N = 7\n"
START = {
    "CLAUDE.md": ("instructions", 0o644), "CHANGELOG.md": ("1.2: faster", 0o600),
    "main.go": (GO, 0o755), "README.md": ("About it", 0), ".claude/x.md": ("tool state", None),
    "docs/guide.md": ("# Gu\u200Bide", 0o644),
    "both.go": ("x // by Claude \u200B\ny\u202E\n", 0o644),
    "only_comment.go": ("x // by Claude \u200B\n", 0o644),
}


def table(spark, files):
    rows = [("r", p, mode, bytearray(text.encode())) for p, (text, mode) in files.items()]
    return spark.createDataFrame(rows, "repo string, path string, mode int, content binary")


def contents(df):
    return {r.path: bytes(r.content).decode() for r in df.collect()}


@pytest.fixture
def commits(spark):
    return spark.createDataFrame(
        [("r", "s1", "ok\n\n"), ("r", "s2", "fix\n\nbuilt by AI\n- Codex\n")],
        "repo string, sha string, message string")


def test_select_steps_of_every_subset():
    for bits in range(1, 2 ** len(STEPS)):
        chosen = [s for i, s in enumerate(STEPS) if bits >> i & 1]
        shuffled = random.Random(bits).sample(chosen, len(chosen))
        assert list(select_steps(shuffled, [])) == list(select_steps(",".join(shuffled).upper() + ", ,", "")) == chosen
        rest = [s for s in STEPS if s not in chosen]
        if rest:
            assert list(select_steps([], shuffled)) == rest
    assert list(select_steps([], [])) == list(STEPS)


def test_select_steps_errors():
    for only, skip in (([[*STEPS][3]], [[*STEPS][0]]), (["unheard"], []), ([], ["unheard"]), ([], [*STEPS])):
        with pytest.raises(ValueError):
            select_steps(only, skip)


def test_parse_step_list():
    assert parse_step_list("") == parse_step_list("  ") == []
    assert parse_step_list("a,,b, A ") == ["a", "b"]


def test_plan(spark, commits):
    rows = run.plan(table(spark, START), commits, ordered=True).collect()
    assert [(r.step_ord, r.step, r.path, r.action) for r in rows] == [
        (1, "history", "s2", "rewrite"),
        (2, "artifacts", ".claude/x.md", "remove"),
        (2, "artifacts", "CLAUDE.md", "remove"),
        (3, "markdown", "CHANGELOG.md", "remove"),
        (4, "comments", "both.go", "rewrite"),
        (4, "comments", "main.go", "rewrite"),
        (4, "comments", "only_comment.go", "rewrite"),
        (5, "watermarks", "both.go", "rewrite"),
        (5, "watermarks", "docs/guide.md", "rewrite"),
    ]
    counts = {r.step: r.n_files for r in run.step_summary(run.plan(table(spark, START), commits)).collect()}
    assert counts == {"history": 1, "artifacts": 2, "markdown": 1, "comments": 3, "watermarks": 2}
    doubled = run.plan(table(spark, START)).unionByName(run.plan(table(spark, START)))
    assert {r.step: r.n_files for r in run.step_summary(doubled, distinct=True).collect()}["comments"] == 3


def test_plan_needs_a_table(spark, commits):
    with pytest.raises(ValueError):
        run.plan(commits=commits, only=["comments"])
    with pytest.raises(ValueError):
        run.apply(None, "out", None)


def test_round_trip(spark, commits, tmp_path):
    store, out = f"{tmp_path}/store", f"{tmp_path}/out"
    start = table(spark, START)
    result = run.apply(start, out, store, commits=commits)
    current = spark.read.parquet(result.files_path)
    assert contents(current) == {
        "main.go": "package tool\n\nvar N = 7\n", "README.md": "About it", "docs/guide.md": "# Guide",
        "both.go": "x\ny\n", "only_comment.go": "x\n",
    }
    messages = {r.sha: r.message for r in spark.read.parquet(result.commits_path).collect()}
    assert messages == {"s1": "ok\n\n", "s2": "fix\n"}
    saved = run.read_run(spark, store, result.run_id)
    assert result.n_entries == saved.count() == run.restore_summary(saved).first().n_files == 7
    key = lambda r: (r.step_ord, r.path)
    done = sorted(run.run_actions(saved).collect(), key=key)
    assert done == sorted(run.plan(start).collect(), key=key)
    assert run.read_manifest(run.manifest_entries(saved)).count() == 7
    back = run.restore_latest(spark, current, store)
    assert contents(back) == {p: text for p, (text, _) in START.items()}
    modes = {r.path: r.mode for r in back.collect()}
    assert modes["main.go"] == 0o755 and modes[".claude/x.md"] == 0o644 and modes["README.md"] == 0


def test_nothing_touched_leaves_no_record(spark, tmp_path):
    store = f"{tmp_path}/store"
    result = run.apply(table(spark, {"README.md": ("# P", 0o644)}), f"{tmp_path}/out", store)
    assert result.n_entries == 0
    assert run.latest_run(run.read_runs(spark, store)).count() == 0
    with pytest.raises(ValueError):
        run.restore_latest(spark, table(spark, START), store)


def test_without_originals(spark, tmp_path):
    result = run.apply(table(spark, START), f"{tmp_path}/out", None, only="artifacts")
    assert "CLAUDE.md" not in contents(spark.read.parquet(result.files_path))
    assert not (tmp_path / "store").exists()


def test_newest_recorded_run_wins(spark, tmp_path):
    store = f"{tmp_path}/store"
    for day, text in (("1", "x = 1 // by Claude\n"), ("2", "x = 2 // by Claude\n")):
        tree = table(spark, {"notes.go": (text, 0o644)})
        newest = run.apply(tree, f"{tmp_path}/out{day}", store, run_id=f"2026010{day}-000000.000000000")
    unfinished = table(spark, {"notes.go": ("never recorded", 0o644)})
    run.save_originals(unfinished, store, "20260109-000000.000000000")
    back = run.restore_latest(spark, spark.read.parquet(newest.files_path), store)
    assert contents(back) == {"notes.go": "x = 2 // by Claude\n"}
    with pytest.raises(ValueError):
        run.apply(tree, f"{tmp_path}/out3", store, run_id="20260102-000000.000000000")


def test_unrecorded_run_can_be_repeated(spark, tmp_path):
    store, run_id = f"{tmp_path}/store", "20260101-000000.000000000"
    tree = table(spark, START)
    run.save_originals(run.touched_files(tree, select_steps()), store, run_id)
    run.apply(tree, f"{tmp_path}/out", store, run_id=run_id)
    assert run.read_run(spark, store, run_id).count() == 7


def test_restore_leaves_later_files(spark):
    current = table(spark, {"new.txt": ("new", 0o600), "a": ("edited", 0o600)})
    originals = table(spark, {"a": ("was", 0), "gone": ("was too", None)})
    back = run.restore(current, originals)
    assert contents(back) == {"new.txt": "new", "a": "was", "gone": "was too"}
    assert {r.path: r.mode for r in back.collect()} == {"new.txt": 0o600, "a": 0o644, "gone": 0o644}


def test_first_saved_and_touched(spark):
    saves = run.plan(table(spark, START)).withColumn("run_id", F.lit("x"))
    assert {r.path: r.step for r in run.first_saved(saves).collect()}["both.go"] == "comments"
    touched = run.touched_originals(table(spark, START), run.plan(table(spark, START)))
    assert set(contents(touched)) == set(START) - {"README.md"}


def test_run_ids_sort_by_time():
    early = run.new_run_id(datetime(2026, 1, 2, 3, 4, 5, 6, tzinfo=timezone.utc))
    assert early == "20260102-030405.000006000" < run.new_run_id()


def test_prose_typography_only_if_asked(spark):
    tree = table(spark, {"a.txt": ("x\u2014", 0), "a.go": ("x\u2014", 0)})
    assert run.plan(tree).count() == 0
    rows = run.plan(tree, rules=run.Rules(normalize_typography=True)).collect()
    assert [r.path for r in rows] == ["a.txt"]


def test_a_run_never_writes_over_anything(spark, tmp_path):
    store, out = f"{tmp_path}/store", f"{tmp_path}/out"
    first = run.apply(table(spark, START), out, store)
    cleaned = spark.read.parquet(first.files_path)
    again = run.apply(cleaned.union(table(spark, {"late.go": ("n // by Codex\n", 0o644)})), out, store)
    assert again.files_path != first.files_path and contents(spark.read.parquet(first.files_path)) == contents(cleaned)
    assert contents(spark.read.parquet(again.files_path))["late.go"] == "n\n"
    with pytest.raises(ValueError, match="input"):
        run.apply(cleaned, out, None, run_id=first.run_id)
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        run.apply(table(spark, START), out, None, run_id=first.run_id)
    back = run.restore(run.restore(spark.read.parquet(again.files_path), run.read_run(spark, store, again.run_id)),
                       run.read_run(spark, store, first.run_id))
    assert contents(back) == {**{p: t for p, (t, _) in START.items()}, "late.go": "n // by Codex\n"}


def test_files_without_path_are_kept(spark, tmp_path):
    files = table(spark, {"AGENTS.md": ("x", None)}).union(spark.createDataFrame(
        [("r", None, None, bytearray(b"no path"))], "repo string, path string, mode int, content binary"))
    result = run.apply(files, f"{tmp_path}/out", None)
    assert [bytes(r.content) for r in spark.read.parquet(result.files_path).collect()] == [b"no path"]


def test_restore_actions(spark):
    current = table(spark, {"same": ("s", 0), "edited": ("now", 0), "new": ("n", 0)})
    originals = table(spark, {"same": ("s", 0), "edited": ("then", 0), "gone": ("g", 0)})
    got = {r.path: r.action for r in run.restore_actions(current, originals).collect()}
    assert got == {"edited": "revert", "gone": "recreate"}
