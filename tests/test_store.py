"""The store's log: what is recorded stays, and concurrent writers agree on one order."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pytest

from glyphsweep.plans import run, store

FIRST, SECOND = "20260101-000000.000000000", "20260102-000000.000000000"


def files(spark, *paths):
    rows = [("r", p, 0, bytearray(f"x // by Claude {p}\n".encode())) for p in paths]
    return spark.createDataFrame(rows, "repo string, path string, mode int, content binary")


def log(spark, place):
    return sorted((r.version, r.run_id, r.n_entries) for r in store.read_runs(spark, place).collect())


def paths(df):
    return sorted(r.path for r in df.collect())


@pytest.mark.parametrize("how", ["linked", "renamed"])
def test_one_of_many_writers_wins(spark, tmp_path, how):
    def put(n):
        if how == "linked":
            return store.put_if_absent(spark, f"{tmp_path}/log/1.json", f"{n}\n")
        path, system = store._hadoop(spark, f"file://{tmp_path}/log/{n // 2}.json")  # in turn: local renames are not atomic
        return store._renamed(spark, path, system, f"{n}\n")

    if how == "linked":
        with ThreadPoolExecutor(8) as pool:
            won = list(pool.map(put, range(8)))
        assert won.count(True) == 1
        assert (tmp_path / "log" / "1.json").read_text() == f"{won.index(True)}\n"
    else:
        assert [put(n) for n in range(6)] == [True, False] * 3
        assert [(tmp_path / "log" / f"{k}.json").read_text() for k in range(3)] == ["0\n", "2\n", "4\n"]
    assert not [f for f in (tmp_path / "log").iterdir() if f.name.startswith(".") and not f.name.endswith(".crc")]


def test_a_recorded_run_cannot_be_replaced(spark, tmp_path):
    place = f"{tmp_path}/store"
    saved = store.save_originals(files(spark, "a.go", "b.go"), place, FIRST)
    again = store.save_originals(files(spark, "c.go"), place, FIRST)  # both unrecorded yet
    assert store.record(spark, place, saved) == 1
    with pytest.raises(store.RunConflict):
        store.save_originals(files(spark, "d.go").limit(0), place, FIRST)
    with pytest.raises(store.RunConflict):
        store.record(spark, place, again)
    with pytest.raises(store.RunConflict):
        run.apply(files(spark, "e.go"), f"{tmp_path}/out", place, run_id=FIRST)
    assert log(spark, place) == [(1, FIRST, 2)]
    assert paths(store.read_run(spark, place, FIRST)) == ["a.go", "b.go"]
    assert paths(store.read_attempt(spark, place, FIRST, again.attempt)) == ["c.go"]


def test_concurrent_runs_on_the_same_files_are_detected(spark, tmp_path):
    place = f"{tmp_path}/store"
    seen = store.log_version(spark, place)
    mine = store.save_originals(files(spark, "a.go", "b.go"), place, FIRST)
    theirs = store.save_originals(files(spark, "b.go", "c.go"), place, SECOND)
    apart = store.save_originals(files(spark, "d.go"), place, "20260103-000000.000000000")
    assert store.record(spark, place, mine, seen) == 1
    with pytest.raises(store.RunConflict, match=FIRST):
        store.record(spark, place, theirs, seen)
    assert store.record(spark, place, apart, seen) == 2
    assert store.record(spark, place, theirs, store.log_version(spark, place)) == 3  # begun again on the new state
    assert [r[0] for r in log(spark, place)] == [1, 2, 3]


def test_writers_at_the_same_time(spark, tmp_path):
    place = f"{tmp_path}/store"
    ids = [f"2026010{d}-000000.000000000" for d in range(1, 6)]
    attempts = [store.save_originals(files(spark, f"{i}.go"), place, i) for i in ids]
    rivals = [store.save_originals(files(spark, "rival.go"), place, ids[0]) for _ in range(2)]

    def put(attempt):
        try:
            return store.record(spark, place, attempt, 0)
        except store.RunConflict:
            return None

    with ThreadPoolExecutor(7) as pool:
        got = list(pool.map(put, [*attempts, *rivals]))
    assert sorted(v for v in got if v) == [1, 2, 3, 4, 5]
    assert sorted(r[1] for r in log(spark, place)) == ids


def test_two_writers_of_one_run_id(spark, tmp_path):
    place, tree = f"{tmp_path}/store", files(spark, "a.go", "b.go")

    def go(n):
        try:
            return run.apply(tree, f"{tmp_path}/out", place, run_id=FIRST)
        except store.RunConflict:
            return None

    with ThreadPoolExecutor(2) as pool:
        results = list(pool.map(go, range(2)))
    done = [r for r in results if r]
    assert len(done) == 1 and log(spark, place) == [(1, FIRST, 2)]
    assert paths(spark.read.parquet(done[0].files_path)) == ["a.go", "b.go"]
    line = store.read_runs(spark, place).first()
    assert (line.attempt, line.files_path, line.counts) == (done[0].attempt, done[0].files_path, done[0].counts)


def test_an_unfinished_attempt_changes_nothing(spark, tmp_path):
    place = f"{tmp_path}/store"
    store.save_originals(files(spark, "half.go"), place, FIRST)
    assert log(spark, place) == [] and store.log_version(spark, place) == 0
    (Path(place) / "log").mkdir()
    (Path(place) / "log" / ".00000000000000000001.json.x").write_text("{")  # a writer that died
    result = run.apply(files(spark, "a.go"), f"{tmp_path}/out", place, run_id=FIRST)
    assert paths(run.read_run(spark, place, FIRST)) == ["a.go"] and result.counts["comments"] == 1
    with pytest.raises(ValueError):
        run.read_run(spark, place, SECOND)


def test_counts_need_no_second_pass(spark, tmp_path):
    tree = files(spark, *(f"{i}.go" for i in range(20)), "CLAUDE.md")
    commits = spark.createDataFrame([("r", str(i), "x\n- Codex\n" if i % 3 else "x") for i in range(9)], "repo string, sha string, message string")
    result = run.apply(tree, f"{tmp_path}/out", f"{tmp_path}/store", commits=commits, events=f"{tmp_path}/events")
    assert result.counts == {"artifacts": 1, "markdown": 0, "comments": 20, "watermarks": 0, "history": 6}
    assert result.n_entries == 21
    events = spark.read.json(f"{tmp_path}/events")
    assert events.where("path IS NOT NULL").count() == 27
    assert {r.step: r.n_files for r in events.where("path IS NULL").collect()} == result.counts
    current = spark.read.parquet(result.files_path)
    assert run.write_restored(current, run.read_run(spark, f"{tmp_path}/store", result.run_id), f"{tmp_path}/back") == 21
    assert paths(spark.read.parquet(f"{tmp_path}/back")) == paths(tree)


def test_event_levels(spark, tmp_path):
    from glyphsweep.sources.sinks import write_events

    actions = run.plan(files(spark, "a.go", "CLAUDE.md"))
    write_events(run.action_events(actions, FIRST), f"{tmp_path}/e", least="INFO")
    assert [(r.level, r.step, r.path) for r in spark.read.json(f"{tmp_path}/e").collect()] == [("INFO", "artifacts", "CLAUDE.md")]
