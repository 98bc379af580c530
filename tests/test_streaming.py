"""Streams over several batches and restarts: late rows, closed windows, repeated saves."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from glyphsweep.plans import run, store
from glyphsweep.streaming import saves as S
from glyphsweep.streaming.text import append_profile

NOON = datetime(2026, 1, 5, 12, tzinfo=timezone.utc)
HOUR = timedelta(hours=1)
EVENTS = "id int, ts timestamp, text string"


def feed(spark, place, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(place)
    return spark.readStream.schema(schema).parquet(place)


def windows(spark, base):
    rows = spark.read.parquet(f"{base}/table").collect()
    return sorted((r.window_start.astimezone(timezone.utc), r.category, r.n_hits, r.n_docs) for r in rows)


def test_append_gives_closed_windows_once_and_drops_late_rows(spark, tmp_path):
    def step(rows):
        stream = feed(spark, f"{tmp_path}/in", rows, EVENTS)
        query = append_profile(stream, f"{tmp_path}/table", f"{tmp_path}/checkpoint", "text", "ts", "1 hour", "30 minutes")
        query.awaitTermination()
        return query, windows(spark, tmp_path)

    mark = "a​​‮"
    _, found = step([(1, NOON, mark), (2, NOON + HOUR / 4, "​"), (3, NOON + HOUR, mark), (4, NOON, "clean")])
    assert found == []  # the newest event is at one, half an hour back the window from noon is open
    # still open: a row of noon counts; then the newest is at two, and the window from noon closes
    query, found = step([(5, NOON + HOUR / 2, " "), (6, NOON + 2 * HOUR, "​")])
    noon = [(NOON, "bidi-control", 1, 1), (NOON, "separator", 1, 1), (NOON, "zero-width", 3, 2)]
    assert found == noon
    states = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert states[-1] == 2  # noon's counters are gone, one and two o'clock are open
    # too late for noon, in time for one o'clock
    query, found = step([(7, NOON + HOUR / 3, mark), (8, NOON + HOUR * 1.9, "​"), (9, NOON + 5 * HOUR, "​")])
    dropped = sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])
    one, two = NOON + HOUR, NOON + 2 * HOUR
    assert dropped == 1 and found == [
        *noon, (one, "bidi-control", 1, 1), (one, "zero-width", 3, 2), (two, "zero-width", 1, 1)]
    assert step([(10, NOON + 5 * HOUR, "clean")])[1] == found  # nothing is given twice


SAVES = "run_id string, repo string, path string, mode int, content binary, steps array<string>, step_ord int, ts timestamp"


def save(path, order, text=None, run_id="20260105-120000.000000000", at=None):
    body = bytearray((text or f"{path} at {order}").encode())
    return (run_id, "r", path, 0o644, body, [f"s{order}"], order, at or NOON + order * timedelta(minutes=1))


def kept(spark, place, attempt):
    return sorted((r.path, bytes(r.content).decode()) for r in store.read_attempt(spark, place, attempt.run_id, attempt.attempt).collect())


def test_replayed_saves_equal_the_batch(spark, tmp_path):
    place, attempt = f"{tmp_path}/store", store.new_attempt("20260105-120000.000000000")
    batches = [
        [save("b", 3), save("a", 2), save("b", 2), save("c", 3)],
        [save("a", 4), save("d", 5), save("d", 4), save("a", 2, "sent again"), save("x", 2, run_id="another")],
        [save("c", 5), save("e", 5), save("b", 2), save("d", 5)],
    ]
    counts = []
    for rows in batches:  # each a run of its own, going on where the last one ended
        stream = feed(spark, f"{tmp_path}/in", rows, SAVES)
        attempt = S.save_stream(stream, place, attempt, f"{tmp_path}/checkpoint")
        counts.append(attempt.n_entries)
    assert counts == [3, 4, 5]
    everything = spark.createDataFrame([r for b in batches for r in b], SAVES).where(F.col("run_id") == attempt.run_id)
    batch = run.first_saved(everything.where("content <> CAST('sent again' AS BINARY)").dropDuplicates(["path", "step_ord"]))
    assert kept(spark, place, attempt) == sorted((r.path, bytes(r.content).decode()) for r in batch.collect())
    assert store.record(spark, place, attempt) == 1
    assert store.read_run(spark, place, attempt.run_id).count() == 5
    again = S.save_stream(feed(spark, f"{tmp_path}/in", batches[0], SAVES), place, attempt, f"{tmp_path}/checkpoint")
    assert again.n_entries == 5


def test_what_was_seen_is_forgotten_in_time(spark, tmp_path):
    place, attempt = f"{tmp_path}/store", store.new_attempt("20260105-120000.000000000")
    options = {"delay": "1 minute", "keep_seconds": 600}
    sent = [[save("a", 1)], [save("b", 2, at=NOON + 9 * HOUR)], [save("c", 3, at=NOON + 9 * HOUR)], [save("b", 4, at=NOON + 9 * HOUR)]]
    for rows in sent:
        attempt = S.save_stream(feed(spark, f"{tmp_path}/in", rows, SAVES), place, attempt, f"{tmp_path}/checkpoint", **options)
    assert [p for p, _ in kept(spark, place, attempt)] == ["a", "b", "c"]
    # a second save of a, hours later, is a first one again
    attempt = S.save_stream(feed(spark, f"{tmp_path}/in", [save("a", 5, at=NOON + 10 * HOUR)], SAVES), place, attempt,
                            f"{tmp_path}/checkpoint", **options)
    assert [p for p, _ in kept(spark, place, attempt)] == ["a", "a", "b", "c"]


def test_a_stream_of_no_rows(spark, tmp_path):
    place, attempt = f"{tmp_path}/store", store.new_attempt("20260105-120000.000000000")
    spark.createDataFrame([], SAVES).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SAVES).parquet(f"{tmp_path}/in")
    attempt = S.save_stream(stream, place, attempt, f"{tmp_path}/checkpoint")
    assert attempt.n_entries == 0 and store.record(spark, place, attempt) is None
    with pytest.raises(ValueError):
        store.read_run(spark, place, attempt.run_id)


def test_files_share_groups_of_state(spark, tmp_path):
    """A group of its own for every file costs a task milliseconds a file; mode is null for some, a repeat stays known."""
    names = [f"f{i}" for i in range(600)]  # some of their hashes end in a zero byte
    first = [save(n, order) for n in names for order in (3, 2)]
    first = [(*r[:3], None if int(r[2][1:]) % 3 else r[3], *r[4:]) for r in first]
    batches = [first, [save(n, 4) for n in names] + [save("new", 4)], [save("late", 5, at=NOON + 40 * HOUR)], [save("f1", 6, at=NOON + 40 * HOUR)]]
    for rows in batches:
        stream = feed(spark, f"{tmp_path}/in", rows, SAVES)
        query = S.first_saved_stream(stream, buckets=8).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(
            availableNow=True).start(f"{tmp_path}/out")
        query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 8
    rows = {r.path: r for r in spark.read.schema(SAVES).parquet(f"{tmp_path}/out").collect()}
    assert sorted(rows) == sorted([*names, "new", "late"]) and spark.read.parquet(f"{tmp_path}/out").count() == 602
    assert all(rows[n].step_ord == 2 and rows[n].mode == (None if int(n[1:]) % 3 else 0o644) for n in names)
    assert bytes(rows["f7"].content) == b"f7 at 2" and rows["f7"].steps == ["s2"]
