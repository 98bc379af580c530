"""Preview, apply and undo a cleaning run over file and commit tables.

A run never changes its inputs: ``apply`` writes the originals of every file it
touches, then the cleaned tables to new places, then the line in the store's log that
makes the run count. A run that dies in between leaves no line, so ``restore`` ignores
it and it can simply be repeated under the same id.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from glyphsweep.functions.bind import any_of, where_computed
from glyphsweep.functions.comments import clean_comments, has_ai_token
from glyphsweep.functions.hidden import is_binary
from glyphsweep.functions.messages import clean_message, has_traces
from glyphsweep.functions.paths import (
    extension,
    in_skipped_dir,
    is_source,
    removed_as_artifact,
    removed_as_markdown,
)
from glyphsweep.operators.files import (
    KEYS,
    hidden_in_file,
    source_bytes,
    source_text,
    strip_in_file,
)
from glyphsweep.plans.steps import select_steps
from glyphsweep.plans.store import (
    Attempt,
    exists,
    latest_run,
    new_attempt,
    new_run_id,
    read_run,
    read_runs,
    record,
    refuse_recorded,
    save_originals,
)
from glyphsweep.rules import STEP_ORDER, STORE_DIR, LineRule
from glyphsweep.sources.scratch import new_path
from glyphsweep.sources.sinks import write_events

DEFAULT_MODE = 0o644


@dataclass(frozen=True)
class Rules:
    """The adjustable parts of a run."""

    normalize_typography: bool = False
    root_only: bool = True
    store_dir: str = STORE_DIR
    extra_commit_rules: tuple[LineRule, ...] = ()
    exclude_commit_rules: tuple[str, ...] = ()
    extra_comment_tokens: tuple[LineRule, ...] = ()
    exclude_comment_tokens: tuple[str, ...] = ()


def stage_files(
    files: DataFrame, steps: Iterable[str], rules: Rules = Rules()
) -> DataFrame:
    """Every file with what the steps do to it, from one pass over the table.

    Adds ``steps`` (the steps that touch the file, in order), ``removed`` and
    ``cleaned`` (the content after the run). The steps act in canonical order: a
    removed file is not edited, and hidden characters are looked for in what the
    comments step leaves.
    """
    chosen = set(steps)
    path, never = F.col("path"), F.lit(False)
    artifact = removed_as_artifact(path, rules.root_only, rules.store_dir)
    markdown = removed_as_markdown(path, rules.store_dir)
    ruled = files.select(
        *KEYS, "mode", "content",
        (artifact if "artifacts" in chosen else never).alias("_artifact"),
        (markdown if "markdown" in chosen else never).alias("_markdown"),
        (~in_skipped_dir(path, rules.store_dir)).alias("_visited"),
    )
    kept = ruled.select(
        "*", (F.col("_visited") & ~F.col("_artifact") & ~F.col("_markdown")).alias("_editable")
    )

    if "comments" in chosen:
        text = F.when(F.col("_editable") & is_source(path), source_text("content"))
        before = kept.select("*", text.alias("_text"))
        edited = before.select(
            "*",
            clean_comments(
                "_text", extension(path),
                rules.extra_comment_tokens, rules.exclude_comment_tokens,
            ).alias("_edited"),
        )
        commented = edited.select(
            "*", F.coalesce(F.col("_edited") != F.col("_text"), never).alias("_commented")
        ).select(
            *KEYS, "mode", "content", "_artifact", "_markdown", "_editable", "_commented",
            F.when(F.col("_commented"), source_bytes("_edited", "content"))
            .otherwise(F.col("content")).alias("_body"),
        )
    else:
        commented = kept.select(
            "*", never.alias("_commented"), F.col("content").alias("_body")
        )

    body_text = F.col("_body").cast("string")
    if "watermarks" in chosen:
        hidden = (
            F.col("_editable")
            & hidden_in_file(path, body_text, rules.normalize_typography)
            & ~is_binary("_body")
        )
        stripped = strip_in_file(path, body_text, rules.normalize_typography).cast("binary")
    else:
        hidden, stripped = never, F.col("_body")
    flagged = commented.select("*", F.coalesce(hidden, never).alias("_hidden"))

    touched = F.array_compact(F.array(
        F.when(F.col("_artifact"), F.lit("artifacts")),
        F.when(F.col("_markdown") & ~F.col("_artifact"), F.lit("markdown")),
        F.when(F.col("_commented"), F.lit("comments")),
        F.when(F.col("_hidden"), F.lit("watermarks")),
    ))
    return flagged.select(
        *KEYS, "mode", "content",
        touched.alias("steps"),
        (F.col("_artifact") | F.col("_markdown")).alias("removed"),
        F.when(F.col("_hidden"), stripped).otherwise(F.col("_body")).alias("cleaned"),
    )


def touched_files(
    files: DataFrame, steps: Iterable[str], rules: Rules = Rules()
) -> DataFrame:
    """The original rows of the files the steps touch, with the array of those steps."""
    staged = stage_files(candidates(files, steps, rules), steps, rules)
    flagged = staged.select(
        *KEYS, "mode", "content", "steps", (F.size("steps") > 0).alias("_touched")
    )
    return where_computed(flagged, "_touched")


def candidates(
    files: DataFrame, steps: Iterable[str], rules: Rules = Rules()
) -> DataFrame:
    """The files some step may touch, by tests that are cheap to push down to the scan.

    No step adds characters, so a file without hidden characters or tokens in it now
    has none after an earlier step either.
    """
    chosen, path, text = set(steps), F.col("path"), F.col("content").cast("string")
    visited = ~in_skipped_dir(path, rules.store_dir)
    tests = []
    if "artifacts" in chosen:
        tests.append(removed_as_artifact(path, rules.root_only, rules.store_dir))
    if "markdown" in chosen:
        tests.append(removed_as_markdown(path, rules.store_dir))
    if "comments" in chosen:
        token = has_ai_token(
            source_text("content"), rules.extra_comment_tokens, rules.exclude_comment_tokens
        )
        tests.append(visited & is_source(path) & token)
    if "watermarks" in chosen:
        tests.append(visited & hidden_in_file(path, text, rules.normalize_typography))
    return files.where(any_of(tests))


def _as_actions(touched: DataFrame) -> DataFrame:
    """(step_ord, step, repo, path, action) rows from rows with a ``steps`` array."""
    order = F.create_map(*[F.lit(x) for pair in STEP_ORDER.items() for x in pair])
    removing = F.col("step").isin("artifacts", "markdown")
    listed = touched.select(*KEYS, F.explode_outer("steps").alias("step"))
    return listed.where(F.col("step").isNotNull()).select(
        order[F.col("step")].alias("step_ord"),
        "step",
        *KEYS,
        F.when(removing, F.lit("remove")).otherwise(F.lit("rewrite")).alias("action"),
    )


def history_actions(commits: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One action per commit whose message carries traces; ``path`` is its id."""
    traced = commits.where(
        has_traces("message", rules.extra_commit_rules, rules.exclude_commit_rules)
    )
    return traced.select(
        F.lit(STEP_ORDER["history"]).alias("step_ord"),
        F.lit("history").alias("step"),
        "repo",
        F.col("sha").alias("path"),
        F.lit("rewrite").alias("action"),
    )


def plan(
    files: DataFrame | None = None,
    commits: DataFrame | None = None,
    only: Iterable[str] | str = (),
    skip: Iterable[str] | str = (),
    rules: Rules = Rules(),
    ordered: bool = False,
) -> DataFrame:
    """What a run would do, one row per (step, file or commit). Nothing is written."""
    steps = select_steps(only, skip)
    parts = []
    if commits is not None and "history" in steps:
        parts.append(history_actions(commits, rules))
    if files is not None and set(steps) - {"history"}:
        parts.append(_as_actions(stage_files(candidates(files, steps, rules), steps, rules)))
    if not parts:
        raise ValueError("no table given for the selected steps")
    actions = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return actions.orderBy("step_ord", "repo", "path") if ordered else actions


def step_summary(actions: DataFrame, distinct: bool = False) -> DataFrame:
    """Files or commits touched per step.

    Actions from ``plan`` and ``apply`` name a file once per step; ``distinct`` is for
    others.
    """
    touched = F.count_distinct(*KEYS) if distinct else F.count(F.lit(1))
    return actions.groupBy("step").agg(touched.alias("n_files"))


#: Steps whose single actions are details; the others' are news.
_DETAILS = ("history", "comments")


def action_events(actions: DataFrame, run_id: str) -> DataFrame:
    """One event per action: time (RFC 3339), level, message, run, step, repo, path."""
    return actions.select(
        _now().alias("time"),
        F.when(F.col("step").isin(*_DETAILS), F.lit("DEBUG")).otherwise(F.lit("INFO")).alias("level"),
        F.concat("step", F.lit(": "), "action").alias("msg"),
        F.lit(run_id).alias("run_id"), "step", "action", "repo", "path",
    )


def step_events(spark: SparkSession, run_id: str, counts: dict[str, int]) -> DataFrame:
    """One closing event per step, with the number of files or commits it touched."""
    rows = [(f"{step}: done", run_id, step, n) for step, n in counts.items()]
    given = spark.createDataFrame(rows, "msg string, run_id string, step string, n_files bigint")
    return given.select(_now().alias("time"), F.lit("INFO").alias("level"), "msg", "run_id", "step", "n_files")


def _now() -> Column:
    utc = F.to_utc_timestamp(F.current_timestamp(), F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def first_saved(saves: DataFrame) -> DataFrame:
    """One original per (run_id, repo, path): that of the earliest step (``step_ord``)."""
    order = Window.partitionBy("run_id", *KEYS).orderBy("step_ord")
    ranked = saves.withColumn("_n", F.row_number().over(order))
    return ranked.where(F.col("_n") == 1).drop("_n")


def touched_originals(files: DataFrame, actions: DataFrame) -> DataFrame:
    """The original rows of the files that ``actions`` name."""
    return files.join(actions.select(*KEYS).dropDuplicates(), list(KEYS), "left_semi")


def manifest_entries(originals: DataFrame) -> DataFrame:
    """The manifest of a run as JSON lines, one (path, mode) entry per saved file."""
    entry = F.struct("repo", "path", F.col("mode").cast("int").alias("mode"))
    return originals.select(F.to_json(entry).alias("entry"))


def read_manifest(entries: DataFrame) -> DataFrame:
    """``manifest_entries`` parsed again."""
    parsed = F.from_json("entry", "repo string, path string, mode int")
    return entries.select(parsed.alias("e")).select("e.*")


def apply(
    files: DataFrame | None,
    out: str,
    store: str | None,
    commits: DataFrame | None = None,
    only: Iterable[str] | str = (),
    skip: Iterable[str] | str = (),
    rules: Rules = Rules(),
    run_id: str | None = None,
    events: str | None = None,
) -> Attempt:
    """Carry a plan out: save originals, write the cleaned tables below ``out``, record the run.

    The tables go to a place of this attempt's own below ``out/run_id=<id>``; without a
    ``store``, which saves no originals and keeps no log, to that folder itself, which must
    not exist. Every file is judged once: the verdicts are written to the shared folder,
    and originals, cleaned table and events are taken from there. What is done is counted
    while it is written (``counts``, by step). ``events`` is a new place for one JSON line
    per action and one per step. Files without a path are kept as they are.

    A run that is recorded already is refused, also if someone else records it meanwhile,
    and so is one whose files another run saved and recorded since it began.
    """
    steps = select_steps(only, skip)
    given = [t for t in (files, commits) if t is not None]
    if not given:
        raise ValueError("no table given")
    spark = given[0].sparkSession
    attempt, seen = new_attempt(run_id or new_run_id()), None
    target = f"{out.rstrip('/')}/run_id={attempt.run_id}"
    if store is not None:
        seen = refuse_recorded(spark, store, attempt.run_id)
        target = f"{target}/attempt={attempt.attempt}"
    if exists(spark, target):
        raise ValueError(f"PATH_ALREADY_EXISTS: {target}, perhaps an input of the run")

    done, counts = [], {}
    if files is not None and set(steps) - {"history"}:
        attempt = replace(attempt, files_path=f"{target}/files")
        judged, counted = _judged(files, steps, rules)
        touched = judged.where("touched = 1")
        n_touched = counted.pop("touched")
        counts |= counted
        if store is not None and n_touched:
            attempt = save_originals(touched, store, attempt)
        kept = judged.where("NOT removed").select(*KEYS, "mode", F.col("cleaned").alias("content"))
        kept.write.mode("errorifexists").parquet(attempt.files_path)
        done.append(_as_actions(touched))
    if commits is not None and "history" in steps:
        attempt = replace(attempt, commits_path=f"{target}/commits")
        counts["history"] = _write_commits(commits, attempt.commits_path, rules)
        done.append(history_actions(commits, rules))
    attempt = replace(attempt, counts=counts)
    if events is not None:
        actions = done[0] if len(done) == 1 else done[0].unionByName(done[1])
        write_events(action_events(actions, attempt.run_id), events, step_events(spark, attempt.run_id, counts))
    if store is not None:
        record(spark, store, attempt, seen)
    return attempt


def _judged(files: DataFrame, steps: Iterable[str], rules: Rules) -> tuple[DataFrame, dict[str, int]]:
    """Every file's verdict, written once and counted while written: by step, and touched."""
    spark, place, counted = files.sparkSession, new_path(files.sparkSession, "verdicts"), Observation()
    touched = F.size("steps") > 0
    verdicts = stage_files(files, steps, rules).select(
        *KEYS, "mode", F.when(touched, F.col("content")).alias("content"), "steps",
        F.coalesce("removed", F.lit(False)).alias("removed"), "cleaned", touched.cast("int").alias("touched"),
    )
    chosen = [s for s in steps if s != "history"]
    by_step = [F.count_if(F.array_contains("steps", s)).alias(s) for s in chosen]
    observed = verdicts.observe(counted, F.count_if(F.col("touched") == 1).alias("touched"), *by_step)
    observed.write.partitionBy("touched").parquet(place)
    return spark.read.schema(verdicts.schema).parquet(place), dict(counted.get)


def _write_commits(commits: DataFrame, place: str, rules: Rules) -> int:
    """Write the commits with clean messages; how many had traces is counted on the way."""
    counted = Observation()
    extra, exclude = rules.extra_commit_rules, rules.exclude_commit_rules
    flagged = commits.withColumn("_traced", has_traces("message", extra, exclude))
    observed = flagged.observe(counted, F.count_if(F.col("_traced")).alias("n"))
    message = F.when(F.col("_traced"), clean_message("message", extra, exclude)).otherwise(F.col("message"))
    observed.withColumn("message", message).drop("_traced").write.mode("errorifexists").parquet(place)
    return counted.get["n"]


def restore_actions(current: DataFrame, originals: DataFrame) -> DataFrame:
    """What ``restore`` would do: (repo, path, action), ``recreate`` or ``revert``.

    Files that equal their originals already are not listed.
    """
    now = current.select(*KEYS, F.col("content").alias("_now"), F.lit(True).alias("_there"))
    joined = originals.select(*KEYS, "content").join(now, list(KEYS), "left")
    action = F.when(F.col("_there").isNull(), "recreate").when(~F.col("content").eqNullSafe(F.col("_now")), "revert")
    return joined.select(*KEYS, action.alias("action")).where("action IS NOT NULL")


def run_actions(originals: DataFrame) -> DataFrame:
    """The actions a recorded run took, from its originals alone."""
    return _as_actions(originals.select(*KEYS, "steps"))


def restore(current: DataFrame, originals: DataFrame) -> DataFrame:
    """The file table with the originals back in place.

    Removed files return, edited ones revert, files made since stay. A saved mode of 0
    or null becomes the usual one.
    """
    saved_mode = F.coalesce(F.nullif("mode", F.lit(0)), F.lit(DEFAULT_MODE))
    saved = originals.select(*KEYS, saved_mode.alias("mode"), "content")
    untouched = current.join(originals.select(*KEYS), list(KEYS), "left_anti")
    return untouched.select(*KEYS, "mode", "content").unionByName(saved)


def restore_latest(spark: SparkSession, current: DataFrame, store: str) -> DataFrame:
    """``restore`` from the newest recorded run; an error if there is none."""
    newest = latest_run(read_runs(spark, store)).first()
    if newest is None:
        raise ValueError(f"no recorded run under {store}")
    return restore(current, read_run(spark, store, newest["run_id"]))


def write_restored(current: DataFrame, originals: DataFrame, place: str) -> int:
    """Write what ``restore`` gives to a new place and return how many files it put back,
    counted while they are written."""
    counted = Observation()
    saved_mode = F.coalesce(F.nullif("mode", F.lit(0)), F.lit(DEFAULT_MODE))
    saved = originals.select(*KEYS, saved_mode.alias("mode"), "content", F.lit(True).alias("_back"))
    untouched = current.join(originals.select(*KEYS), list(KEYS), "left_anti").select(
        *KEYS, "mode", "content", F.lit(False).alias("_back"))
    rows = untouched.unionByName(saved).observe(counted, F.count_if(F.col("_back")).alias("n"))
    rows.drop("_back").write.mode("errorifexists").parquet(place)
    return counted.get["n"]


def restore_summary(originals: DataFrame) -> DataFrame:
    """How many files a restore puts back."""
    return originals.agg(F.count(F.lit(1)).alias("n_files"))
