"""The store of runs: originals by attempt, and an append-only log that says which count.

Every attempt of a run saves to a place of its own, so nothing is ever written over. What
makes an attempt count is its line in the log. The log is numbered files, one line each;
a writer reads the log, decides on that state and puts the next number only if nobody else
has. If someone has, it reads on and decides again. So a run is recorded once whoever else
writes, and of two runs that began on the same state and touched the same files the
second to finish is refused.

``put_if_absent`` is atomic on shared and local disks (a hard link) and wherever a rename
that must not replace is (HDFS). A store whose renames copy is not fit to hold the log.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import asdict, dataclass, field, replace
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

KEYS = ("repo", "path")
LOG_SCHEMA = (
    "version bigint, run_id string, attempt string, created timestamp, n_entries bigint, "
    "files_path string, commits_path string, counts map<string,bigint>"
)
ORIGINALS_SCHEMA = "repo string, path string, mode int, content binary, steps array<string>"


class RunConflict(ValueError):
    """The run cannot be recorded: its id is taken, or another run was there before."""


@dataclass(frozen=True)
class Attempt:
    """One try at a run: what it saved and wrote, before or after it is recorded."""

    run_id: str
    attempt: str
    n_entries: int = 0
    files_path: str | None = None
    commits_path: str | None = None
    counts: dict[str, int] = field(default_factory=dict)


def new_attempt(run_id: str) -> Attempt:
    return Attempt(run_id, uuid.uuid4().hex)


def new_run_id(now: datetime | None = None) -> str:
    """An id that sorts by time: UTC date, time and fraction."""
    moment = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    return moment.strftime("%Y%m%d-%H%M%S.%f") + "000"


def created(run_id: str) -> str | None:
    """The second a run id names, as RFC 3339 text; none for ids of another form."""
    try:
        return datetime.strptime(run_id[:15], "%Y%m%d-%H%M%S").strftime("%Y-%m-%dT%H:%M:%SZ")
    except ValueError:
        return None


# --- files -----------------------------------------------------------------------------

def _hadoop(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, place: str) -> bool:
    path, files = _hadoop(spark, place)
    return files.exists(path)


def put_if_absent(spark: SparkSession, place: str, text: str) -> bool:
    """Write a small file whole, or not at all if it is there. Says whether it was written."""
    path, files = _hadoop(spark, place)
    files.mkdirs(path.getParent())
    if files.getUri().getScheme() == "file":
        return _linked(path.toUri().getPath(), text)
    return _renamed(spark, path, files, text)


def _linked(place: str, text: str) -> bool:
    folder, name = os.path.split(place)
    temporary = os.path.join(folder, f".{name}.{uuid.uuid4().hex}")
    with open(temporary, "x", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    try:
        os.link(temporary, place)
    except FileExistsError:
        return False
    finally:
        os.unlink(temporary)
    return True


def _renamed(spark: SparkSession, path, files, text: str) -> bool:
    jvm = spark._jvm
    temporary = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{path.getName()}.{uuid.uuid4().hex}")
    out = files.create(temporary, False)
    out.write(bytearray(text.encode()))
    out.close()
    keep = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    keep[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(temporary, path, keep)
    except Py4JJavaError as error:
        files.delete(temporary, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


# --- the log ---------------------------------------------------------------------------

def log_dir(store: str) -> str:
    return f"{store.rstrip('/')}/log"


def read_runs(spark: SparkSession, store: str) -> DataFrame:
    """The recorded runs, one row each; empty if there are none."""
    try:
        return spark.read.schema(LOG_SCHEMA).json(log_dir(store))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LOG_SCHEMA)


def log_version(spark: SparkSession, store: str) -> int:
    """The number of the newest line, 0 for an empty log: what a run that begins now has seen."""
    return read_runs(spark, store).agg(F.max("version")).first()[0] or 0


def latest_run(runs: DataFrame) -> DataFrame:
    """The newest recorded run, one row or none."""
    return runs.orderBy(F.desc("run_id")).limit(1)


def refuse_recorded(spark: SparkSession, store: str, run_id: str) -> int:
    """The newest number of a log that does not hold the run; an error if it does."""
    same = F.coalesce(F.max(F.col("run_id") == run_id), F.lit(False))
    last, recorded = read_runs(spark, store).agg(F.coalesce(F.max("version"), F.lit(0)), same).first()
    if recorded:
        raise RunConflict(f"run {run_id} is already recorded")
    return last


def record(spark: SparkSession, store: str, attempt: Attempt, seen: int | None = None) -> int | None:
    """Append the attempt to the log and return its number; None if it saved nothing.

    An error if its run is recorded already, or if a run recorded after ``seen`` (the
    ``log_version`` it began on; by default now) saved a file that this one saved too.
    """
    if attempt.n_entries == 0:
        return None
    checked = seen
    while True:
        last = refuse_recorded(spark, store, attempt.run_id)
        checked = last if checked is None else checked
        if last > checked:
            new = read_runs(spark, store).where(F.col("version").between(checked + 1, last))
            for other in new.select("run_id", "attempt").collect():  # runs that finished while this one worked
                if _overlap(spark, store, attempt, other["run_id"], other["attempt"]):
                    raise RunConflict(f"run {other['run_id']} changed files of run {attempt.run_id} meanwhile")
            checked = last
        line = {"version": last + 1, "created": created(attempt.run_id)} | asdict(attempt)
        if put_if_absent(spark, f"{log_dir(store)}/{last + 1:020d}.json", json.dumps(line) + "\n"):
            return last + 1


def _overlap(spark: SparkSession, store: str, attempt: Attempt, run_id: str, other: str) -> bool:
    mine = read_attempt(spark, store, attempt.run_id, attempt.attempt).select(*KEYS)
    theirs = read_attempt(spark, store, run_id, other).select(*KEYS)
    return not mine.join(theirs, list(KEYS), "left_semi").isEmpty()


# --- originals -------------------------------------------------------------------------

def originals_dir(store: str, run_id: str, attempt: str) -> str:
    return f"{store.rstrip('/')}/originals/run_id={run_id}/attempt={attempt}"


def save_originals(touched: DataFrame, store: str, attempt: Attempt | str) -> Attempt:
    """Write the originals of an attempt (or of a new one of the named run), counted as they go.

    Nothing that was saved before is touched. An error if the run is recorded already.
    """
    spark = touched.sparkSession
    attempt = new_attempt(attempt) if isinstance(attempt, str) else attempt
    refuse_recorded(spark, store, attempt.run_id)
    counted = Observation()
    columns = [*KEYS, "mode", "content", *(["steps"] if "steps" in touched.columns else [])]
    rows = touched.select(*columns).observe(counted, F.count(F.lit(1)).alias("n"))
    rows.write.mode("errorifexists").parquet(originals_dir(store, attempt.run_id, attempt.attempt))
    return replace(attempt, n_entries=counted.get["n"])


def read_attempt(spark: SparkSession, store: str, run_id: str, attempt: str) -> DataFrame:
    """The originals of one attempt, recorded or not; no other place is listed."""
    saved = spark.read.schema(ORIGINALS_SCHEMA).parquet(originals_dir(store, run_id, attempt))
    return saved.withColumn("run_id", F.lit(run_id))


def read_run(spark: SparkSession, store: str, run_id: str) -> DataFrame:
    """The originals of a recorded run; an error if there is none of that id."""
    found = read_runs(spark, store).where(F.col("run_id") == run_id).first()
    if found is None:
        raise ValueError(f"no recorded run {run_id} under {store}")
    return read_attempt(spark, store, run_id, found["attempt"])
