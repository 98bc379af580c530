"""The tree format: what it returns, what it does not list, how its work is cut."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import datasource as ds

from glyphsweep.rules import UNVISITED_DIRS
from glyphsweep.sources import tree as T

OLD = datetime.datetime(2020, 5, 17, 8, 30, 15, 250000, datetime.timezone.utc)


@pytest.fixture
def root(tmp_path):
    base = tmp_path / "tree"
    for folder in ("", ".dot", "_under", "src/a", "src/b/.c/d", "node_modules/m", "deep/" + "/".join("uvwxyz")):
        (base / folder).mkdir(parents=True, exist_ok=True)
        for i in range(7):
            (base / folder / f"f{i}{'.py' if i % 2 else '.md'}").write_bytes(bytes([i]) * i * 10)
    (base / "loop").symlink_to(base)
    (base / "file_link").symlink_to(base / "f1.py")
    os.mkfifo(base / "pipe")
    os.utime(base / "src" / "a" / "f1.py", (OLD.timestamp(), OLD.timestamp()))
    os.chmod(base / "f1.py", 0o750)
    return str(base)


def walked(root, skip=UNVISITED_DIRS):
    found = {}
    for place, folders, names in os.walk(root):
        folders[:] = [f for f in folders if f not in skip and not os.path.islink(f"{place}/{f}")]
        for name in names:
            full = f"{place}/{name}"
            if os.path.isfile(full) and not os.path.islink(full):
                found[os.path.relpath(full, root)] = open(full, "rb").read()
    return found


@pytest.mark.parametrize("options", [{}, {"units": 2}, {"maxListed": 1}, {"maxListed": 9, "units": 5}, {"maxListed": 30, "units": 3},
                                     {"maxPartitionBytes": 1}], ids=str)
def test_every_file_once(spark, root, options):
    rows = T.read_tree_table(spark, root, repo="r", **options).collect()
    assert len(rows) == len({r.path for r in rows})
    assert {r.path: bytes(r.content) for r in rows} == walked(root)
    assert all(r.repo == "r" and r.length == len(r.content) for r in rows)
    by_path = {r.path: r for r in rows}
    assert by_path["f1.py"].mode == 0o750
    assert by_path["src/a/f1.py"].modificationTime.astimezone(datetime.timezone.utc) == OLD


def test_other_closed_directories(spark, root):
    got = {r.path for r in T.read_tree_table(spark, f"file://{root}", skipDirs="src,deep").collect()}
    assert got == set(walked(root, skip=("src", "deep"))) and "node_modules/m/f0.md" in got


CONDITIONS = [
    ("path = 'src/a/f3.py'", lambda p, c: p == "src/a/f3.py"),
    ("path IN ('f1.py', 'src/b/.c/d/f2.md', 'none')", lambda p, c: p in ("f1.py", "src/b/.c/d/f2.md")),
    ("path LIKE 'src/%' AND path LIKE '%.md'", lambda p, c: p.startswith("src/") and p.endswith(".md")),
    ("path LIKE 'sr%'", lambda p, c: p.startswith("sr")),
    ("path LIKE '%/.c/%' AND length >= 20", lambda p, c: "/.c/" in p and len(c) >= 20),
    ("NOT path LIKE 'src/%' AND length < 40", lambda p, c: not p.startswith("src/") and len(c) < 40),
    ("path <> 'f1.py' AND NOT length IN (10, 30)", lambda p, c: p != "f1.py" and len(c) not in (10, 30)),
    ("path > 'e' AND path <= 'src/a/f2.md'", lambda p, c: "e" < p <= "src/a/f2.md"),
    ("path <=> 'f2.md'", lambda p, c: p == "f2.md"),
    ("modificationTime < timestamp'2021-01-01 00:00:00'", lambda p, c: p == "src/a/f1.py"),
    ("modificationTime = timestamp'2020-05-17 08:30:15.25' AND mode IS NOT NULL", lambda p, c: p == "src/a/f1.py"),
    ("mode = 488", lambda p, c: p == "f1.py"),
    ("mode IS NULL", lambda p, c: False),
    ("length(content) > 40 OR path = 'f0.md'", lambda p, c: len(c) > 40 or p == "f0.md"),
    ("repo = '' AND length(content) = 10", lambda p, c: len(c) == 10),
    ("repo = 'x'", lambda p, c: False),
]


@pytest.mark.parametrize("where, keeps", CONDITIONS, ids=[c for c, _ in CONDITIONS])
def test_conditions(spark, root, where, keeps):
    got = {r.path for r in T.read_tree_table(spark, root, maxListed=12, units=4).where(where).collect()}
    assert got == {p for p, c in walked(root).items() if keeps(p, c)}


def test_pushed_conditions_are_in_the_plan(spark, root, capsys):
    files = T.read_tree_table(spark, root).where("path LIKE 'src/%' AND length > 5 AND modificationTime > timestamp'2021-01-01'")
    files.explain("formatted")
    plan = capsys.readouterr().out
    pushed = next(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "StringStartsWith(path,src/)" in pushed and "GreaterThan(length,5)" in pushed and "GreaterThan(modificationTime" in pushed
    assert ") Filter" not in plan  # nothing is left for Spark to test


def test_nothing_is_listed_before_an_action(spark, tmp_path):
    files = T.read_tree_table(spark, f"{tmp_path}/later").where("length > 0")
    (tmp_path / "later").mkdir()
    (tmp_path / "later" / "x").write_bytes(b"x")
    assert [r.path for r in files.collect()] == ["x"]


def scan(root, *filters, **options):
    made = T.Scan(root, "", frozenset(UNVISITED_DIRS), **options)
    left = list(T.TreeReader(made).pushFilters(list(filters)))
    return made, left


def listed_by(monkeypatch):
    seen, listing = [], T.entries_of
    monkeypatch.setattr(T, "entries_of", lambda root, d: seen.append(d) or listing(root, d))
    return seen


def test_directories_that_cannot_match_are_not_listed(root, monkeypatch):
    seen = listed_by(monkeypatch)
    made, left = scan(root, ds.StringStartsWith(("path",), "src/b/"), ds.GreaterThan(("length",), 10))
    assert left == [] and {e.path for u in made.plan() for e in made.files_of(u)} == {f"src/b/.c/d/f{i}.{'py' if i % 2 else 'md'}" for i in range(2, 7)}
    assert sorted(set(seen)) == ["", "src", "src/b", "src/b/.c", "src/b/.c/d"]
    seen.clear()
    made, _ = scan(root, ds.EqualTo(("path",), "deep/u/none"))
    assert [e for u in made.plan() for e in made.files_of(u)] == [] and sorted(seen) == ["", "deep", "deep/u"]


def test_conditions_that_stay_with_spark(root):
    odd = [ds.EqualTo(("content",), b"x"), ds.EqualTo(("path", "x"), 1), ds.GreaterThan(("modificationTime",), datetime.datetime(2020, 1, 1)),
           ds.Not(ds.In(("path",), ("a", None)))]
    assert scan(root, *odd)[1] == odd


def test_a_large_directory_is_shared(tmp_path):
    for i in range(400):
        (tmp_path / f"n{i}").write_bytes(b"")
    made, _ = scan(str(tmp_path), listed=100, units=8)
    units = made.plan()
    assert len(units) == 8 and {(u.directory, u.shares) for u in units} == {("", 8)}
    shares = [{e.path for e in made.files_of(u)} for u in units]
    assert sum(map(len, shares)) == len(set().union(*shares)) == 400 and max(map(len, shares)) < 100


def test_planning_is_bounded(tmp_path, monkeypatch):
    for i in range(40):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "x").write_bytes(b"x")
    seen = listed_by(monkeypatch)
    made, _ = scan(str(tmp_path), units=10)
    units = made.plan()
    assert seen == [""] and sum(u.directory is not None for u in units) == 40


def test_empty_tree(spark, tmp_path):
    assert T.read_tree_table(spark, str(tmp_path)).collect() == []
