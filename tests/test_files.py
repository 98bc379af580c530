from __future__ import annotations

import pytest

from glyphsweep.functions import paths as P
from glyphsweep.operators import files as ops
from glyphsweep.plans import run
from tests import brute
from workload.expected import CLOSED_FOLDERS, DOC_FOLDERS, PROSE, SOURCE_STYLES, TOOL_FOLDERS, TOOL_NAMES, TOOL_PATH

#: Every kind of folder in every place above every kind of name, in several spellings.
FOLDERS = [*TOOL_FOLDERS, *CLOSED_FOLDERS, *DOC_FOLDERS, "lib", TOOL_PATH.partition("/")[0]]
NAMES = [*TOOL_NAMES, TOOL_PATH.rpartition("/")[2], "readme.md", "ideas.md", "ideas.md.bak", "ideasmd", "run.go", *FOLDERS[:6]]


def spellings(name):
    return sorted({name, name.lower(), name.upper(), name.title()})


def grid():
    above = [""] + [f"{a}/" for f in FOLDERS for a in spellings(f)]
    above += [f"{a}/{b}/" for a in FOLDERS for b in FOLDERS] + [f"lib/{f}/lib/" for f in FOLDERS]
    return sorted({f"{folder}{spelt}" for folder in above for name in NAMES for spelt in spellings(name)})


PATHS = grid()
RULES = {p: brute.rule_of(p) for p in PATHS}


def tree(spark, paths):
    rows = [("r", p, 0o644, bytearray(b"x")) for p in paths]
    return spark.createDataFrame(rows, "repo string, path string, mode int, content binary")


@pytest.mark.parametrize("root_only", [True, False])
def test_removals_of_the_whole_grid(spark, root_only):
    files = tree(spark, PATHS)
    removed = ops.removals(files, root_only=root_only)
    got = {r.path: (r.step, r.rule) for r in removed.collect()}
    want = {p: rule for p in PATHS if (rule := brute.rule_of(p, root_only))}
    assert got == {p: ("markdown" if rule == "markdown" else "artifacts", rule) for p, rule in want.items()}
    assert set(want.values()) == {"tool-dir", "tool-path", "tool-file", "markdown"}
    kept = sorted(r.path for r in ops.apply_removals(files, removed).collect())
    assert kept == sorted(set(PATHS) - set(want)) and len(kept) > 1000


def test_name_table(spark):
    files = tree(spark, PATHS)
    closed = {*TOOL_FOLDERS, *CLOSED_FOLDERS}
    want = [p for p in PATHS if p.rpartition("/")[2] in TOOL_NAMES and not closed & set(p.split("/")[:-1])]
    assert sorted(r.path for r in ops.match_rules(files).collect()) == want
    mine = spark.createDataFrame([("run.go",)], "base string")
    assert {r.path.rpartition("/")[2] for r in ops.match_rules(files, mine).collect()} == {"run.go"}


def test_path_parts(spark):
    stems, ends = ["", "n", "n.o", ".n"], ["", ".", ".go", ".GZ", ".tar.gz"]
    paths = [f"{folder}{stem}{end}" for folder in ("", "a/", "a.b/", "a/b/", "x/a/") for stem in stems for end in ends]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    rows = df.select("path", P.base_name("path"), P.dir_name("path"), P.extension("path"), P.relative_path("path", "a/")).collect()
    for path, base, folder, ext, below in map(tuple, rows):
        above, _, name = path.rpartition("/")
        assert (base, folder, below) == (name, above or ".", path.removeprefix("a/"))
        assert ext == ("." + name.lower().rpartition(".")[2] if "." in name else "")


def test_extensions(spark):
    styles = {e: style for style, ends in SOURCE_STYLES.items() for e in ends}
    ends = [*styles, *PROSE, "", ".json", ".goo", ".m", ".md5"]
    files = tree(spark, [f"{n}{e}" for e in ends for n in ("lib/f",)] + [f"g{e.upper()}" for e in ends])
    low = {r.path: "." + r.path.lower().rpartition(".")[2] if "." in r.path else "" for r in files.collect()}
    rows = files.select("path", P.is_source("path").alias("s"), P.is_prose("path").alias("p")).collect()
    assert {r.path for r in rows if r.s} == {p for p, e in low.items() if e in styles}
    assert {r.path for r in rows if r.p} == {p for p, e in low.items() if e in PROSE}
    joined = ops.with_syntax(files).select("path", "line_token", "block_open", "doc_open", "html").collect()
    signs = {"go": ("//", "/*", None, False), "ts": ("//", "/*", None, True), "py": ("#", None, '"""', False), "rb": ("#", None, None, False)}
    assert {r[0]: tuple(r)[1:] for r in joined} == {p: signs[styles[e]] for p, e in low.items() if e in styles}


def test_text_rows_and_typography(spark):
    rows = [("r", "a.md", None, "x\u2014\u200B".encode()), ("r", "a.go", None, "x\u2014\u200B".encode()),
            ("r", "b", None, b"\0\xe2\x80\x8b"), ("r", "c", None, b"\xff"), ("r", "vendor/d", None, b"")]
    files = spark.createDataFrame([(*r[:3], bytearray(r[3])) for r in rows],
                                  "repo string, path string, mode int, content binary")
    got = {r.path: (bytes(r.cleaned).decode(), r.changed) for r in ops.clean_files(files, True).collect()}
    assert got == {"a.md": ("x--", True), "a.go": ("x\u2014", True)}
    got = {r.path: bytes(r.cleaned).decode() for r in ops.clean_files(files).collect()}
    assert got == {"a.md": "x\u2014", "a.go": "x\u2014"}


def test_changed(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, None), (None, "a")], "x string, y string")
    assert [r[0] for r in df.select(ops.changed("x", "y")).collect()] == [False, True, False, True]


def test_joins_are_lazy(spark):
    files = tree(spark, PATHS)
    tracker, group = spark.sparkContext.statusTracker(), "lazy"
    spark.sparkContext.setJobGroup(group, group)
    kept = ops.apply_removals(files, ops.removals(files))
    run.restore(run.touched_originals(files, run.plan(files)), files)
    assert tracker.getJobIdsForGroup(group) == []
    assert kept.count() == sum(rule is None for rule in RULES.values())
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
