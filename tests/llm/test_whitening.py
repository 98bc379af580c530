from __future__ import annotations

import math

import numpy as np
import pytest

from glyphsweep.llm import whitening as W

rng = np.random.default_rng(4)
CASES = {
    "noise": rng.normal(size=(300, 24)),
    "graded": rng.normal(size=(300, 20)) * np.logspace(0, -6, 20),
    "fewer rows than columns": rng.normal(size=(9, 20)),
    "one column": rng.normal(size=(40, 1)),
    "copied columns": np.repeat(rng.normal(size=(200, 6)), 2, axis=1),
    "equal values": np.vstack([np.eye(18), -np.eye(18)]),
    "all but equal values": np.vstack([np.diag(1 + 1e-11 * np.arange(18)), -np.eye(18)]),
    "one strong": np.outer(rng.normal(size=200), rng.normal(size=10)) * 1e6 + rng.normal(size=(200, 10)),
    "zero columns": np.hstack([rng.normal(size=(100, 5)), np.zeros((100, 4))]),
}


@pytest.mark.parametrize("case", CASES)
def test_solver(case):
    x = CASES[case] - CASES[case].mean(axis=0)
    squares, directions, every = W.principal(np.linalg.qr(x, mode="r"))
    values = np.linalg.svd(x, compute_uv=False) ** 2
    rank = int((np.sqrt(values) > 1e-13 * np.sqrt(values[0]) * x.shape[1]).sum())
    assert len(squares) == min(16, rank)
    assert np.allclose(np.sort(every)[::-1][:len(values)], values, rtol=0, atol=1e-13 * values[0])
    assert np.allclose(squares, values[:len(squares)], rtol=1e-8 if case == "graded" else 1e-12)
    white = x @ directions / np.sqrt(squares)
    assert np.abs(white.T @ white - np.eye(len(squares))).max() < 1e-9


def test_small_values_are_relatively_exact():
    """Where a product of R with itself would have lost them: 1e-9 of the largest."""
    a, b = np.array([1.0, 1e-3, 1e-6, 1e-9]), np.array([0.5, 1e-4, 1e-7])
    found = np.sqrt(W.dqds(a, b))
    assert math.isclose(math.prod(found), math.prod(a), rel_tol=1e-13)
    for k, v in enumerate(W.dqds(a, b)):
        z = W._twisted(a, b, v)
        assert np.linalg.norm((np.diag(a) + np.diag(b, 1)) @ z) == pytest.approx(found[k], rel=1e-8)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 AS n", "'a' AS x", "'b' AS key")


def test_against_plain_algebra(spark):
    vectors = rng.normal(size=(400, 18)).astype(np.float32)
    vectors[:130] = vectors[0]  # a third are one vector
    rows = [(i % 390, v.tolist(), 0) for i, v in enumerate(vectors)]
    bad = [None, [None] + [0.0] * 17, [float("nan")] + [0.0] * 17, [float("inf")] * 18, [], [1.0, 2.0]]
    out = W.whiten(frame(spark, [*rows, (None, vectors[3].tolist(), 1), *((900 + i, v, 1) for i, v in enumerate(bad))])).collect()
    x = np.floor(vectors.astype(np.float64) * 64).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    values, turned = np.linalg.eigh((fit - fit.mean(axis=0)).T @ (fit - fit.mean(axis=0)) / n)
    values, turned = values[::-1], turned[:, ::-1]
    assert len(out) == 401 * 16 and {r["n"] for r in out} == {n} and {r["vec_id"] for r in out} == {None, *range(390)}
    for c in range(16):
        got = {(r["vec_id"], r["deviation"]): r for r in out if r["component"] == c + 1}
        pairs = []
        for (key, _, _), v in zip(rows, x, strict=True):
            r = got[key, sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums, strict=True))]
            pairs.append((r["whitened"], float((v - sums / n) @ turned[:, c] / np.sqrt(values[c]))))
            assert r["explained"] == pytest.approx(values[c] / values.sum(), rel=1e-9)
        a, b = np.array(pairs).T
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
    errors = {r["identity_error"] for r in out}
    assert len(errors) == 1 and errors.pop() < 1e-9


def test_odd_tables(spark):
    assert W.whiten(frame(spark, [])).collect() == []
    assert W.whiten(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)])).collect() == []
    out = W.whiten(frame(spark, [(1, [0.0, 3.0], 0), (2, [1.0, 3.0], 0), (2, [1.0, 3.0], 0)])).collect()
    assert [(r["component"], r["n"], abs(round(r["whitened"], 12))) for r in out] == [(1, 2, 1.0)] * 3
    assert W.whiten(frame(spark, [(1, [0.0], 0), (2, [1.0], 0)])).schema["vec_id"].dataType.simpleString() == "bigint"


def test_factors_of_many_tasks(spark):
    vectors = rng.normal(size=(500, 5))
    points = spark.createDataFrame([([int(v * 1000) for v in r],) for r in vectors], "x array<long>").repartition(40)
    x = np.array([[int(v * 1000) for v in r] for r in vectors])
    r = W.triangular(points, 5, 500, x.sum(axis=0))
    centred = x - x.mean(axis=0)
    assert np.allclose(r.T @ r, centred.T @ centred, rtol=1e-10, atol=1e-4)


def test_deviations_beyond_64_bits_are_null():
    assert W._deviations(np.array([[2**31, 1], [2**32, 0]])) == [2**62 + 1, None]
