"""Whitening of embeddings: blockwise QR, bidiagonalisation, dqds, twisted factorisations.

Tasks centre their rows exactly in integers and keep one triangular factor each, whatever
their number of rows; factors are stacked and reduced again in a tree until one, R, is
left. Its singular values are those of all centred rows, its right singular vectors the
principal directions. R, of the size of the dimension squared, comes to the driver, which
makes it bidiagonal by reflections, finds the squared singular values of the bidiagonal
matrix by differential quotient-difference sweeps with shifts, and each wanted vector from
the twisted factorisation whose pivot is smallest. The product of R with itself, whose
rounding would cost half of the digits, is never formed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsweep.llm.common import staged

#: Entries become integers: floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows that a task adds to its triangular factor at once; factors stacked in one step.
BLOCK, FAN_IN = 2048, 16
_EPS = float(np.finfo(np.float64).eps)
#: Eigenvalues closer than this, relative to their size, get vectors made orthogonal.
CLOSE = 1e-6


# --- the small problem: R, as large as the dimension ----------------------------------

def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """``v, beta`` of the reflection I - beta v v' that maps x to a multiple of e1."""
    v, size = x.astype(np.float64).copy(), float(np.linalg.norm(x))
    if size == 0.0:
        return v, 0.0
    v[0] += np.copysign(size, v[0])
    return v, 2.0 / float(v @ v)


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a, b, right``: diagonal, superdiagonal, and the orthogonal matrix whose columns
    turn right singular vectors of the bidiagonal matrix into those of ``r``."""
    m, n = r.astype(np.float64).copy(), r.shape[1]
    right = np.eye(n)
    for k in range(n):
        v, beta = _reflector(m[k:, k])
        m[k:, k:] -= np.outer(beta * v, v @ m[k:, k:])
        if k < n - 2:
            v, beta = _reflector(m[k, k + 1:])
            m[k:, k + 1:] -= np.outer(m[k:, k + 1:] @ v, beta * v)
            right[:, k + 1:] -= np.outer(right[:, k + 1:] @ v, beta * v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _sweep(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], float] | None:
    """One dqds sweep; None if the shift was more than the smallest value."""
    n, d = len(q), q[0] - shift
    out_q, out_e, least = [0.0] * n, [0.0] * (n - 1), d
    for i in range(n - 1):
        if d < 0.0:
            return None
        out_q[i] = d + e[i]
        if out_q[i] == 0.0:
            ratio = 0.0
            out_e[i] = 0.0
        else:
            ratio = q[i + 1] / out_q[i]
            out_e[i] = e[i] * ratio
        d = d * ratio - shift if out_q[i] else q[i + 1] - shift
        least = min(least, d)
    if d < 0.0:
        return None
    out_q[-1] = d
    return out_q, out_e, least


def dqds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared singular values of the bidiagonal matrix, falling, each to high relative accuracy.

    Only sums, products and quotients of non-negative numbers are formed, but for the
    shift, which is taken back when it would make a number negative.
    """
    found: list[float] = []
    todo = [([float(x) * float(x) for x in a], [float(x) * float(x) for x in b], 0.0)]
    while todo:
        q, e, moved = todo.pop()
        least, sweeps = None, 0
        while q:
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            cut = next((i for i in range(len(e)) if e[i] <= _EPS * _EPS * (q[i] + moved) or e[i] <= _EPS * _EPS * (q[i + 1] + moved)), None)
            if cut is not None:  # the matrix falls apart: each part on its own
                todo.append((q[:cut + 1], e[:cut], moved))
                q, e, least = q[cut + 1:], e[cut + 1:], None
                continue
            if e[-1] <= _EPS * (q[-1] + moved) * 0.25 and e[-1] * 4.0 <= _EPS * max(q[-2] - q[-1], 0.0):
                found.append(q[-1] + moved)
                q, e, least = q[:-1], e[:-1], None
                continue
            if q[0] < q[-1] and sweeps % 8 == 0:  # sweeps work from large to small
                q, e, least = q[::-1], e[::-1], None
            # the corner's smaller eigenvalue is near the least value from above
            x, y, z = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            half, mean = 0.5 * (x - y), 0.5 * (x + y)
            corner = mean - float(np.hypot(half, np.sqrt(z)))
            shift = max(0.0, min(corner * (1 - 2 * _EPS), least if least is not None else corner) * (0.98 if sweeps < 40 else 0.5))
            if sweeps > 200:
                shift = 0.0
            done = None
            while shift > 0.0 and done is None:
                done = _sweep(q, e, shift)
                if done is None:
                    least, shift = None, shift * 0.25 if shift > _EPS * (q[-1] + moved) else 0.0
            if done is None:
                shift, done = 0.0, _sweep(q, e, 0.0)
            q, e, least = done
            moved += shift
            sweeps += 1
    return np.sort(np.array(found))[::-1]


def _twisted(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The vector of B'B at ``value``: factorisations from both ends meet where the pivot is least."""
    n = len(a)
    d = a * a
    low = np.divide(b, a[:-1], out=np.zeros(n - 1), where=a[:-1] != 0)
    tiny = np.finfo(np.float64).tiny / _EPS
    down, s = np.zeros(n - 1), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + d[i]
        pivot = pivot if pivot else -tiny
        down[i] = low[i] * d[i] / pivot
        s[i + 1] = down[i] * low[i] * s[i] - value
    up, p = np.zeros(n - 1), np.zeros(n)
    p[-1] = d[-1] - value
    for i in range(n - 2, -1, -1):
        pivot = low[i] * low[i] * d[i] + p[i + 1]
        pivot = pivot if pivot else -tiny
        t = d[i] / pivot
        up[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    twist = int(np.argmin(np.abs(s + p + value)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -down[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -up[i] * z[i]
    return z / np.linalg.norm(z)


def principal(r: np.ndarray, wanted: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``squares, directions, all_squares``: the largest squared singular values of ``r``
    with unit right singular vectors as columns, and all squares.

    Values at rounding level (rank lost) have no direction and are left out of the first
    two. A bidiagonal matrix with a zero on its superdiagonal is solved part by part.
    Vectors of values that are close to each other are made orthogonal, and turned within
    the space they span to what fits ``r`` best.
    """
    n = r.shape[1]
    if n == 0 or not np.any(r):
        return np.zeros(0), np.zeros((n, 0)), np.zeros(n)
    r = np.vstack([r, np.zeros((max(n - len(r), 0), n))])  # fewer rows than columns
    a, b, right = bidiagonal(r)
    size = float(max(np.abs(a).max(), np.abs(b).max() if n > 1 else 0.0))
    cuts = [0, *(i + 1 for i in range(n - 1) if abs(b[i]) <= _EPS * size * 1e-3), n]
    pairs: list[tuple[float, int, int]] = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        pairs += [(float(v), lo, hi) for v in dqds(a[lo:hi], b[lo:hi - 1])]
    pairs.sort(key=lambda x: -x[0])
    squares = np.array([v for v, _, _ in pairs])
    rank = int((np.sqrt(squares) > n * _EPS * np.sqrt(squares[0])).sum())
    # a run of close values is solved whole, also beyond the last wanted one
    take = min(wanted, rank)
    while 0 < take < rank and squares[take - 1] - squares[take] <= CLOSE * squares[take - 1]:
        take += 1
    z = np.zeros((n, take))
    for k, (value, lo, hi) in enumerate(pairs[:take]):
        z[lo:hi, k] = _twisted(a[lo:hi], b[lo:hi - 1], value) if hi - lo > 1 else 1.0
    directions, k = right @ z, 0
    while k < take:
        end = k + 1
        while end < take and squares[end - 1] - squares[end] <= CLOSE * squares[end - 1]:
            end += 1
        if end - k > 1:
            directions[:, k:end] = _within(r, directions[:, :k], directions[:, k:end])
        k = end
    return squares[:min(wanted, rank)], directions[:, :min(wanted, rank)], squares


def _within(r: np.ndarray, before: np.ndarray, close: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the space of ``close``, by falling size under ``r``.

    Where twisted vectors of nearly equal values fall together, the space is filled up
    by a few steps of subspace iteration.
    """
    base = close.copy()
    rnd = np.random.default_rng(7)
    for k in range(base.shape[1]):
        v = base[:, k]
        for _ in range(3):
            v = v - base[:, :k] @ (base[:, :k].T @ v)
            if np.linalg.norm(v) < 1e-3:
                v = rnd.normal(size=len(v))
            v = v / np.linalg.norm(v)
        base[:, k] = v
    for _ in range(60):
        image = r.T @ (r @ base)
        image -= before @ (before.T @ image)
        image, _ = np.linalg.qr(image)
        if np.linalg.norm(image - base @ (base.T @ image)) < 1e-14 * np.sqrt(base.shape[1]):
            break
        base = image
    small = r @ base
    a, b, right = bidiagonal(np.linalg.qr(small, mode="r"))
    _, _, turn = np.linalg.svd(np.diag(a) + np.diag(b, 1))
    return base @ (right @ turn.T)


# --- Spark ----------------------------------------------------------------------------

def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten()).reshape(-1, dims)


def _sums(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, np.int64)
        for batch in batches:
            n += batch.num_rows
            total += _matrix(batch.column(0), dims).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.tolist()], pa.list_(pa.int64()))],
                                             names=["n", "sums"])

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Rows minus mean; the difference is exact before the one division."""
    return (n * x - sums).astype(np.float64) / n


def _factors(dims: int, n: int, sums: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, dims))
        for batch in batches:
            rows = _matrix(batch.column(0), dims)
            for at in range(0, len(rows), BLOCK):
                r = np.linalg.qr(np.vstack([r, _centred(rows[at:at + BLOCK], n, sums)]), mode="r")
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(r).tobytes()], pa.binary())], names=["r"])

    return run


def _stack(dims: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        r = np.zeros((0, dims))
        for packed in frame["r"]:
            r = np.linalg.qr(np.vstack([r, np.frombuffer(packed, np.float64).reshape(-1, dims)]), mode="r")
        return pd.DataFrame({"g": [int(frame["g"].iloc[0])], "r": [np.ascontiguousarray(r).tobytes()]})

    return run


def triangular(points: DataFrame, dims: int, n: int, sums: np.ndarray) -> np.ndarray:
    """R of all centred rows: a factor a task, then factors of factors until one is left."""
    factors = staged(points.mapInArrow(_factors(dims, n, sums), "r binary").select(
        F.monotonically_increasing_id().alias("id"), "r"), "factors")
    while (left := factors.count()) > 1:
        groups = -(-left // FAN_IN)
        dealt = factors.select(F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"), "r")
        factors = staged(dealt.groupBy("g").applyInPandas(_stack(dims), "g long, r binary").select(F.col("g").alias("id"), "r"), "factors")
    return np.frombuffer(bytes(factors.first()["r"]), np.float64).reshape(-1, dims)


def _gram(dims: int, n: int, sums: np.ndarray, turn: np.ndarray):
    size = turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            w = _centred(_matrix(batch.column(0), dims), n, sums) @ turn
            total += w.T @ w
            first += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(range(size * size + size)), pa.int32()), pa.array(np.concatenate([total.ravel(), first]))], names=["at", "value"])

    return run


def _deviations(d: np.ndarray) -> list[int | None]:
    """Exact sums of squares; null beyond 64 bits."""
    most = int(np.abs(d).max(initial=0))
    if most * most * max(d.shape[1], 1) < 2**63:
        return (d * d).sum(axis=1).tolist()
    found = [sum(int(x) * int(x) for x in row) for row in d]
    return [x if x < 2**63 else None for x in found]


def _projected(dims: int, n: int, sums: np.ndarray, turn: np.ndarray, explained: np.ndarray, error: float):
    size = turn.shape[1]
    names = ["key", "component", "n", "deviation", "whitened", "explained", "identity_error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                m = batch.num_rows
                d = n * _matrix(batch.column(1), dims) - sums
                each = np.repeat(np.arange(m), size)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * size, n, np.int64)),
                    pa.array(_deviations(d), pa.int64()).take(pa.array(each)),
                    pa.array(((d.astype(np.float64) / n) @ turn).ravel()),
                    pa.array(np.tile(explained, m)),
                    pa.array(np.full(m * size, error)),
                ], names=names)

    return run


def integer_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """``key, x``: entries as integers; rows whose vector is null, empty or holds a null or
    non-finite entry are left out, and so are lengths other than the most frequent one."""
    v = F.col("v")
    given = rows.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    whole = given.where(v.isNotNull() & (F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    return whole.select("key", F.transform("v", lambda c: F.floor(c * SCALE).cast("long") + F.lit(OFFSET)).alias("x"))


EMPTY = "key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: the key, ``component, n, deviation, whitened,
    explained, identity_error``.

    Vectors become integers; the fit uses each distinct one once, all rows are projected.
    Rows whose vector is null, empty or holds a null or non-finite entry are dropped; if
    lengths differ, the most frequent one counts (of equally frequent ones the largest)
    and the others are dropped. There are at most ``wanted`` components, and only those
    with variance: fewer for short vectors, lost rank or few distinct vectors, none (no
    rows) for an empty table or if all vectors are equal. Null and repeated keys are rows
    like any other; other columns are not looked at. A ``deviation`` beyond 64 bits is null.
    """
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    points = staged(integer_vectors(rows, key, vector), "vectors")
    length = points.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    out = EMPTY.format(kind=kind)
    if length is None:
        return spark.createDataFrame([], out).withColumnRenamed("key", key)
    dims = length["dims"]
    points = points.where(F.size("x") == dims)
    fit = staged(points.select("x").distinct(), "fit")
    parts = fit.mapInArrow(_sums(dims), "n long, sums array<long>")
    total = parts.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s")).collect()
    n, sums = total[0]["n"], np.array([r["s"] for r in sorted(total, key=lambda r: r["pos"])], np.int64)
    squares, directions, every = principal(triangular(fit, dims, n, sums), wanted)
    if not len(squares):
        return spark.createDataFrame([], out).withColumnRenamed("key", key)
    turn = directions / np.sqrt(squares / n)
    size = turn.shape[1]
    gram = np.zeros(size * size + size)
    for r in fit.mapInArrow(_gram(dims, n, sums, turn), "at int, value double").groupBy("at").agg(F.sum("value").alias("v")).collect():
        gram[r["at"]] = r["v"]
    mean = gram[size * size:] / n
    error = float(np.abs(gram[:size * size].reshape(size, size) / n - np.outer(mean, mean) - np.eye(size)).max())
    project = _projected(dims, n, sums, turn, squares / every.sum(), error)
    return points.mapInArrow(project, out).withColumnRenamed("key", key)
