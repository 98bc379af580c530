"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of the training folds with label 1; the unlabelled
sample is drawn from all texts, labels unseen. A linear model over text statistics and
hashed word shapes minimises the non-negative unbiased risk

    prior * R_p(+1)  +  max(0, R_u(-1) - prior * R_p(-1))

with logistic loss, so that its score estimates the probability of label 1. The class
prior is estimated from the labels of the training folds. Labelled negatives enter
nothing but that estimate.

The model is fitted on bounded samples (``most_positive``, ``most_unlabelled``); every
text is scored whole, in tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphsweep.llm.common import text_or_empty
from glyphsweep.llm.learning import Adam, bounded_sample, fold, sigmoid

MOST_POSITIVE, MOST_UNLABELLED = 6_000, 12_000
SHAPES = 256
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
_CACHE = 200_000

#: Byte classes: 0 other, 1 lower, 2 upper, 3 digit, 4 blank, 5 sentence mark, 6 symbol, 7 beyond ASCII.
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 7
_CLASS[[9, 10, 13, 32]] = 4
_CLASS[list(b".,;:?'\"()-")] = 5
_CLASS[list(b"!#$%&*+/<=>@[\\]^_`{|}~")] = 6


class _ShapeIds(dict):
    """Word to hashed shape: letters by case, digits and repeated marks folded."""

    def __missing__(self, word: str) -> int:
        shape = "".join(("A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c) for c in word)
        shape = "".join(c for c, _ in groupby(shape))
        found = zlib.crc32(shape.encode("utf-8")) % SHAPES
        if len(self) < _CACHE and len(word) <= 40:
            self[word] = found
        return found


_shape_ids = _ShapeIds()


def _forget() -> None:
    """At the end of a task: its process goes on to tasks of other stages."""
    _shape_ids.clear()


DENSE = 26


def features(text: str) -> np.ndarray:
    """Shares of byte classes, repetition and length statistics, and word shapes."""
    out = np.zeros(DENSE + SHAPES, np.float32)
    words = text.split()
    n = len(words)
    if not n:
        out[0] = 1.0
        return out
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    share = np.bincount(_CLASS[raw], minlength=8) / len(raw)
    equal = sum(map(eq, words, words[1:])) / max(1, n - 1)
    apart = sum(map(eq, words, words[2:])) / max(1, n - 2)
    distinct = len(set(words)) / n
    lines = [x for x in text.split("\n") if x]
    twice = 1 - len(set(lines)) / max(1, len(lines))
    length = len(text) / n
    values = [share[2], share[3], share[5], share[6], share[7], equal, apart, twice, 1 - distinct]
    out[1:10] = values
    out[10:19] = np.log1p(200 * np.asarray(values))
    out[19:26] = np.log1p(n) / 10, length / 10, abs(length - 6) / 10, n < 5, share[1], np.log1p(len(lines)) / 10, share[4]
    out[DENSE:] = np.sqrt(np.bincount(np.fromiter(map(_shape_ids.__getitem__, words), np.int64, n), minlength=SHAPES) / n)
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        return sigmoid(rows @ self.weights + self.bias)


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 400,
        decay: float = 1e-5, rate: float = 0.03) -> Model:
    """Minimise the non-negative risk; where its negative part is below zero, ascend it."""
    width = positive.shape[1] if len(positive) else DENSE + SHAPES
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(width, np.float32), float(np.log(prior / (1 - prior))), prior)
    weights, bias = np.zeros(width), np.array([np.log(prior / (1 - prior))])
    adam = Adam([weights, bias], rate)
    for _ in range(steps):
        p, u = sigmoid(positive @ weights + bias), sigmoid(unlabelled @ weights + bias)
        negative_risk = -np.log1p(-np.minimum(u, 1 - 1e-9)).mean() + prior * np.log1p(-np.minimum(p, 1 - 1e-9)).mean()
        # gradients of the losses by the margin, averaged
        pos_up, pos_down, unl_down = (p - 1) / len(p), p / len(p), u / len(u)
        if negative_risk >= 0:
            gp, gu = prior * (pos_up - pos_down), unl_down
        else:
            gp, gu = prior * pos_down, -unl_down
        g = positive.T @ gp + unlabelled.T @ gu + decay * weights
        adam.update([g, np.array([gp.sum() + gu.sum()])])
    return Model(weights.astype(np.float32), float(bias[0]), prior)


def _vectors(text: Column) -> Column:
    @F.pandas_udf(T.BinaryType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for batch in batches:
                yield pd.Series([features(t).tobytes() for t in batch], dtype="object")
        finally:
            _forget()

    return run(text_or_empty(text))


def _matrix(rows: DataFrame) -> np.ndarray:
    """The vectors of a bounded sample."""
    cells = rows.toPandas()["v"]
    return np.stack([np.frombuffer(c, np.float32) for c in cells]).astype(np.float64) if len(cells) else np.zeros((0, DENSE + SHAPES))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
          most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fit on labels outside the held-out fold. Rows without key or label teach nothing."""
    known = labels.where(fold(F.col(key), FOLDS) != HELD_OUT).where(F.col(label).isNotNull()).select(key, label)
    counts = known.agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("pos")).first()
    prior = float(np.clip((counts["pos"] + 1) / (counts["n"] + 2), 0.01, 0.99))
    chosen = bounded_sample(known.where(F.col(label) == 1).select(key).distinct(), key, most_positive, counts["pos"])
    positive = docs.join(F.broadcast(chosen), key, "left_semi").select(_vectors(F.col(text)).alias("v"))
    unlabelled = bounded_sample(docs, key, most_unlabelled, docs.count()).select(_vectors(F.col(text)).alias("v"))
    return fit(_matrix(positive), _matrix(unlabelled), prior)


def score(text: Column, model: Model) -> Column:
    """Probability of label 1, 0 to 1; null and empty texts have that of an empty text."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        try:
            for batch in batches:
                yield pd.Series([float(model.score(features(t))) for t in batch], dtype="float64")
        finally:
            _forget()

    return run(text_or_empty(text))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """One row per document: the key, ``held_out, score, predicted``.

    Rows may repeat; a null key is not held out. Without positives every score is the
    estimated prior.
    """
    model = model or train(docs, labels, key, text)
    scored = docs.select(F.col(key).alias(key), F.coalesce(fold(F.col(key), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                         score(F.col(text), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those scored below ``threshold``, all columns kept."""
    model = train(docs, labels, key, text)
    return docs.where(score(F.col(text), model) >= threshold)
