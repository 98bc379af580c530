"""Toxicity classifier: a factorization machine over hashed terms.

Terms are the distinct words of a text with their beginnings and ends, hashed. Besides a
weight, each term has a small vector; the inner product of two vectors is what the pair
adds, so that an insult next to a group's name can count although each alone is neutral.
All pairs of a text are summed in time linear in its terms. Every term in ``LEAST_ROWS``
rows of the sample has a weight and a vector; penalties by what chance would give shrink
those that tell nothing, so that long texts do not drown in their pairs. How much is
chosen on rows held back from the fit, for the weights and then for the vectors, which
are left out only if they do no good there. The vectors start small and random, and from
the pairs that the weights alone leave unexplained. The model is fitted with logistic
loss on a bounded sample of labelled rows; every text is scored whole, in tasks.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphsweep.llm.common import text_or_empty
from glyphsweep.llm.learning import bounded_sample, fold, sigmoid

MOST_TOXIC, MOST_CLEAN = 3_000, 6_000
TERMS, FACTORS = 1 << 17, 4
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Terms in fewer rows of the sample have no weight and no vector.
LEAST_ROWS = 4
#: Penalties in units of the largest slope chance would give: those of these that do best
#: on every fourth row when fitted on the others.
WEIGHT_PENALTIES, FACTOR_PENALTIES = (0.1, 0.3, 0.6, 1.0), (0.15, 0.5, 1.2)
#: Rows of each class from which the vectors get their start, and terms in one matrix.
START_ROWS, START_BLOCK = 500, 4_096
_CACHE = 200_000
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class _TermIds(dict):
    """Word to the hashed terms it stands for."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        parts = [word, *("^" + word[:n] for n in (3, 4, 5) if len(word) > n), *(word[-n:] + "$" for n in (4,) if len(word) > n)]
        found = tuple(zlib.crc32(p.encode("utf-8", "replace")) % TERMS for p in parts)
        if len(self) < _CACHE:
            self[word] = found
        return found


_term_ids = _TermIds()


def terms(text: str) -> np.ndarray:
    """Distinct hashed terms of a text, ascending."""
    found: set[int] = set()
    for word in set(_WORD.findall(text.lower())):
        found.update(_term_ids[word])
    return np.array(sorted(found), np.int32)


@dataclass
class Model:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def score(self, ids: np.ndarray) -> float:
        margin = self.bias + self.weights[ids].sum()
        v = self.factors[ids]
        total = v.sum(axis=0)
        margin += 0.5 * float((total * total).sum() - (v * v).sum())
        return float(sigmoid(np.float64(margin)))


@dataclass
class _Rows:
    """Labelled rows as places of their terms among the used ones."""

    terms: list[np.ndarray]
    labels: np.ndarray
    share: np.ndarray
    width: int

    def flat(self, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the rows ``part``, and for each the place of its row in ``part``."""
        chosen = [self.terms[i] for i in part]
        return np.concatenate(chosen), np.repeat(np.arange(len(part)), [len(r) for r in chosen])


def unexplained_pairs(rows: _Rows, among: np.ndarray, bias: float, weights: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """``a, b, z``: pairs of terms whose joint rows among the given ones the weights misjudge
    more than chance explains.

    They only give the vectors a start, so a bounded number of rows of each class will do.
    """
    few = np.concatenate([rng.permutation(among[rows.labels[among] == c])[:START_ROWS] for c in (0, 1)])
    ids, row_of = rows.flat(few)
    rest = rows.labels[few] - sigmoid(bias + np.bincount(row_of, weights[ids], len(few)))
    rest = (rest - rest.mean()).astype(np.float32)
    # a pair in fewer rows could not pass
    used = np.flatnonzero(np.bincount(ids, minlength=rows.width) >= max(LEAST_ROWS, int(np.log(max(2, rows.width)))))
    place = np.full(rows.width, -1, np.int32)
    place[used] = np.arange(len(used))
    ids, row_of = place[ids][place[ids] >= 0], row_of[place[ids] >= 0]
    order = np.argsort(ids, kind="stable")
    ids, row_of = ids[order], row_of[order]
    cuts = np.searchsorted(ids, np.arange(0, len(used) + START_BLOCK, START_BLOCK))

    def dense(i: int) -> np.ndarray:
        x = np.zeros((len(few), min(START_BLOCK, len(used) - i * START_BLOCK)), np.float32)
        x[row_of[cuts[i]:cuts[i + 1]], ids[cuts[i]:cuts[i + 1]] - i * START_BLOCK] = 1
        return x

    bar = np.sqrt(2 * np.log(max(2, len(used) * (len(used) - 1) / 2))) + 1
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
    alone = (np.bincount(ids, rest[row_of], len(used)) / np.bincount(ids, minlength=len(used))).astype(np.float32)
    spread = np.float32((rest * rest).mean())
    blocks = -(-len(used) // START_BLOCK)
    for i in range(blocks):
        x = dense(i)
        signed = (x * rest[:, None]).T
        for j in range(i, blocks):
            y = x if i == j else dense(j)
            z, both = signed @ y, x.T @ y
            # less what either term alone leaves unexplained
            z -= both * (alone[i * START_BLOCK:][:x.shape[1], None] + alone[j * START_BLOCK:][:y.shape[1]])
            z /= np.sqrt(spread * both + 1)
            a, b = np.nonzero(np.abs(z) > bar)
            once = a + i * START_BLOCK < b + j * START_BLOCK
            found.append((a[once] + i * START_BLOCK, b[once] + j * START_BLOCK, z[a[once], b[once]]))
    a, b, z = map(np.concatenate, zip(*found, strict=True))
    return used[a], used[b], z


def leading_vectors(a: np.ndarray, b: np.ndarray, z: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """The terms of the pairs, and their entries in the leading eigenvectors of the pair matrix."""
    nodes = np.unique(np.concatenate([a, b]))
    a, b = np.searchsorted(nodes, a), np.searchsorted(nodes, b)
    # shifted, so that the largest positive eigenvalue leads
    shift = 0.5 * (np.bincount(a, np.abs(z), len(nodes)) + np.bincount(b, np.abs(z), len(nodes))).max()
    u = rng.normal(size=(len(nodes), min(FACTORS, len(nodes))))
    for _ in range(100):
        u = np.linalg.qr(np.stack([np.bincount(a, z * c[b], len(nodes)) + np.bincount(b, z * c[a], len(nodes)) + shift * c
                                   for c in u.T], 1))[0]
    start = np.zeros((FACTORS, len(nodes)))
    start[:u.shape[1]] = (u / np.abs(u).max(axis=0)).T
    return nodes, start


def _margins(table: _Rows, part: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray | None) -> np.ndarray:
    ids, row_of = table.flat(part)
    margin = bias + np.bincount(row_of, weights[ids], len(part))
    if factors is not None and factors.any():
        sums = np.stack([np.bincount(row_of, f[ids], len(part)) for f in factors])
        margin += 0.5 * ((sums * sums).sum(axis=0) - np.bincount(row_of, (factors * factors).sum(axis=0)[ids], len(part)))
    return margin


def _loss(table: _Rows, part: np.ndarray, model: tuple) -> float:
    """Mean weighted logistic loss of the rows ``part``."""
    margin, y = _margins(table, part, *model), table.labels[part]
    return float((table.share[part] * np.logaddexp(0, np.where(y == 1, -margin, margin))).sum() / table.share[part].sum())


@dataclass
class Fitted:
    """A model with what chose it: losses on held-back rows by penalty, ``None`` for no vectors."""

    model: Model
    weight_losses: dict[float, float]
    factor_losses: dict[float | None, float]


def fit(rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, epochs: int = 20, batch: int = 256,
        rate: float = 0.1, seed: int = 7) -> Model:
    return fit_chosen(rows, labels, importance, epochs, batch, rate, seed).model


def fit_chosen(rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, epochs: int = 20, batch: int = 256,
               rate: float = 0.1, seed: int = 7) -> Fitted:
    """Weights first, then weights and vectors, by proximal AdaGrad on the weighted logistic loss.

    Both penalties are those that do best on every fourth row when fitted on the others;
    the vectors are left out only if no penalty does better than none of them there.
    """
    none = Fitted(Model(-2.0, np.zeros(TERMS, np.float32), np.zeros((TERMS, FACTORS), np.float32)), {}, {})
    if not len(rows) or labels.min() == labels.max():
        return none
    in_rows = np.bincount(np.concatenate(rows), minlength=TERMS)
    used = np.flatnonzero(in_rows >= LEAST_ROWS)
    if not len(used):
        return none
    n, width = len(rows), len(used)
    place = np.full(TERMS, -1, np.int32)
    place[used] = np.arange(width)
    table = _Rows([place[r][place[r] >= 0] for r in rows], labels, importance / importance.mean(), width)
    toxic = min(max(float((table.share * labels).mean()), 1e-3), 1 - 1e-3)
    # slope of a term that has nothing to do with the label, at its largest among so many
    chance = np.sqrt(2 * np.log(max(2, width)) * toxic * (1 - toxic) * in_rows[used]) / n
    # all terms of a row move at once
    rate = min(rate, 1 / np.sqrt(max(1.0, np.mean([len(r) for r in table.terms]))))
    rng = np.random.default_rng(seed)

    def descend(among: np.ndarray, rounds: int, start: tuple, penalty: float, factor_penalty: float | None) -> tuple:
        bias, weights, factors = start[0], start[1].copy(), None if factor_penalty is None else start[2].copy()
        past_bias, past_weights, past_factors = 1e-8, np.full(width, 1e-6), np.full(width, 1e-6)
        for _ in range(rounds):
            order = rng.permutation(among)
            for part in (order[s:s + batch] for s in range(0, len(order), batch)):
                ids, row_of = table.flat(part)
                margin = bias + np.bincount(row_of, weights[ids], len(part))
                if factors is not None:
                    sums = [np.bincount(row_of, f[ids], len(part)) for f in factors]
                    squares = np.bincount(row_of, (factors * factors).sum(axis=0)[ids], len(part))
                    margin += 0.5 * (sum(s * s for s in sums) - squares)
                g = table.share[part] * (sigmoid(margin) - labels[part]) / len(part)
                by_term = np.bincount(ids, g[row_of], width)
                past_bias += g.sum() ** 2
                bias -= rate * g.sum() / np.sqrt(past_bias)
                past_weights += by_term * by_term
                step = rate / np.sqrt(past_weights)
                weights -= step * by_term
                weights = np.sign(weights) * np.maximum(0, np.abs(weights) - step * penalty * chance)
                if factors is not None:
                    slope = np.stack([np.bincount(ids, (g * s)[row_of], width) for s in sums]) - factors * by_term
                    past_factors += (slope * slope).sum(axis=0)
                    step = rate / np.sqrt(past_factors)
                    factors -= step * slope
                    length = np.maximum(np.sqrt((factors * factors).sum(axis=0)), 1e-12)
                    factors *= np.maximum(0, 1 - step * factor_penalty * chance / length)
        return bias, weights, factors

    def vectors_for(alone: tuple, among: np.ndarray) -> np.ndarray:
        """Small random vectors, and what pairs the weights leave unexplained."""
        factors = rng.normal(0, 0.01, (FACTORS, width))
        a, b, z = unexplained_pairs(table, among, alone[0], alone[1], rng)
        if len(z):
            nodes, leading = leading_vectors(a, b, z, rng)
            factors[:, nodes] += 0.5 * leading
        return factors

    blank = (np.log(toxic / (1 - toxic)), np.zeros(width))
    everyone = rng.permutation(n)
    kept, tried = everyone[n // 4:], everyone[:n // 4]
    weight_losses: dict[float, float] = {}
    factor_losses: dict[float | None, float] = {}
    penalty, factor_penalty, factors = WEIGHT_PENALTIES[-1], None, None
    if len(tried):
        alone = {p: descend(kept, epochs // 2, blank, p, None) for p in WEIGHT_PENALTIES}
        weight_losses = {p: _loss(table, tried, m) for p, m in alone.items()}
        penalty = min(weight_losses, key=weight_losses.get)
        begun = (*alone[penalty][:2], vectors_for(alone[penalty], kept))
        # as many rounds for either, so that only the pairs tell them apart
        factor_losses = {p: _loss(table, tried, descend(kept, epochs // 2, begun, penalty, p)) for p in (None, *FACTOR_PENALTIES)}
        factor_penalty, factors = min(factor_losses, key=factor_losses.get), begun[2]
    alone = descend(everyone, epochs, blank, penalty, None)
    bias, weights, factors = descend(everyone, epochs // 2, (*alone[:2], factors), penalty, factor_penalty)
    model = none.model
    model.bias = float(bias)
    model.weights[used] = weights
    if factors is not None:
        model.factors[used] = factors.T
    return Fitted(model, weight_losses, factor_losses)


def _ids(text: Column) -> Column:
    @F.pandas_udf(T.BinaryType())
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([terms(t).tobytes() for t in batch])

    return run(text_or_empty(text))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
          most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN) -> Model:
    """Fit on labels outside the held-out fold. Rows without key or label teach nothing."""
    known = labels.where(fold(F.col(key), FOLDS) != HELD_OUT).where(F.col(label).isin(0, 1)).groupBy(key).agg(
        F.max(label).alias("y"))  # marked toxic once is toxic
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = bounded_sample(known.where("y = 1"), key, most_toxic, counts.get(1, 0)).unionByName(
        bounded_sample(known.where("y = 0"), key, most_clean, counts.get(0, 0)))
    sample = docs.join(F.broadcast(chosen), key).select("y", _ids(F.col(text)).alias("ids")).toPandas()
    rows = [np.frombuffer(b, np.int32) for b in sample["ids"]]
    y = sample["y"].to_numpy(np.float64)
    # each class counts with its share of all labelled rows
    drawn = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    importance = np.where(y == 1, counts.get(1, 0) / drawn[1], counts.get(0, 0) / drawn[0])
    return fit(rows, y, importance)


def score(text: Column, model: Model) -> Column:
    """Probability of label 1, 0 to 1; null and empty texts have that of an empty text."""

    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([model.score(terms(t)) for t in batch], dtype="float64")

    return run(text_or_empty(text))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
             threshold: float = THRESHOLD, model: Model | None = None) -> DataFrame:
    """One row per document: the key, ``held_out, score, predicted``.

    Rows may repeat; a null key is not held out. Without labels of both classes every
    text gets the same low score. A key labelled both ways is toxic; an empty table gives
    no rows.
    """
    model = model or train(docs, labels, key, text)
    scored = docs.select(F.col(key).alias(key), F.coalesce(fold(F.col(key), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"),
                         score(F.col(text), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
