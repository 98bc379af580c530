"""Held-out accuracy on the given labels, and defined results for odd tables."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from glyphsweep.llm import quality, toxicity

SF = "/root/testdata/sf0.1"


def ranking(scores, labels) -> float:
    """Area under the ROC curve."""
    scores, labels = np.array(scores), np.array(labels, bool)
    good, bad = scores[labels][:, None], scores[~labels][None, :]
    return float((good > bad).mean() + 0.5 * (good == bad).mean())


@pytest.mark.parametrize("module, label, folds, out", [(quality, "quality", 5, 0), (toxicity, "toxic", 4, 2)])
def test_held_out_accuracy(spark, module, label, folds, out):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = module.classify(docs, labels)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == out)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in rows if r.held_out]
    assert ranking([r.score for r in held], [r[label] for r in held]) > 0.96
    assert np.mean([r.predicted == r[label] for r in held]) > 0.97


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_odd_tables(spark, module, label):
    docs = spark.createDataFrame([(None, "a", 1), (2, None, 1), (2, None, 1), (3, "", 1), (4, "word " * 30_000, 1)],
                                 "doc_id long, text string, score int")
    labels = spark.createDataFrame([(2, None), (None, 1)], f"doc_id long, {label} int")
    rows = module.classify(docs, labels).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert len({r.score for r in rows if r.doc_id in (2, 3)}) == 1
    assert module.classify(docs.limit(0), labels).count() == 0


@pytest.mark.parametrize("n_rows, n_words", [(500, 40), (1500, 200)])
def test_labels_that_depend_on_pairs_only(n_rows, n_words):
    rnd = random.Random(1)
    insults, groups = ["grobian", "lumpkin"], ["marsians", "venusfolk"]
    common = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(8 * n_words)]
    rows, labels = [], []
    for i in range(n_rows):
        # each insult and each group is as frequent in both classes
        words = [*rnd.choices(common, k=n_words), insults[i % 2], groups[i // 2 % 2]]
        rows.append(toxicity.terms(" ".join(rnd.sample(words, len(words)))))
        labels.append(float(i % 2 == i // 2 % 2))
    known = n_rows * 3 // 4
    model = toxicity.fit(rows[:known], np.array(labels[:known]), np.ones(known))
    assert ranking([model.score(r) for r in rows[known:]], labels[known:]) > 0.97


def test_shapes_read_whole_words():
    same, other = "\u6f22" * 60 + "\u3002" + "\u5b57" * 60, "\u6f22" * 60 + "7" + "\u5b57" * 60
    shapes = [quality.features(t)[quality.DENSE:] for t in (same, other)]
    assert (shapes[0] != shapes[1]).any()


def test_vectors_are_used_where_held_back_rows_gain():
    """On the given labels the pair term lowers the loss of rows it was not fitted on."""
    import pandas as pd

    docs, labels = (pd.read_parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    known = docs.merge(labels[labels.toxic.isin([0, 1])], on="doc_id")
    held = np.array([zlib.crc32(str(k).encode()) % 4 == 2 for k in known.doc_id])
    rows, y = [toxicity.terms(t or "") for t in known.text], known.toxic.to_numpy(float)
    kept = np.flatnonzero(~held)
    fitted = toxicity.fit_chosen([rows[i] for i in kept], y[kept], np.ones(len(kept)))
    best = min(fitted.factor_losses, key=fitted.factor_losses.get)
    assert best is not None and fitted.factor_losses[best] < 0.95 * fitted.factor_losses[None]
    assert (np.abs(fitted.model.factors).sum(axis=1) > 0).sum() > 1000

    def loss(model):
        p = np.clip([model.score(rows[i]) for i in np.flatnonzero(held)], 1e-9, 1 - 1e-9)
        return -np.mean(np.where(y[held] == 1, np.log(p), np.log(1 - p)))

    alone = toxicity.Model(fitted.model.bias, fitted.model.weights, np.zeros_like(fitted.model.factors))
    assert loss(fitted.model) < loss(alone)


def test_labels_without_pairs_get_no_vectors():
    rnd = random.Random(2)
    common = ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(60)]
    rows, labels = [], []
    for i in range(240):
        rows.append(toxicity.terms(" ".join([*rnd.choices(common, k=8), "grobian" if i % 2 else "marsian"])))
        labels.append(float(rnd.random() < (0.9 if i % 2 else 0.1)))
    fitted = toxicity.fit_chosen(rows, np.array(labels), np.ones(len(rows)))
    best = min(fitted.factor_losses, key=fitted.factor_losses.get)
    assert (best is None) == (fitted.model.factors == 0).all() or fitted.factor_losses[best] <= fitted.factor_losses[None]
