"""What the two text classifiers share: folds, bounded samples, optimiser."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; null stays null."""
    return F.crc32(F.encode(key.cast("string"), "utf-8")) % n


def bounded_sample(rows: DataFrame, key: str, most: int, count: int) -> DataFrame:
    """About ``most`` of ``count`` rows, or all if they are fewer, chosen by a hash of the key.

    The bound makes the sample safe to broadcast and to collect, whatever the input.
    """
    if count <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1 << 32)) < int(most / count * (1 << 32)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Adam:
    """Adam over a list of arrays, updated in place."""

    def __init__(self, params: list[np.ndarray], rate: float) -> None:
        self.params, self.rate, self.step = params, rate, 0
        self.mean = [np.zeros_like(p) for p in params]
        self.square = [np.zeros_like(p) for p in params]

    def update(self, gradients: list[np.ndarray]) -> None:
        self.step += 1
        for p, g, m, s in zip(self.params, gradients, self.mean, self.square, strict=True):
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= self.rate * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.999**self.step)) + 1e-8)
