"""Exact distances as SQL expressions, and the numeric kernel for routing.

Exact distances add up double by double from left to right, so any engine that does the same agrees to the bit.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from vecgrove.errors import require


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def rank(metric: str, q: Column, x: Column) -> Column:
    """What results are ordered by."""
    if metric == "l2":
        return squared_l2(q, x)
    if metric == "inner_product":
        return -dot(q, x)
    norms = norm(q) * norm(x)
    return F.when(norms == 0, F.raise_error(F.lit("zero vector under cosine")).cast("double")).otherwise(F.lit(1.0) - dot(q, x) / norms)


def exposed(metric: str, ranked: Column) -> Column:
    """What callers see."""
    return F.sqrt(ranked) if metric == "l2" else ranked


def sequential_sum(x: np.ndarray) -> np.ndarray:
    """Left-to-right sums over the last axis in double precision."""
    return np.add.accumulate(x.astype(np.float64), axis=-1)[..., -1] if x.shape[-1] else np.zeros(x.shape[:-1])


def half_away(x: np.ndarray) -> np.ndarray:
    """Rounds to the nearest integer, halves away from zero."""
    a = np.abs(x)
    whole = np.floor(a)
    return np.sign(x) * (whole + (a - whole >= 0.5))


class Rotation:
    """Three rounds of seeded plane rotations by 45 degrees over shuffled pairs of axes; keeps norms and angles."""

    def __init__(self, dimension: int, seed: int, rounds: int = 3):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.pairs = [rng.permutation(dimension)[: dimension // 2 * 2].reshape(-1, 2) for _ in range(rounds)]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = np.array(x, np.float32)
        c = np.float32(np.sqrt(0.5))
        for pair in self.pairs:
            a, b = x[..., pair[:, 0]], x[..., pair[:, 1]]
            x[..., pair[:, 0]], x[..., pair[:, 1]] = (a + b) * c, (a - b) * c
        return x


class Kernel:
    """Preprocessing and routing distances of one index."""

    def __init__(self, metric: str, dimension: int, seed: int):
        self.metric, self.dimension, self.rotation = metric, dimension, Rotation(dimension, seed)

    def prepare(self, vectors: np.ndarray) -> np.ndarray:
        """Checks, normalises under cosine, and rotates rows."""
        x = np.asarray(vectors, np.float32)
        require(bool(np.isfinite(x).all()), "finite vector")
        if self.metric == "cosine" and len(x):
            size = np.sqrt(sequential_sum(x.astype(np.float64) ** 2))
            require(bool((size > 0).all()), "zero vector under cosine")
            x = (x / size[..., None]).astype(np.float32)
        return self.rotation(x)

    def routing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of each row of ``a`` to each of ``b``: squared L2, else negative dot."""
        a, b = a.astype(np.float64), b.astype(np.float64)
        inner = a @ b.T
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * inner if self.metric == "l2" else -inner

    def centre(self, mean: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            size = np.linalg.norm(mean)
            mean = mean / size if size > 0 else mean
        return mean.astype(np.float32)

    def dispersion(self, mean: np.ndarray) -> float:
        """Of a leaf under cosine, from its mean before normalising."""
        return float(np.sqrt(np.clip(1 - np.dot(mean, mean), 0, 1))) if self.metric == "cosine" else 0.0


DISPERSION_WEIGHT = 0.1
