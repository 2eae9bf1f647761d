"""Seven-bit codes of vectors, their rough distances, and intervals that hold the exact ones."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from vecgrove.functions.distance import half_away, sequential_sum

LEVELS = 63
_EPS = np.finfo(np.float64).eps


@dataclass
class Codes:
    code: np.ndarray
    scale: np.ndarray
    norm_sq: np.ndarray
    err: np.ndarray


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, np.inf)


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x, -np.inf)


def encode(x: np.ndarray) -> Codes:
    """Codes of each row: signed magnitudes up to LEVELS, the best scale, and a bound of what is lost."""
    x = np.asarray(x, np.float32).astype(np.float64)
    largest = np.abs(x).max(axis=1, initial=0.0)
    step = np.where(largest > 0, largest / LEVELS, 1.0)
    code = np.clip(half_away(x / step[:, None]), -LEVELS, LEVELS)
    norm_sq = (code * code).sum(axis=1)
    scale = np.maximum(0.0, sequential_sum(x * code) / np.maximum(norm_sq, 1.0)).astype(np.float32)
    rest = x - scale.astype(np.float64)[:, None] * code
    lost = np.sqrt(sequential_sum(rest * rest)) * (1 + 4 * x.shape[1] * _EPS)
    err = lost.astype(np.float32)
    err = np.where(err < lost, np.nextafter(err, np.float32(np.inf)), err).astype(np.float32)
    return Codes(code.astype(np.int8), scale, norm_sq.astype(np.int32), err)


class Query:
    """A query vector in integers, with a bound of what its rounding loses."""

    def __init__(self, q: np.ndarray, metric: str):
        self.metric = metric
        q = np.asarray(q, np.float32).astype(np.float64)
        n = max(1, len(q))
        levels = min(32767, (2**31 - 1) // (LEVELS * n))
        largest = np.abs(q).max(initial=0.0)
        self.step = largest / levels if largest > 0 else 1.0
        self.a = half_away(q / self.step)
        slack = 1 + 8 * n * _EPS
        self.norm = float(np.sqrt((q * q).sum()) * slack)
        self.square = float(sequential_sum(q * q))
        rest = q - self.step * self.a
        self.lost = float(np.sqrt((rest * rest).sum()) * slack + 4 * _EPS * self.norm)

    def rough(self, c: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rough rank, and lower and upper bounds of the exact rank."""
        inner = (c.code.astype(np.float64) @ self.a) * self.step * c.scale.astype(np.float64)
        return _bounds(self.metric, inner, self.square, self.norm, self.lost, c)


def _rough(metric: str, inner: np.ndarray, square: float | np.ndarray, c: Codes) -> np.ndarray:
    if metric == "l2":
        scale, size = c.scale.astype(np.float64), c.norm_sq.astype(np.float64)
        return np.maximum(0.0, square + scale * scale * size - 2 * inner)
    return -inner if metric == "inner_product" else 1 - inner


def _bounds(metric: str, inner: np.ndarray, square: float | np.ndarray, norm: float | np.ndarray, lost: float | np.ndarray, c: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    scale, size, err = c.scale.astype(np.float64), c.norm_sq.astype(np.float64), c.err.astype(np.float64)
    own, rough = lost * scale * np.sqrt(size) + 8 * _EPS * np.abs(inner), _rough(metric, inner, square, c)
    if metric == "l2":
        slack = 2 * own + (16 + 4 * c.code.shape[1]) * _EPS * (square + scale * scale * size)  # the sums', also the exact one's
        low, high = np.maximum(0.0, rough - slack), rough + slack
        return rough, down(np.maximum(0.0, np.sqrt(low) - err) ** 2 * (1 - 8 * _EPS)), up((np.sqrt(high) + err) ** 2 * (1 + 8 * _EPS))
    radius = (own + norm * err) * (1 + 16 * _EPS) + 4 * _EPS
    return rough, down(rough - radius), up(rough + radius)


class Queries:
    """Many query vectors; each has the very figures that ``Query`` has, as products of integers are exact in any order."""

    def __init__(self, q: np.ndarray, metric: str):
        self.metric = metric
        q = np.ascontiguousarray(np.asarray(q, np.float32).astype(np.float64))
        n = max(1, q.shape[1])
        levels, slack = min(32767, (2**31 - 1) // (LEVELS * n)), 1 + 8 * n * _EPS
        largest = np.abs(q).max(axis=1, initial=0.0)[:, None]
        self.step = np.where(largest > 0, largest / levels, 1.0)
        self.a = half_away(q / self.step)
        self.norm = np.sqrt((q * q).sum(axis=1))[:, None] * slack
        self.square = sequential_sum(q * q)[:, None]
        rest = q - self.step * self.a
        self.lost = np.sqrt((rest * rest).sum(axis=1))[:, None] * slack + 4 * _EPS * self.norm

    def _inner(self, c: Codes, at: slice | np.ndarray) -> np.ndarray:
        return (self.a[at] @ c.code.astype(np.float64).T) * self.step[at] * c.scale.astype(np.float64)

    def rough(self, c: Codes, at: slice | np.ndarray) -> np.ndarray:
        """A row of rough ranks for each of some queries."""
        return _rough(self.metric, self._inner(c, at), self.square[at], c)

    def bounds(self, c: Codes, at: slice | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rough ranks, and lower and upper bounds of the exact ones, with a row for each of some queries."""
        return _bounds(self.metric, self._inner(c, at), self.square[at], self.norm[at], self.lost[at], c)

    def pairs(self, c: Codes, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rough ranks of pairs of a query and a code, and lower and upper bounds of the exact ones."""
        inner = np.zeros(len(i))
        for at in range(0, len(i), 1 << 16):
            own = slice(at, at + (1 << 16))
            inner[own] = np.einsum("pd,pd->p", self.a[i[own]], c.code[j[own]].astype(np.float64))
        own = Codes(c.code[:0], c.scale[j], c.norm_sq[j], c.err[j])
        return _bounds(self.metric, inner * self.step[i, 0] * own.scale.astype(np.float64), self.square[i, 0], self.norm[i, 0], self.lost[i, 0], own)
