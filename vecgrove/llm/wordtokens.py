"""Sub-word ids of words, each distinct word encoded once per worker.

The vocabularies in use never join characters across ASCII white space, so the ids of a text are those of its parts
in order.  Known words are kept as sorted hashes with their ids, at most ``most`` of them, so a worker's memory is
bounded.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable

import numpy as np

from vecgrove.llm import spans


_alive: weakref.WeakSet[WordTokens] = weakref.WeakSet()


def forget() -> None:
    """Drops the known words of this worker, which lives on from one operator to the next."""
    for words in list(_alive):
        if words.used:
            words.clear()
            spans.release()


class WordTokens:
    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 2_000_000):
        """``encode`` gives the ids of all the words, one after the other, and how many each has."""
        self.encode, self.most = encode, most
        self.clear()
        _alive.add(self)

    def clear(self) -> None:
        self.known, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all the words in order, and how many each has."""
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ordered = np.sort(hashes)
        distinct = ordered[spans.runs(ordered)[0]]
        which = np.searchsorted(distinct, hashes)
        at, found = self._find(distinct)
        if not found.all():
            if len(self.known) + int((~found).sum()) > self.most:
                self.clear()
                found = np.zeros(len(distinct), bool)
            seen = np.zeros(len(distinct), np.int64)
            seen[which] = np.arange(len(hashes))
            self._learn(distinct[~found], data.tobytes(), starts[seen[~found]].tolist(), ends[seen[~found]].tolist())
            at, _ = self._find(distinct)
        first, sizes = self.first[at][which], self.size[at][which].astype(np.int64)
        stop = np.cumsum(sizes)
        return self.flat[np.repeat(first - (stop - sizes), sizes) + np.arange(stop[-1])].astype(np.uint32), sizes

    def _find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.known):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(self.known, wanted), len(self.known) - 1)
        return at, self.known[at] == wanted

    def _learn(self, new: np.ndarray, raw: bytes, starts: list[int], ends: list[int]) -> None:
        ids, sizes = self.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(starts, ends, strict=True)])
        if len(ids) and ids.max() >= 1 << 16 and self.flat.dtype == np.uint16:
            self.flat = self.flat.astype(np.uint32)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(self.used // 2, len(ids), 1 << 16), self.flat.dtype)])
        self.flat[self.used : self.used + len(ids)] = ids
        place = np.searchsorted(self.known, new)
        self.known = np.insert(self.known, place, new)
        self.first = np.insert(self.first, place, self.used + np.cumsum(sizes) - sizes)
        self.size = np.insert(self.size, place, sizes)
        self.used += len(ids)


def listed(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter((x for one in ids for x in one), np.uint32, int(sizes.sum())), sizes
