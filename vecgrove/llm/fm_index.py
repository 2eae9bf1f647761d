"""A word-level FM-index: BWT in a wavelet matrix, backward search, and positions by sampled suffixes."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling.  Zeros end runs; each sorts by its place, so no comparison crosses one.

    A suffix has the first place of its group of equals as its rank; each round sorts only what is still in a group.
    """
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    key = text + len(zeros)
    key[zeros] = np.arange(len(zeros))
    order = np.argsort(key, kind="stable")
    rank, slots, step = np.empty(n, np.int64), np.arange(n), 0
    ordered = key[order]
    while True:
        # ``ordered`` has the sorted keys of the suffixes in ``slots``.
        new = np.ones(len(slots), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        start = np.flatnonzero(new)
        rank[order[slots]] = np.repeat(slots[start], np.diff(np.append(start, len(slots))))
        alone = new & np.append(new[1:], True)
        slots = slots[~alone]
        step = max(1, 2 * step)
        if not len(slots) or step >= n:
            return order
        own = order[slots]
        later = np.where(own + step < n, rank[np.minimum(own + step, n - 1)] + 1, 0)
        key = rank[own] * (n + 1) + later
        by = np.argsort(key, kind="stable")
        order[slots] = own[by]
        ordered = key[by]


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.zeros, self.ones = bits, [], []
        left = symbols.astype(np.int32)
        for b in reversed(range(bits)):
            bit = (left >> b) & 1
            ones = np.zeros(len(bit) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(int(len(bit) - ones[-1]))
            high = bit.astype(bool)
            left = np.concatenate([left[~high], left[high]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before position ``i``, elementwise."""
        low, high = np.zeros_like(i), i
        for level in range(self.bits):
            bit = (symbol >> (self.bits - 1 - level)) & 1
            ones, zeros = self.ones[level], self.zeros[level]
            low = np.where(bit == 1, zeros + ones[low], low - ones[low])
            high = np.where(bit == 1, zeros + ones[high], high - ones[high])
        return high - low

    def access(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros_like(i)
        for level in range(self.bits):
            ones = self.ones[level]
            bit = ones[i + 1] - ones[i]
            symbol = (symbol << 1) | bit
            i = np.where(bit == 1, self.zeros[level] + ones[i], i - ones[i])
        return symbol


class FMIndex:
    """Over symbols 1..size in runs that zeros end; ``text`` must end with zero."""

    def __init__(self, text: np.ndarray, size: int, sample: int = 16):
        text = text.astype(np.int64)
        self.n = len(text)
        order = suffix_array(text)
        self.before = WaveletMatrix(text[order - 1], max(1, int(size).bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size + 1))])
        starts_run = np.concatenate([[True], text[:-1] == 0])[order] if self.n else np.zeros(0, bool)
        self.sampled = starts_run | (order % sample == 0)
        self.samples = order[self.sampled]
        self.slot = np.cumsum(self.sampled, dtype=np.int32) - 1

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) of suffixes that begin with each row of ``patterns`` (all of one length)."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[live, k]
            low[live] = self.first[symbol] + self.before.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.before.rank(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes given by their rows."""
        out, walked = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, rows = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled[rows[live]]
            at = live[done]
            out[at] = self.samples[self.slot[rows[at]]] + walked[at]
            live = live[~done]
            symbol = self.before.access(rows[live])
            rows[live] = self.first[symbol] + self.before.rank(symbol, rows[live])
            walked[live] += 1
        return out
