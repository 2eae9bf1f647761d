"""Words of UTF-8 text as numpy arrays, straight from Arrow buffers.

All word classes used here are unions of ASCII ranges and everything above ASCII, so a byte decides by
itself whether it belongs to a word and no text has to become a Python string.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.ones(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = False
"""Words are runs of anything but ASCII white space."""

ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
"""Words are runs of digits, lower-case ASCII letters and anything above ASCII."""

_BASE = np.uint64(0x9E3779B97F4A7C15)
_PIECE = 1 << 20
_TABLE = np.random.default_rng(20240607).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def field(rows: pa.Array, name: str) -> pa.Array:
    """One column of packed rows."""
    return pc.struct_field(rows, [rows.type.get_field_index(name)])


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, and the offsets of each (null: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    n = len(texts)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64, n + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(texts: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole texts of about ``most`` bytes, so that memory stays bounded."""
    try:
        yield from _pieces(texts, most)
    finally:
        release()


def release() -> None:
    """Hands freed memory back: workers live on between tasks and share a machine with the executor's heap."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def _pieces(texts: pa.Array, most: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, offsets = buffers(texts)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1))
        yield i, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def words(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``data``, and each text's first word as offsets into them.

    With ``classes`` a word also ends between two bytes of different classes, neither of them zero.
    """
    inside = kind[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    if classes is not None:
        of = classes[data]
        cut[1:-1] |= (of[1:] != of[:-1]) & (of[1:] != 0) & (of[:-1] != 0)
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span; spans are in order and don't overlap."""
    return prefix_hashes(data, starts, ends, [ends])[0]


def prefix_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stops: list[np.ndarray]) -> list[np.ndarray]:
    """Hashes of the parts of each span that end at each of ``stops``.

    The sum of byte values times powers of an odd base, taken as the difference of prefix sums; the work is done
    in pieces that end between spans.
    """
    out = [np.zeros(len(starts), np.uint64) for _ in stops]
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _PIECE, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        powers, inverse = _powers(b - a)
        prefix = np.zeros(b - a + 1, np.uint64)
        np.cumsum(_TABLE[data[a:b]] * powers[: b - a], out=prefix[1:])
        s = starts[i:j] - a
        back = inverse[s]
        for one, stop in zip(out, stops, strict=True):
            e = stop[i:j] - a
            one[i:j] = mix((prefix[e] - prefix[s]) * back + (e - s).astype(np.uint64))
        i = j
    return out


_cache: tuple[np.ndarray, np.ndarray] | None = None


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _cache
    if _cache is None or len(_cache[0]) < n:
        n = max(n, _PIECE)
        up = np.full(n, _BASE, np.uint64)
        down = np.full(n, np.uint64(pow(int(_BASE), -1, 2**64)), np.uint64)
        up[0] = down[0] = 1
        made = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if n > _PIECE:  # only a word longer than a piece needs more
            return made
        _cache = made
    return _cache


def owner(first: np.ndarray) -> np.ndarray:
    """The text of each word, from words()' third result."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def windows(h: np.ndarray, n: int, multiplier: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """A hash of each run of ``n`` consecutive hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(multiplier) + h[k : k + m]
    return mix(out)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values in a sorted array."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return at, np.diff(np.append(at, len(values)))
