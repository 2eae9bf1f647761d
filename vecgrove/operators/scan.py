"""All rows against a stated query set, without a row per pair.

The queries travel to the tasks in blocks; a task meets its rows in batches.  Products of matrices tell which pairs may count, and
exact values (the bits of ``distance.rank``) are worked out for these alone.  A task holds a block of queries, a batch of rows and
what is best so far, whatever the tables' size; the work still is rows times queries, but in multiplications of matrices.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.functions import distance
from vecgrove.functions.rabitq import Queries as CodeQueries
from vecgrove.functions.rabitq import encode

QUERY_BLOCK = 65536
BEST = 1 << 22
"""Queries of a block times the rows kept for each."""
TILE = 1 << 20
"""Pairs of a product of matrices."""
PAIRS = 1 << 16
"""Pairs whose exact values are worked out at a time."""
_U = 2.0**-53
RANKED = "qid {qid}, id {id}, rank double"


@dataclass
class Vectors:
    """Ids and vectors of a batch.  A vector that is null, holds a null or has another length is not ``known``."""

    ids: pa.Array
    x: np.ndarray
    known: np.ndarray
    plain: np.ndarray
    """Known and finite."""

    @staticmethod
    def of(ids: pa.Array, column: pa.Array, dimension: int | None = None) -> Vectors:
        ids, column = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (ids, column))
        lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        if dimension is None:
            dimension = int(np.bincount(lengths[lengths >= 0]).argmax()) if (lengths >= 0).any() else 0
        known = lengths == dimension
        x = np.zeros((len(column), dimension))
        values = column.filter(pa.array(known)).flatten()
        x[known] = values.to_numpy(zero_copy_only=False).reshape(-1, dimension)
        if values.null_count:
            holes = values.is_null().to_numpy(zero_copy_only=False).reshape(-1, dimension).any(axis=1)
            known[np.flatnonzero(known)[holes]] = False
        x[~known] = 0
        return Vectors(ids, x, known, known & np.isfinite(x).all(axis=1))

    @property
    def keys(self) -> np.ndarray:
        return keys_of(self.ids)


def keys_of(ids: pa.Array) -> np.ndarray:
    """Ids as numbers or, if they are none, as objects."""
    return ids.to_numpy() if pa.types.is_integer(ids.type) and not ids.null_count else np.array([*ids.to_pylist(), None], object)[:-1]


Worker = Callable[[Vectors, Iterator[Vectors]], Iterator[pa.RecordBatch]]


def scan(rows: DataFrame, queries: DataFrame, fields: str, work: Worker, held: int) -> DataFrame:
    """What ``work`` makes of each block of queries (qid, vector) and each task's rows (id, vector): columns ``fields``, of which qid and
    id are typed as they come.  ``held`` rows are kept for a query."""
    context = rows.sparkSession.sparkContext
    size = max(1, min(QUERY_BLOCK, BEST // held))
    blocks = -(-queries.count() // size) or 1
    # By number, else Spark would leave the rows in as few partitions as their bytes fill.
    spread = rows.select("id", "vector").repartition(2 * max(4, context.defaultParallelism), "id")
    schema = fields.format(qid=queries.schema["qid"].dataType.simpleString(), id=rows.schema["id"].dataType.simpleString())

    def of(block: int) -> DataFrame:
        own = queries.select("qid", "vector")
        own = (own.filter(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block) if blocks > 1 else own).toArrow()
        shared = context.broadcast((own["qid"].combine_chunks(), own["vector"].combine_chunks()))

        def run(batches):
            q = Vectors.of(*shared.value)
            yield from work(q, _batches(batches, q.x.shape[1]))

        return spread.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [of(b) for b in range(blocks)])


def _batches(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[Vectors]:
    for batch in batches:
        for at in range(0, len(batch), 8192):
            piece = batch.slice(at, 8192)
            yield Vectors.of(piece.column("id"), piece.column("vector"), dimension)


def tiles(queries: int, rows: int) -> Iterator[slice]:
    step = max(1, TILE // max(1, rows))
    return (slice(at, min(queries, at + step)) for at in range(0, queries, step))


class Best:
    """The ``k`` least (value, id) of each query so far; a value may be null, which comes last."""

    def __init__(self, queries: int, k: int):
        self.k, self.bound = k, np.full(queries, np.inf)
        self.q, self.value, self.null, self.keys = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool), None
        self._new: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self._n = 0

    def add(self, q: np.ndarray, value: np.ndarray, keys: np.ndarray, null: np.ndarray | None = None) -> None:
        if len(q):
            self._new.append((q, value, np.zeros(len(q), bool) if null is None else null, keys))
            self._n += len(q)
            if self._n >= 1 << 20:
                self.settle()

    def settle(self) -> None:
        """Keeps the best, and takes over the bounds that they give."""
        if not self._new:
            return
        old = [(self.q, self.value, self.null, self.keys)] if self.keys is not None else []
        q, value, null, keys = (np.concatenate(c) for c in zip(*old, *self._new, strict=True))
        self._new, self._n = [], 0
        order = np.lexsort((pd.factorize(keys, sort=True)[0] if keys.dtype == object else keys, value, null, q))
        first = np.flatnonzero(np.diff(q[order], prepend=-1))
        position = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept = order[position < self.k]
        self.q, self.value, self.null, self.keys = q[kept], value[kept], null[kept], keys[kept]
        last = order[position == self.k - 1]
        self.bound[q[last]] = np.where(null[last] | np.isnan(value[last]), np.inf, value[last])


def near(best: Best, at: slice, rough: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of the pairs of a tile that may be among the best, from values that are ``slack`` off per query at most."""
    bound = best.bound[at] + slack
    may = rough <= bound[:, None]
    if rough.shape[1] > best.k and np.count_nonzero(may) > 8 * best.k * len(bound):
        kth = np.partition(rough, best.k - 1, axis=1)[:, best.k - 1]
        may = rough <= np.minimum(bound, kth + 2 * slack)[:, None]
    q, x = np.nonzero(may)
    return q + at.start, x


def _ids(keys: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(keys.tolist() if keys.dtype == object else keys, kind)


def _written(q: Vectors, best: Best, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    best.settle()
    for at in range(0, len(best.q), 1 << 16):
        own = slice(at, at + (1 << 16))
        yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(best.q[own])), _ids(best.keys[own], key_type), pa.array(best.value[own], mask=best.null[own])], ["qid", "id", "rank"])


class Exact:
    """Ranks of pairs: rough ones of a tile, and the bits that ``distance.rank`` gives."""

    def __init__(self, metric: str, q: np.ndarray):
        self.metric, self.q, self.size = metric, q, np.sqrt(distance.sequential_sum(q * q) + 0.0)

    def of_rows(self, x: np.ndarray) -> None:
        with np.errstate(over="ignore", invalid="ignore"):
            self.x, self.x_size = x, np.sqrt(distance.sequential_sum(x * x) + 0.0)

    def rough(self, at: slice, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q, x, size, x_size = self.q[at], self.x[rows], self.size[at], self.x_size[rows]
        if self.metric == "cosine":
            q, x = q / size[:, None], x / x_size[:, None]
        out, unit = q @ x.T, (q.shape[1] + 8) * _U
        if self.metric == "l2":
            out *= -2
            out += (size * size)[:, None]
            out += x_size * x_size
            return out, 8 * unit * (size * size + (x_size * x_size).max(initial=0))
        if self.metric == "cosine":
            return np.subtract(1, out, out=out), np.full(len(q), 8 * unit)
        return np.negative(out, out=out), 4 * unit * size * x_size.max(initial=0)

    def pairs(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(q))
        with np.errstate(over="ignore", invalid="ignore"):
            for at in range(0, len(q), PAIRS):
                i, j = q[at : at + PAIRS], x[at : at + PAIRS]
                a, b = self.q[i], self.x[j]
                if self.metric == "l2":
                    a -= b
                    a *= a
                    rank = distance.sequential_sum(a) + 0.0
                else:
                    a *= b
                    rank = distance.sequential_sum(a) + 0.0
                    if self.metric == "cosine":
                        sizes = self.size[i] * self.x_size[j]
                        if (sizes == 0).any():
                            raise ValueError("zero vector under cosine")
                        rank = 1.0 - rank / sizes
                    else:
                        rank = -rank
                out[at : at + PAIRS] = rank
        return out


def nearest(rows: DataFrame, queries: DataFrame, metric: str, k: int) -> DataFrame:
    """qid, id and rank of the k nearest rows of each task's share (id, vector) for each query (qid, vector)."""

    def work(q: Vectors, batches: Iterator[Vectors]) -> Iterator[pa.RecordBatch]:
        best, exact, key_type = Best(len(q.ids), k), Exact(metric, q.x), None
        plain, odd, unknown = np.flatnonzero(q.plain), np.flatnonzero(q.known & ~q.plain), np.flatnonzero(~q.known)
        own = Exact(metric, q.x[plain])
        if metric == "cosine" and (exact.size[q.known] == 0).any():
            raise ValueError("zero vector under cosine")
        for r in batches:
            key_type, keys = r.ids.type, r.keys
            exact.of_rows(r.x)
            own.x, own.x_size = exact.x, exact.x_size
            good, bad, none = np.flatnonzero(r.plain), np.flatnonzero(r.known & ~r.plain), np.flatnonzero(~r.known)
            if metric == "cosine" and (exact.x_size[good] == 0).any():
                raise ValueError("zero vector under cosine")
            view = _Part(best, plain)
            for at in tiles(len(plain), len(good)) if len(good) else ():
                i, j = near(view, at, *own.rough(at, good))
                i, j = plain[i], good[j]
                best.add(i, exact.pairs(i, j), keys[j])
            best.settle()
            # Infinities, NaNs and nulls are rare: pairs with them are worked out one by one.
            for some, others in ((plain, bad), (odd, np.concatenate([good, bad]))):
                for at in tiles(len(some), len(others)) if len(others) else ():
                    i, j = np.repeat(some[at], len(others)), np.tile(others, at.stop - at.start)
                    best.add(i, exact.pairs(i, j), keys[j])
            for some, others in ((q.known.nonzero()[0], none), (unknown, np.arange(len(keys)))):
                for at in tiles(len(some), len(others)) if len(others) else ():
                    i, j = np.repeat(some[at], len(others)), np.tile(others, at.stop - at.start)
                    best.add(i, np.zeros(len(i)), keys[j], np.ones(len(i), bool))
        if key_type is not None:
            yield from _written(q, best, key_type)

    return scan(rows, queries, RANKED, work, k)


@dataclass
class _Part:
    """The bounds of some queries."""

    best: Best
    own: np.ndarray

    @property
    def k(self) -> int:
        return self.best.k

    @property
    def bound(self) -> np.ndarray:
        return self.best.bound[self.own]


def roughly_nearest(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, id and rank (the rough squared L2 of codes) of the k best of each task's share."""

    def work(q: Vectors, batches: Iterator[Vectors]) -> Iterator[pa.RecordBatch]:
        coded, best, key_type = CodeQueries(_whole(q).x, "l2"), Best(len(q.ids), k), None
        for r in batches:
            key_type, keys, codes = r.ids.type, r.keys, encode(_whole(r).x)
            for at in tiles(len(q.ids), len(keys)):
                rough = coded.rough(codes, at)
                i, j = near(best, at, rough, np.zeros(len(rough)))
                best.add(i, rough[i - at.start, j], keys[j])
            best.settle()
        if key_type is not None:
            yield from _written(q, best, key_type)

    return scan(rows, queries, RANKED, work, k)


def _whole(r: Vectors) -> Vectors:
    if not r.known.all():
        raise ValueError("a vector that is null or of another length has no code")
    return r


def inside(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """pairs and inside: how many pairs there are, and of how many the interval of the code holds the exact squared L2."""

    def work(q: Vectors, batches: Iterator[Vectors]) -> Iterator[pa.RecordBatch]:
        coded, exact, pairs, held = CodeQueries(_whole(q).x, "l2"), Exact("l2", q.x), 0, 0
        for r in batches:
            codes, every = encode(_whole(r).x), np.arange(len(r.ids))
            exact.of_rows(r.x)
            for at in tiles(len(q.ids), len(every)):
                _, low, high = coded.bounds(codes, at)
                guess, slack = exact.rough(at, every)
                sure = (low <= guess - slack[:, None]) & (guess + slack[:, None] <= high)
                i, j = np.nonzero(~sure)
                rank = exact.pairs(i + at.start, j)
                pairs += sure.size
                held += sure.size - len(i) + int(((low[i, j] <= rank) & (rank <= high[i, j])).sum())
        yield pa.RecordBatch.from_arrays([pa.array([pairs]), pa.array([held])], ["pairs", "inside"])

    return scan(rows, queries, "pairs long, inside long", work, 1).agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.coalesce(F.sum("inside"), F.lit(0)).alias("inside"))


HELD = 1 << 20
"""Pairs that a task holds before it hands them on."""


def not_excluded(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, id, lower, upper and exact squared L2 of the pairs that the k-th least upper bound of each task's share doesn't exclude by their lower bound."""

    def work(q: Vectors, batches: Iterator[Vectors]) -> Iterator[pa.RecordBatch]:
        coded, exact, best, left = CodeQueries(_whole(q).x, "l2"), Exact("l2", q.x), Best(len(q.ids), k), []

        def written(key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            i, keys, low, high, rank = (np.concatenate(c) for c in zip(*left, strict=True))
            stay = low <= best.bound[i]
            left[:] = [(i[stay], keys[stay], low[stay], high[stay], rank[stay])]
            i, keys, *numbers = left[0]
            for a in range(0, len(i), 1 << 16):
                own = slice(a, a + (1 << 16))
                yield pa.RecordBatch.from_arrays([q.ids.take(pa.array(i[own])), _ids(keys[own], key_type), *[pa.array(n[own]) for n in numbers]], ["qid", "id", "lower", "upper", "exact"])
            left.clear()

        key_type, n = None, 0
        for r in batches:
            key_type, keys, codes = r.ids.type, r.keys, encode(_whole(r).x)
            exact.of_rows(r.x)
            for at in tiles(len(q.ids), len(keys)):
                _, low, high = coded.bounds(codes, at)
                cut = best.bound[at]
                if len(keys) > k:
                    cut = np.minimum(cut, np.partition(high, k - 1, axis=1)[:, k - 1])
                i, j = np.nonzero(low <= cut[:, None])
                left.append((i + at.start, keys[j], low[i, j], high[i, j], exact.pairs(i + at.start, j)))
                best.add(i + at.start, high[i, j], keys[j])
                n += len(i)
                if n >= HELD:
                    best.settle()
                    yield from written(key_type)
                    n = 0
            best.settle()
        if left:
            yield from written(key_type)

    return scan(rows, queries, "qid {qid}, id {id}, lower double, upper double, exact double", work, k)
