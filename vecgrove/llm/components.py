"""Connected components of an edge table by alternating large and small stars.

Each task first turns what it reads, a bounded number of edges at a time, into stars.  As soon as what is left is no more
than a task may hold (``EDGES``), one task finishes it.  Before that, every node is linked to the least node it
knows of; the rounds needed grow with the logarithm of the component size.  Each round is written to the shared folder, so lineage stays short and a lost executor costs one round.  Joins
on a node that holds many edges (the centre of a star) don't meet in one task (``spread_join``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm.common import materialise, spread_join


EDGES = 1 << 20
"""Edges that a task holds at a time."""


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of each node's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            break
    return label


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def settle() -> pa.RecordBatch:
        nodes, at = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        label = least_labels(len(nodes), *at.reshape(2, -1))
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[label[linked]])], ["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b")]))
        if sum(x.shape[1] for x in held) >= EDGES:
            yield settle()
            held = []
    if held:
        yield settle()


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each child (a) of a parent (b) goes to the least node that the parent knows of; edges go down from a to b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "b")
    # A parent that is no child knows none less than itself.
    return spread_join(edges, least, "b", "left", n).select("a", F.coalesce("m", "b").alias("b"))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """All parents of a child, and the child, go to its least parent."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = spread_join(edges, least, "a", total=n)
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, most: int = EDGES) -> DataFrame:
    """(node, root) for each node of ``edges`` (columns a, b; undirected) but the roots themselves."""
    now = materialise(edges.filter("a <> b").mapInArrow(_stars, "a long, b long").distinct(), "edges")
    state = _state(now)
    while state[0] > most:
        now = materialise(_small_star(materialise(_large_star(now, state[0]), "edges"), state[0]), "edges")
        before, state = state, _state(now)
        if before == state:
            break
    else:
        now = materialise(now.coalesce(1).mapInArrow(_stars, "a long, b long"), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _state(edges: DataFrame) -> tuple:
    """Count and an order-free sum over all edges: it stays the same only when no edge changes."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)
