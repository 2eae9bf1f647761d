"""SimHash near-dedup of whole documents at a stated similarity, through the same vantage-point trees.

A text is the set of its runs of ``width`` words (ASCII white space apart, A-Z in lower case; a shorter text is one
run).  Equal sets are one node.  A node's fingerprint has ``words`` words of 64 bits, each bit set where over half of the
set's hashes have it: bits of two sets of similarity s differ with probability arccos(2s / (1 + s)) / pi, 0.15 at 0.8.  A
pair is a candidate if it is within ``reach`` in one of the 15 groups of 21 or 22 bits, each of which has a vantage-point
tree, and within ``distance`` in all bits.  By that formula a pair of similarity 0.8 is a candidate
with probability 0.998.  Candidates count only if the similarity of their whole sets, as sorted 64-bit hashes, is at least
``similarity``.

Candidates make clusters, as connected components.  The sets of a cluster come together in blocks of about
``block_bytes``: every two blocks of a cluster meet in one task, so that all candidates of it are tested, nearest first, and
those that are connected already need no test.  A task yields the links that connect what it holds, never all pairs; a
cluster within one block, however many copies it stands for, is read once.

Defined results: rows are told apart by id and text, not by id alone.  Of each component the row of least id stays
(nulls last, then by a hash of id and text); of rows equal in id and text one stays; null and empty texts are copies
of each other; very long texts are held whole, one at a time; extra columns are kept, whatever their names; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import simhash_vptree, spans
from vecgrove.llm.common import materialise, spread_join
from vecgrove.llm.components import components
from vecgrove.llm.wordtokens import forget


@dataclass(frozen=True)
class Settings:
    width: int = 5
    similarity: float = 0.8
    prints: simhash_vptree.Settings = field(default_factory=lambda: simhash_vptree.Settings(words=5, reach=2, checked=5, distance=68, leaf=1 << 17))
    block_bytes: int = 8 << 20
    """Bytes of sets in a block of a cluster."""
    block_nodes: int = 4096
    """Sets in a block at most."""


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's distinct shingles, sorted, and each text's first one as offsets into them."""
    data = spans.lower(data)
    starts, ends, first = spans.words(data, offsets, spans.SPACE)
    word, counts = spans.hashes(data, starts, ends), np.diff(first)
    out, owner = [], []
    for n in range(1, width + 1):
        fits = counts == n if n < width else counts >= width
        if not fits.any():
            continue
        of = spans.owner(first)[: max(0, len(word) - n + 1)]
        at = np.flatnonzero(fits[of] & (np.arange(len(of)) + n <= first[1:][of]))
        out.append(spans.mix(spans.windows(word, n)[at] + np.uint64(n)))
        owner.append(of[at])
    h = np.concatenate(out) if out else np.zeros(0, np.uint64)
    o = np.concatenate(owner) if owner else np.zeros(0, np.int64)
    order = np.lexsort((h, o))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    return h, np.searchsorted(o, np.arange(len(offsets)))


def signatures(h: np.ndarray, first: np.ndarray, settings: Settings) -> tuple[np.ndarray, list[np.ndarray]]:
    """A hash of each set, and the words of its fingerprint."""
    n, count = len(first) - 1, np.diff(first)
    node = np.zeros(n, np.uint64)
    has = np.flatnonzero(count)
    if len(has):
        node[has] = spans.mix(np.add.reduceat(spans.mix(h), first[:-1][has]) + count[has].astype(np.uint64))
    salts = np.random.default_rng(settings.prints.seed).integers(1, 2**64, settings.prints.words, dtype=np.uint64)
    return node, [simhash_vptree.majority(spans.mix(h ^ salt), first[:-1], count) for salt in salts]


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string"))


def _signed(docs: DataFrame, id_col: str, text_col: str, settings: Settings) -> DataFrame:
    """key, id, node and the words of its fingerprint, one row per document."""
    narrow = docs.select(_key(id_col, text_col).alias("key"), F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = ["key", "id", "node", *[f"w{k}" for k in range(settings.prints.words)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for i, data, offsets in spans.pieces(batch.column("text")):
                node, words = signatures(*shingle_sets(data, offsets, settings.width), settings)
                made = [pa.array(x.view(np.int64)) for x in (node, *words)]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(i, len(node)), batch.column("id").slice(i, len(node)), *made], names)

    return narrow.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, settings: Settings) -> DataFrame:
    """node and its sorted set as bytes, of the nodes of ``wanted`` (key, node), each read from one row of that key."""
    narrow = docs.select(_key(id_col, text_col).alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    own = narrow.join(wanted, "key").select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in spans.pieces(batch.column("text")):
                h, first = shingle_sets(data, offsets, settings.width)
                packed = pa.array([h[a:b].tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(i, len(packed)), packed], ["node", "shingles"])

    # Rows equal in id and text have one key: their sets are equal too.
    return own.mapInArrow(run, "node long, shingles binary").groupBy("node").agg(F.first("shingles").alias("shingles"))


class Block:
    """Nodes of two blocks of a cluster with their fingerprints and sets."""

    def __init__(self, node: np.ndarray, side: np.ndarray, words: np.ndarray, sets: list[np.ndarray], settings: Settings):
        self.node, self.side, self.words, self.sets, self.settings = node, side, words, sets, settings
        self.size = np.array([len(x) for x in sets])

    def similar(self, i: int, j: int) -> bool:
        x, y = self.sets[i], self.sets[j]
        same = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return same >= self.settings.similarity * (len(x) + len(y) - same)

    def links(self) -> pa.RecordBatch:
        """Pairs of similar nodes whose components are those of all similar candidates; within a side only if there's one."""
        n, limit = len(self.node), self.settings.prints.distance
        found: list[np.ndarray] = []
        for i in range(n):
            other = np.flatnonzero(self.side[i + 1 :] != self.side[i] if self.side[-1] else np.ones(n - i - 1, bool)) + i + 1
            least, most = np.minimum(self.size[other], self.size[i]), np.maximum(self.size[other], self.size[i])
            other = other[least >= self.settings.similarity * most]
            far = np.bitwise_count(self.words[other] ^ self.words[i]).sum(axis=1)
            near = np.flatnonzero(far <= limit)
            found.append(np.stack([far[near], np.full(len(near), i), other[near]]))
        pairs = np.concatenate(found, axis=1)
        parent = list(range(n))

        def root(k: int) -> int:
            while parent[k] != k:
                parent[k] = parent[parent[k]]
                k = parent[k]
            return k

        kept = []
        for k in np.argsort(pairs[0], kind="stable").tolist():
            i, j = int(pairs[1, k]), int(pairs[2, k])
            x, y = root(i), root(j)
            if x != y and self.similar(i, j):
                parent[max(x, y)] = min(x, y)
                kept.append((i, j))
        at = np.array(kept, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(self.node[at[:, 0]]), pa.array(self.node[at[:, 1]])], ["a", "b"])


def verified(members: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between similar members (cluster, node, shingles, words) of each cluster."""
    words = [f"w{k}" for k in range(settings.prints.words)]
    size = F.octet_length("shingles").cast("long")
    sizes = materialise(members.groupBy("cluster").agg(F.greatest(F.ceil(F.sum(size) / settings.block_bytes), F.ceil(F.count("*") / settings.block_nodes)).cast("int").alias("blocks")), "blocks")
    own = spread_join(members, sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cluster", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "shingles", *words)
    met = met.select(F.xxhash64("cluster", "low", "high").alias("key"), (F.col("own") != F.col("low")).alias("side"), "node", "shingles", *words)
    ready = met.repartition("key").sortWithinPartitions("key", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def settle() -> pa.RecordBatch:
            node, side = (np.concatenate([h[c] for h in held]) for c in ("node", "side"))
            print_ = np.concatenate([np.stack([h[w] for w in words], axis=1) for h in held]).view(np.uint64)
            return Block(node, side, print_, [np.frombuffer(x.as_buffer(), np.uint64) for h in held for x in h["shingles"]], settings).links()

        for batch in batches:
            columns = {c: batch.column(c) if c == "shingles" else batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
            at, length = spans.runs(columns["key"])
            for a, n in zip(at.tolist(), length.tolist(), strict=True):
                if columns["key"][a] != key:
                    if held:
                        yield settle()
                    key, held = columns["key"][a], []
                held.append({c: v.slice(a, n) if c == "shingles" else v[a : a + n] for c, v in columns.items()})
        if held:
            yield settle()

    return ready.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """key (of id and text), id and root, a number of the row's component; one row per document."""
    signed = materialise(_signed(docs, id_col, text_col, settings), "signed")
    words = [f"w{k}" for k in range(settings.prints.words)]
    nodes = materialise(signed.groupBy("node").agg(F.min("key").alias("key"), *[F.first(w).alias(w) for w in words]), "nodes")
    clusters = components(simhash_vptree.links(nodes.select("node", *words), settings.prints))
    ends = materialise(clusters.select("node", F.col("root").alias("cluster")).union(clusters.select(F.col("root").alias("node"), "root").distinct()), "ends")
    wanted = nodes.join(ends, "node")
    sets = materialise(_sets(docs, id_col, text_col, wanted.select("key", "node"), settings).join(wanted.drop("key"), "node"), "sets")
    roots = components(verified(sets, settings))
    whole = materialise(nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root")), "roots")
    return spread_join(signed.select("key", "id", "node"), whole, "node").select("key", "id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Of each component one row stays, with all its columns."""
    found = materialise(near_copies(docs, id_col, text_col, settings), "copies")
    per_key = materialise(found.groupBy("root", "key").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("place"), F.count("*").alias("n")), "keys")
    best = materialise(per_key.groupBy("root").agg(F.min("place").alias("best")), "best")
    judged = spread_join(per_key, best, "root").select("key", F.when(F.col("key") == F.col("best.key"), "again").otherwise("gone").alias("why"), "n")
    out = materialise(judged.filter("why = 'gone' or n > 1").select(F.col("key").alias("other_key"), "why"), "gone")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(id_col, text_col).alias("row_key"))
    on = F.col("row_key") == F.col("other_key")
    single = keyed.join(out, on, "left_anti").select("row")
    again = keyed.join(out.filter("why = 'again'"), on, "left_semi").groupBy("row_key").agg(F.first("row").alias("row")).select("row")
    return single.unionByName(again).select("row.*")
