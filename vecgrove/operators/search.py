"""Batched approximate search: prune trees and leaves, rank codes, rerank exactly, report the work.

One plan serves a frame of queries (qid, vector).  The routing tables (one row per partition, checked against
a ceiling) travel to the tasks that route queries.  Routing and the candidate pool are written once, as several answers
come from them.  The leaves that a query visits travel as bits, and codes are ranked by products of matrices of a chunk of
neighbouring leaves and a block of queries: no row is made of a query and a leaf or of a query and an entry.  Of ``leaf_entries`` only the shards of visited leaves are read, and within these, where leaves are few,
only the row groups that may hold them; of ``records`` only the shards of the candidates left for reranking.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecgrove.config import IndexConfig, SearchOptions
from vecgrove.errors import IndexError_, require
from vecgrove.functions import distance
from vecgrove.functions.predicate import Predicate, classify, to_column, validate
from vecgrove.functions.rabitq import Codes, Queries
from vecgrove.operators import scan
from vecgrove.operators.build import CODE_FIELDS, kernel_of
from vecgrove.plans import treekeys
from vecgrove.plans.traverse import NO_BOUND, Topology, everything, traverse
from vecgrove.sources.scratch import keep
from vecgrove.sources.store import Snapshot


@dataclass
class Outcome:
    hits: DataFrame
    """qid, id, distance, position (from 1)."""
    usage: DataFrame
    """Per query: four counters and three exhaustion flags."""
    visited: DataFrame
    """qid, tree_id, leaf_id, leaf_class."""
    pool: DataFrame
    """qid, id, its leaf, rough, lower, upper of the kept candidates, survivor."""


CLASSES = ("NoMatch", "MayMatch", "AllMatch")
CHUNK = 32768
"""Entries of neighbouring leaves that a task compares with its queries at a time."""
QUERIES = 8192
"""Queries that a task compares with a chunk at most."""


class Leaves:
    """The leaves of the planned trees as arrays, in the order of their shards, with what their synopses say of the predicate.  A leaf's
    place in it is its number."""

    def __init__(self, snapshot: Snapshot, config: IndexConfig, predicate: Predicate | None, trees: list[int], working_bytes: int):
        kind = F.lit("AllMatch") if predicate is None else classify(predicate, config, F.col("entries"))
        rows = snapshot.table("synopses").select("tree_id", "leaf_id", "shard", "entries", kind.alias("leaf_class"))
        rows = rows.filter(F.col("tree_id").isin(trees)) if len(trees) <= 256 else rows
        require(rows.count() * 32 <= working_bytes, "leaf synopses", "LimitExceeded")
        pdf = rows.toPandas().sort_values(["shard", "tree_id", "leaf_id"], ignore_index=True)
        self.tree, self.leaf, self.shard, self.entries = (pdf[c].to_numpy(np.int64) for c in ("tree_id", "leaf_id", "shard", "entries"))
        self.kind = pdf["leaf_class"].map({c: i for i, c in enumerate(CLASSES)}).to_numpy(np.int8)
        self.number = dict(zip(zip(self.tree.tolist(), self.leaf.tolist(), strict=True), range(len(pdf)), strict=True))
        self.chunk = (np.cumsum(self.entries) - self.entries) // CHUNK

    def frame(self, spark, numbers: np.ndarray) -> DataFrame:
        own = pa.table({"tree_id": self.tree[numbers], "leaf_id": self.leaf[numbers], "number": numbers.astype(np.int64), "chunk": self.chunk[numbers], "leaf_class": np.array(CLASSES, object)[self.kind[numbers]].tolist()}, pa.schema([("tree_id", pa.int64()), ("leaf_id", pa.int64()), ("number", pa.int64()), ("chunk", pa.int64()), ("leaf_class", pa.string())]))
        return F.broadcast(spark.createDataFrame(own))


def eligible(entries: DataFrame, config: IndexConfig, predicate: Predicate | None) -> DataFrame:
    """Of entries with their leaf's class, those that pass: the predicate is only asked where the class leaves it open."""
    if predicate is None:
        return entries.filter("leaf_class <> 'NoMatch'")
    return entries.filter((F.col("leaf_class") == "AllMatch") | ((F.col("leaf_class") == "MayMatch") & F.coalesce(to_column(predicate, config), F.lit(False))))


FEW_LEAVES = 4096


def shards_in(rows: DataFrame) -> list[int]:
    """The shards that rows lie in: a number per shard_rows of the index at most."""
    return [r["shard"] for r in rows.select("shard").distinct().collect()]


def _in_leaves(snapshot: Snapshot, leaves: Leaves, numbers: np.ndarray) -> DataFrame:
    """The entries of some leaves with their numbers, read from their shards alone."""
    entries = snapshot.table("leaf_entries", np.unique(leaves.shard[numbers]).tolist()).drop("shard")
    if 0 < len(numbers) <= FEW_LEAVES:  # bounds that Parquet's row groups and pages are skipped by
        for c, values in (("tree_id", leaves.tree[numbers]), ("leaf_id", leaves.leaf[numbers])):
            own = np.unique(values).tolist()
            entries = entries.filter(F.col(c).isin(own) if len(own) <= 64 else F.col(c).between(own[0], own[-1]))
    return entries.join(leaves.frame(entries.sparkSession, numbers), ["tree_id", "leaf_id"])


def _matches(snapshot: Snapshot, config: IndexConfig, leaves: Leaves, predicate: Predicate) -> dict[tuple[int, int], int]:
    """Entries per leaf of the planned trees that pass.  Only leaves whose synopsis leaves it open are read."""
    out = np.where(leaves.kind == CLASSES.index("AllMatch"), leaves.entries, 0)
    some = np.flatnonzero(leaves.kind == CLASSES.index("MayMatch"))
    passing = eligible(_in_leaves(snapshot, leaves, some), config, predicate).groupBy("number").count().toPandas()
    out[passing["number"].to_numpy(np.int64)] = passing["count"]
    return {k: n for k, n in zip(leaves.number, out.tolist(), strict=True) if n}


def _packed(numbers: np.ndarray, n: int) -> bytes:
    bits = np.zeros(n, bool)
    bits[numbers] = True
    return np.packbits(bits).tobytes()


def _unpacked(bits: pa.Array, n: int) -> np.ndarray:
    """A row of n flags for each of some values that ``_packed`` made."""
    flat = np.frombuffer(b"".join(bits.to_pylist()), np.uint8).reshape(len(bits), -1)
    return np.unpackbits(flat, axis=1, count=n).astype(bool) if len(bits) else np.zeros((0, n), bool)


def search(snapshot: Snapshot, config: IndexConfig, queries: DataFrame, predicate: Predicate | None = None, options: SearchOptions = SearchOptions()) -> Outcome:
    predicate = validate(predicate, config) if predicate is not None else None
    kernel = kernel_of(config)
    trees, scanned = treekeys.enumerate_trees(snapshot.table("trees"), predicate, config, options.tree_keys)
    order = {r["tree_id"]: r["tree_rank"] for r in trees.select("tree_id", "tree_rank").collect()}
    planned = sorted(order, key=order.get)
    topology = Topology.load(snapshot.table("partitions").filter(F.col("tree_id").isin(list(order))) if len(order) <= 256 else snapshot.table("partitions"), config.dimension, options.working_bytes)
    ef = 0
    if options.routing == "hnsw":
        require(config.hnsw is not None, "no graph")
        topology.build_graphs(kernel, *config.hnsw, context=queries.sparkSession.sparkContext)
        ef = options.ef
    leaves = Leaves(snapshot, config, predicate, list(order), options.working_bytes)
    matches = _matches(snapshot, config, leaves, predicate) if predicate is not None and options.routing == "exact" else None
    beam, budget = options.leaf_beam or NO_BOUND, options.partitions or NO_BOUND
    every = None if ef else everything(topology, planned, beam, budget, matches)
    context, spark = queries.sparkSession.sparkContext, queries.sparkSession
    tasks = 2 * max(4, context.defaultParallelism)
    shared = context.broadcast((topology if every is None else None, matches, order, leaves, every))
    id_type, key_type = queries.schema["qid"].dataType.simpleString(), snapshot.table("leaf_entries", []).schema["id"].dataType.simpleString()

    def route(batches):
        topology, matches, order, leaves, every = shared.value

        def packed(v):
            own = np.array([leaves.number[x] for x in v.leaves if x in leaves.number], np.int64)
            cuts = np.searchsorted(leaves.chunk, np.arange(leaves.chunk.max(initial=-1) + 2))
            some = [(c, _packed(own[(own >= cuts[c]) & (own < cuts[c + 1])] - cuts[c], cuts[c + 1] - cuts[c])) for c in np.unique(leaves.chunk[own]).tolist()]
            return [c for c, _ in some], [b for _, b in some], int(leaves.entries[own][leaves.kind[own] > 0].sum())

        whole = packed(every) if every is not None else None
        for pdf in batches:
            rows = []
            vectors = kernel.prepare(np.stack(pdf["vector"].to_numpy())) if len(pdf) else []
            for qid, q in zip(pdf["qid"], vectors, strict=True):
                v = every or traverse(topology, kernel, q, planned, beam, budget, matches, order, ef)
                rows.append((qid, q.tolist(), *(whole or packed(v)), v.partitions, v.exhausted, v.walks))
            yield pd.DataFrame(rows, columns=["qid", "prepared", "chunks", "bits", "visited_leaf_entries", "visited_partitions", "partitions_exhausted", "graph_walks"])

    spread = queries.select("qid", "vector").repartition(tasks, "qid")
    routed = spread.mapInPandas(route, f"qid {id_type}, prepared array<float>, chunks array<long>, bits array<binary>, visited_leaf_entries long, visited_partitions long, partitions_exhausted boolean, graph_walks long")
    routed = keep(routed, "routed")
    parts = routed.select("qid", "prepared", F.explode(F.arrays_zip("chunks", "bits")).alias("p")).select("qid", "prepared", F.col("p.chunks").alias("chunk"), F.col("p.bits").alias("bits"))
    open_leaves = _visited_numbers(parts, leaves, shared)
    pool = keep(_pool(parts, snapshot, config, leaves, open_leaves, predicate, options, routed.count(), tasks, shared, id_type, key_type), "pool")
    if not pool.groupBy("qid", "id").count().filter("count > 1").isEmpty():
        raise IndexError_("Corruption", None, "an id in two visited leaves")
    survivors = pool.filter("survivor")
    hits = rerank(survivors, queries, snapshot.table("records", shards_in(survivors)), config, options.k)
    left = pool.groupBy("qid").agg(F.sum(F.col("survivor").cast("long")).alias("exact_rerank_candidates"), F.max("eligible").alias("eligible"))
    usage = routed.select("qid", "visited_leaf_entries", "visited_partitions", "partitions_exhausted", "graph_walks").join(left, "qid", "left")
    usage = usage.withColumn("one", F.lit(1)).join(scanned.withColumn("one", F.lit(1)), "one")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    report = usage.select(
        "qid", none("scanned_tree_keys"), none("visited_partitions"), none("visited_leaf_entries"), none("exact_rerank_candidates"), "graph_walks",
        "tree_keys_exhausted", "partitions_exhausted", (F.coalesce("eligible", F.lit(0)) > options.pool).alias("rerank_exhausted"),
    )

    def told(batches):
        leaves = shared.value[3]
        for batch in batches:
            for own, number in _by_chunk(batch, leaves):
                yield pa.RecordBatch.from_arrays([own, pa.array(leaves.tree[number]), pa.array(leaves.leaf[number]), pa.array(np.array(CLASSES, object)[leaves.kind[number]].tolist(), pa.string())], ["qid", "tree_id", "leaf_id", "leaf_class"])

    visited = parts.select("qid", "chunk", "bits").mapInArrow(told, f"qid {id_type}, tree_id long, leaf_id long, leaf_class string")
    return Outcome(hits, report, visited, pool.drop("eligible"))


def _by_chunk(batch: pa.RecordBatch, leaves: Leaves):
    """(qid, number of a visited leaf) of rows of qid, chunk and bits, in pieces."""
    chunk = batch.column("chunk").to_numpy()
    for c in np.unique(chunk).tolist():
        first, end = np.searchsorted(leaves.chunk, [c, c + 1])
        rows = np.flatnonzero(chunk == c)
        for at in range(0, len(rows), 256):
            own = pa.array(rows[at : at + 256])
            i, number = np.nonzero(_unpacked(batch.column("bits").take(own), end - first))
            yield batch.column("qid").take(own).take(pa.array(i)), number + first


def _visited_numbers(parts: DataFrame, leaves: Leaves, shared) -> np.ndarray:
    """The numbers of the leaves that any query visits and that may have a match."""

    def run(batches):
        leaves, found = shared.value[3], {}
        for batch in batches:
            for c, b in zip(batch.column("chunk").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                own = np.frombuffer(b, np.uint8)
                found[c] = found[c] | own if c in found else own
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([b.tobytes() for b in found.values()], pa.binary())], ["chunk", "bits"])

    out = np.zeros(len(leaves.chunk), bool)
    for r in parts.select("chunk", "bits").mapInArrow(run, "chunk long, bits binary").collect():
        first, end = np.searchsorted(leaves.chunk, [r["chunk"], r["chunk"] + 1])
        out[first:end] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=end - first).astype(bool)
    return np.flatnonzero(out & (leaves.kind > 0))


def _pool(parts: DataFrame, snapshot: Snapshot, config: IndexConfig, leaves: Leaves, numbers: np.ndarray, predicate: Predicate | None, options: SearchOptions, queries: int, tasks: int, shared, id_type: str, key_type: str) -> DataFrame:
    """The best candidates of each query by rough rank.  A task compares a chunk's entries with a block of queries and hands on the best it has."""
    metric, size, k = config.metric, options.pool, options.k
    chunks = max(1, len(np.unique(leaves.chunk[numbers])))
    blocks = max(-(-queries // QUERIES), min(-(-queries // 64), -(-tasks // chunks)), 1)
    entries = eligible(_in_leaves(snapshot, leaves, numbers), config, predicate).select("chunk", "number", "id", *CODE_FIELDS)
    entries = entries.withColumn("block", F.explode(F.array(*[F.lit(b) for b in range(blocks)]))).repartition(tasks, "chunk", "block")
    asked = parts.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")).repartition(tasks, "chunk", "block")

    def run(entries: pa.Table, asked: pa.Table) -> pa.Table:
        leaves = shared.value[3]
        names = ["qid", "id", "tree_id", "leaf_id", "shard", "rough", "lower", "upper", "seen"]
        if not len(entries) or not len(asked):
            entries, asked = entries.slice(0, 0), asked.slice(0, 0)
        number = entries["number"].to_numpy()
        first, end = np.searchsorted(leaves.chunk, [asked["chunk"][0].as_py(), asked["chunk"][0].as_py() + 1]) if len(asked) else (0, 0)
        code = np.frombuffer(b"".join(entries["code"].to_pylist()), np.int8).reshape(len(entries), -1)
        codes = Codes(code, *(entries[c].to_numpy() for c in CODE_FIELDS[1:]))
        flags, prepared = _unpacked(asked["bits"], end - first), scan.Vectors.of(asked["qid"], asked["prepared"], code.shape[1])
        coded, best, seen = Queries(prepared.x, metric), scan.Best(len(asked), size), np.zeros(len(asked), np.int64)
        # Ids in order are as good as the ids among ties.
        keys = scan.keys_of(entries["id"].combine_chunks())
        by_id = np.argsort(keys, kind="stable")
        place = np.empty(len(by_id), np.int64)
        place[by_id] = np.arange(len(by_id))
        held = np.bincount(number - first, minlength=end - first)
        work = flags.astype(np.float64) @ held
        if work.sum() * 8 > flags.shape[0] * len(entries):
            for at in scan.tiles(len(asked), len(entries)):
                rough, own = coded.rough(codes, at), flags[at][:, number - first]
                rough[~own] = np.inf
                i, j = scan.near(best, at, rough, np.zeros(len(rough)))
                stay = own[i - at.start, j]
                i, j = i[stay], j[stay]
                seen[at] = own.sum(axis=1)
                best.add(i, rough[i - at.start, j], place[j])
        else:
            by_leaf = np.argsort(number, kind="stable")
            start = np.cumsum(held) - held
            qs, ls = np.nonzero(flags)
            n = held[ls]
            for own in np.split(np.arange(len(qs)), np.flatnonzero(np.diff(np.cumsum(n) // scan.TILE)) + 1):
                i = np.repeat(qs[own], n[own])
                j = by_leaf[np.repeat(start[ls[own]] - np.cumsum(n[own]) + n[own], n[own]) + np.arange(n[own].sum())]
                best.add(i, coded.pairs(codes, i, j)[0], place[j])
                seen += np.bincount(i, minlength=len(seen))
        best.settle()
        i, j = best.q, by_id[best.keys] if best.keys is not None else np.zeros(0, np.int64)
        rough, low, high = coded.pairs(codes, i, j)
        number, once = number[j], np.diff(i, prepend=-1) != 0
        columns = [asked["qid"].take(pa.array(i)), entries["id"].take(pa.array(j)), *(pa.array(x[number]) for x in (leaves.tree, leaves.leaf)), pa.array(leaves.shard[number].astype(np.int32)), pa.array(rough), pa.array(low), pa.array(high), pa.array(np.where(once, seen[i], 0))]
        return pa.table(columns, names)

    rough = entries.groupBy("chunk", "block").cogroup(asked.groupBy("chunk", "block")).applyInArrow(run, f"qid {id_type}, id {key_type}, tree_id long, leaf_id long, shard int, rough double, lower double, upper double, seen long")
    all_of = Window.partitionBy("qid")
    kept = rough.withColumn("rough_rank", F.row_number().over(all_of.orderBy("rough", "id"))).withColumn("eligible", F.sum("seen").over(all_of)).filter(F.col("rough_rank") <= size)
    ranked = kept.withColumn("upper_rank", F.row_number().over(all_of.orderBy("upper", "id")))
    cut = F.max(F.when(F.col("upper_rank") == k, F.col("upper"))).over(all_of)
    survivor = F.col("cut").isNull() | (F.col("lower") <= F.col("cut"))
    return ranked.withColumn("cut", cut).withColumn("survivor", survivor).select("qid", "id", "tree_id", "leaf_id", "shard", "rough", "lower", "upper", "survivor", "eligible")


def rerank(survivors: DataFrame, queries: DataFrame, records: DataFrame, config: IndexConfig, k: int) -> DataFrame:
    """Exact distances of candidates; ties in distance go to the smaller id.  A candidate has to have its record in its leaf."""
    key = ["id", "tree_id", "leaf_id"]
    found = survivors.select("qid", *key).join(records.select(*key, F.col("vector").alias("x")), key, "left")
    found = found.withColumn("x", F.when(F.col("x").isNull(), F.raise_error(F.lit("a leaf entry without its record")).cast("array<float>")).otherwise(F.col("x")))
    joined = found.join(queries.select("qid", F.col("vector").alias("q")), "qid")
    ranked = joined.select("qid", "id", distance.rank(config.metric, F.col("q"), F.col("x")).alias("rank"))
    return top_k(ranked, k).select("qid", "id", distance.exposed(config.metric, F.col("rank")).alias("distance"), "position")


def top_k(ranked: DataFrame, k: int, by: tuple[str, ...] = ("qid",)) -> DataFrame:
    """The k rows of the least (rank, id) per group; Spark prunes each partition's share before the shuffle."""
    return ranked.withColumn("position", F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last("rank"), "id"))).filter(F.col("position") <= k)


def exact_knn(records: DataFrame, queries: DataFrame, metric: str, k: int, predicate: Predicate | None = None, config: IndexConfig | None = None) -> DataFrame:
    """Brute force over all records: each task finds its share's k nearest of every stated query, and the k of these are the answer."""
    rows = records.filter(to_column(validate(predicate, config), config)) if predicate is not None else records
    return top_k(scan.nearest(rows, queries, metric, k), k).select("qid", "id", distance.exposed(metric, F.col("rank")).alias("distance"), "position")


def get(snapshot: Snapshot, ids: DataFrame, payload: bool = False) -> DataFrame:
    """Records in the order of ``ids`` (pos, id); a missing record has nulls.  payload_status tells not loaded,
    absent and present apart."""
    found = ids.select("pos", "id").join(snapshot.table("records").drop("tree_id", "leaf_id", "shard"), "id", "left")
    if not payload:
        return found.withColumn("payload_status", F.lit("NotLoaded")).orderBy("pos")
    with_payload = found.join(snapshot.table("payloads"), "id", "left") if snapshot.has("payloads") else found.withColumn("payload", F.lit(None).cast("binary"))
    return with_payload.withColumn("payload_status", F.when(F.col("payload").isNull(), "Absent").otherwise("Present")).orderBy("pos")
