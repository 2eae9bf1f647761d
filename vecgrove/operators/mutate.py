"""Atomic batches of mutations: routing to leaves, conflicts, outcomes, and the next snapshot's tables.

A batch is a frame (pos, op, id, vector, fields, payload); op is insert, upsert or delete.  The ids of all records are
read to find where the batch's are; then only the shards that lose or get a record are rewritten, by anti-joins and unions.
Counts follow by aggregation, and synopses grow but never shrink.
"""

from __future__ import annotations

import numpy as np

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.config import IndexConfig
from vecgrove.errors import IndexError_, invalid
from vecgrove.operators.build import checked, coded, kernel_of, shard_of, synopses, tree_id_of
from vecgrove.plans.traverse import ROOT, Topology, beam_width
from vecgrove.sources.scratch import keep
from vecgrove.sources.store import Shards, Snapshot

OPS = ("insert", "upsert", "delete")


def check_batch(batch: DataFrame) -> None:
    """Refuses unknown operations and repeated ids, naming the first position at fault."""
    wrong = batch.filter(~F.col("op").isin(*OPS) | F.col("id").isNull()).agg(F.min("pos")).first()[0]
    if wrong is not None:
        raise invalid("operation", wrong)
    again = batch.groupBy("id").agg(F.count("*").alias("n"), F.max("pos").alias("pos")).filter("n > 1").agg(F.min("pos")).first()[0]
    if again is not None:
        raise invalid("duplicate id", again)


def conflicts(batch: DataFrame, records: DataFrame) -> DataFrame:
    """Inserts whose id exists."""
    return batch.filter("op = 'insert'").join(records.select("id"), "id", "left_semi").select("pos", "id")


def outcomes(batch: DataFrame, records: DataFrame) -> DataFrame:
    """pos, id and what each mutation does: Inserted, Created, Replaced, Deleted or Missing."""
    known = batch.select("pos", "op", "id").join(records.select("id", F.lit(True).alias("known")), "id", "left")
    said = F.when(F.col("op") == "insert", "Inserted").when(F.col("op") == "upsert", F.when(F.col("known"), "Replaced").otherwise("Created")).otherwise(F.when(F.col("known"), "Deleted").otherwise("Missing"))
    return known.select("pos", "id", said.alias("outcome"))


def route(rows: DataFrame, partitions: DataFrame, config: IndexConfig, ceiling: int = 256 << 20) -> DataFrame:
    """Adds the leaf that each row (tree_id, vector) goes to; a tree that doesn't exist yet has its root as leaf.

    Going down, the best write-beam partitions per level are followed; the nearest leaf wins, ties by key.
    """
    topology = Topology.load(partitions, config.dimension, ceiling)
    kernel = kernel_of(config)
    shared = rows.sparkSession.sparkContext.broadcast(topology)

    def leaf(tree: int, q: np.ndarray) -> int:
        topology = shared.value
        level = topology.level_of.get((tree, ROOT))
        if level is None or level == 1:
            return ROOT
        frontier = [(0.0, ROOT)]
        while level > 1:
            found = []
            for _, part in frontier:
                own = topology.children.get((tree, part))
                if own is not None:
                    found += zip(kernel.routing(q[None], own[1])[0].tolist(), own[0].tolist(), strict=True)
            level -= 1
            frontier = sorted(found)[: beam_width(config.write_beam, level)]
        return min(frontier)[1]

    def run(batches):
        for pdf in batches:
            x = kernel.prepare(np.stack(pdf["vector"].to_numpy())) if len(pdf) else []
            yield pdf.assign(leaf_id=np.array([leaf(t, q) for t, q in zip(pdf["tree_id"], x, strict=True)], np.int64))

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    return rows.mapInPandas(run, f"{fields}, leaf_id long")


def apply(snapshot: Snapshot, batch: DataFrame, config: IndexConfig) -> dict[str, DataFrame | Shards]:
    """The tables after the batch.  Raises on an insert of an existing id; the batch is then applied not at all."""
    check_batch(batch)
    records = snapshot.table("records")
    clash = conflicts(batch, records).agg(F.min("pos")).first()[0]
    if clash is not None:
        raise IndexError_("RecordAlreadyExists", clash)
    names = [f.name for f in config.fields]
    fresh = checked(batch.filter("op <> 'delete'").drop("pos", "op"), config).withColumn("tree_id", tree_id_of(config))
    known = snapshot.table("synopses").select("tree_id", "leaf_id", "shard")
    routed = route(fresh, snapshot.table("partitions"), config).join(known, ["tree_id", "leaf_id"], "left")
    routed = keep(routed.withColumn("shard", F.coalesce("shard", shard_of(snapshot.shards))), "routed")
    touched = batch.select("id")
    found = keep(records.select("id", "tree_id", "leaf_id", "shard").join(touched, "id", "left_semi"), "found")
    shards = sorted({r["shard"] for r in found.select("shard").union(routed.select("shard")).distinct().collect()})
    columns = ["id", "vector", *[f"`{n}`" for n in names], "tree_id", "leaf_id", "shard"]
    new_records = snapshot.table("records", shards).select(*columns).join(touched, "id", "left_anti").unionByName(routed.select(*columns))
    entries = snapshot.table("leaf_entries", shards)
    fresh_entries = coded(routed.select("shard", "tree_id", "leaf_id", "id", *[f"`{n}`" for n in names], "vector"), config)
    new_entries = entries.join(touched, "id", "left_anti").select(*fresh_entries.columns).unionByName(fresh_entries)
    gone = found.groupBy("tree_id", "leaf_id").agg((-F.count("*")).alias("change"), F.min("shard").alias("shard"))
    come = routed.groupBy("tree_id", "leaf_id").agg(F.count("*").alias("change"), F.min("shard").alias("shard"))
    change = keep(gone.unionByName(come).groupBy("tree_id", "leaf_id").agg(F.sum("change").alias("change"), F.min("shard").alias("shard")), "change")
    tables: dict[str, DataFrame | Shards] = {
        "records": Shards(new_records, shards),
        "leaf_entries": Shards(new_entries, shards),
        "partitions": _counted(snapshot.table("partitions"), change, config),
        "synopses": widened(snapshot.table("synopses"), routed, change, config),
    }
    tables["trees"] = _trees(snapshot.table("trees"), routed, config)
    payloads = _payloads(snapshot, batch)
    return tables | ({"payloads": payloads} if payloads is not None else {})


def _counted(partitions: DataFrame, change: DataFrame, config: IndexConfig) -> DataFrame:
    """Counts and epochs of changed leaves, and root leaves of new trees."""
    c = change.select("tree_id", F.col("leaf_id").alias("part_id"), "change")
    joined = partitions.join(c, ["tree_id", "part_id"], "full_outer")
    zero = F.array_repeat(F.lit(0.0).cast("float"), config.dimension)
    return joined.select(
        "tree_id", "part_id", "parent_id", F.coalesce("level", F.lit(1)).alias("level"),
        (F.coalesce("entry_count", F.lit(0)) + F.coalesce("change", F.lit(0))).cast("long").alias("entry_count"),
        (F.coalesce("epoch", F.lit(0)) + F.col("change").isNotNull().cast("int")).cast("long").alias("epoch"),
        F.coalesce("state", F.lit("Ready")).alias("state"), F.coalesce("centroid", zero).alias("centroid"), F.coalesce("dispersion", F.lit(0.0)).alias("dispersion"),
    )


def widened(old: DataFrame, fresh: DataFrame, change: DataFrame, config: IndexConfig) -> DataFrame:
    """Bounds of the old synopses and the new rows together; only the entry count may go down."""
    both = old.drop("entries").unionByName(synopses(fresh, config).drop("entries"))
    aggregates = [F.min("shard").alias("shard")]
    for f in config.fields:
        aggregates += [F.max(f"{f.name}_has_null").alias(f"{f.name}_has_null"), F.min(f"{f.name}_min").alias(f"{f.name}_min"), F.max(f"{f.name}_max").alias(f"{f.name}_max")]
        if f.bloom_bits:
            aggregates.append(F.array_sort(F.array_distinct(F.flatten(F.collect_list(f"{f.name}_bloom")))).alias(f"{f.name}_bloom"))
    grown = both.groupBy("tree_id", "leaf_id").agg(*aggregates)
    counts = old.select("tree_id", "leaf_id", "entries").unionByName(change.select("tree_id", "leaf_id", F.col("change").alias("entries"))).groupBy("tree_id", "leaf_id").agg(F.sum("entries").alias("entries"))
    return grown.join(counts, ["tree_id", "leaf_id"]).select(*old.columns)


def _trees(trees: DataFrame, fresh: DataFrame, config: IndexConfig) -> DataFrame:
    new = fresh.groupBy("tree_id").agg(*[F.first(f"`{k}`").alias(k) for k in config.tree_key], F.lit(1).cast("long").alias("root"), F.lit(1).cast("long").alias("key_high_water"))
    return trees.unionByName(new.join(trees.select("tree_id"), "tree_id", "left_anti"))


def _payloads(snapshot: Snapshot, batch: DataFrame) -> DataFrame | None:
    """None: as they were."""
    new = batch.filter("op <> 'delete' and payload is not null").select("id", "payload") if "payload" in batch.columns else None
    if not snapshot.has("payloads"):
        return new
    left = snapshot.table("payloads").join(batch.select("id"), "id", "left_anti")
    return left.unionByName(new) if new is not None else left
