"""Splits of full partitions and merges of scanty ones, on every level, each wave as one rewrite of the touched shards.

States that online maintenance goes through one by one (Splitting, ReceivingSplit, DrainingSplit, Merging) are passed
within a wave here: a snapshot shows a partition before or after.  What moves is computed once and written.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecgrove.config import IndexConfig
from vecgrove.errors import require
from vecgrove.operators import training
from vecgrove.operators.build import kernel_of, synopses
from vecgrove.operators.search import shards_in
from vecgrove.sources.scratch import keep
from vecgrove.sources.store import Shards, Snapshot


def action(config: IndexConfig) -> Column:
    """split, merge or null for each row of partitions."""
    leaf = F.col("level") == 1
    most = F.when(leaf, config.leaf_max).otherwise(config.internal_max)
    least = F.when(leaf, config.leaf_min).otherwise(config.internal_min)
    ready, root = F.col("state") == "Ready", F.col("part_id") == 1
    return (
        F.when(F.col("state").isin("Splitting", "DrainingSplit") | (ready & (F.col("entry_count") > most)), "split")
        .when((F.col("state") == "Merging") | (ready & ~root & (F.col("entry_count") < least)), "merge")
        .otherwise(F.lit(None))
    )


def actionable(partitions: DataFrame, config: IndexConfig) -> DataFrame:
    return partitions.withColumn("action", action(config)).filter("action is not null")


def drain(points: np.ndarray, two: np.ndarray, least: int, kernel) -> np.ndarray:
    """The side (0 or 1) of each point in order: the nearer target, unless the rest is needed to fill the other."""
    d = kernel.routing(points, two)
    side, count = np.zeros(len(points), np.int64), [0, 0]
    for i, (a, b) in enumerate(d):
        want = 0 if a <= b else 1
        missing = [max(0, least - c) for c in count]
        if missing[1 - want] >= len(points) - i and missing[1 - want] > 0:
            want = 1 - want
        side[i] = want
        count[want] += 1
    return side


def _numbered(snapshot: Snapshot, full: DataFrame) -> DataFrame:
    """Partitions to split with ``left_id``, the first of the two free numbers that each gets."""
    high = snapshot.table("trees").select("tree_id", "key_high_water")
    ranked = full.withColumn("n", F.row_number().over(Window.partitionBy("tree_id").orderBy("part_id"))).join(high, "tree_id")
    return ranked.withColumn("left_id", F.col("key_high_water") + 2 * F.col("n") - 1).drop("key_high_water", "n")


def _halves(config: IndexConfig, least: int):
    """Splits the members (id, vector) of one partition; also gives each new one's centre."""
    kernel = kernel_of(config)

    def one(pdf: pd.DataFrame, prepared: bool) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        points = np.stack(pdf["vector"].to_numpy()).astype(np.float32)
        points = points if prepared else kernel.prepare(points)
        left, two = training.balanced_split(points, kernel)
        side = drain(points, two, least, kernel)
        means = [points[side == k].astype(np.float64).mean(axis=0) if (side == k).any() else points[m].astype(np.float64).mean(axis=0) for k, m in ((0, left), (1, ~left))]
        two = np.stack([kernel.centre(m) for m in means])
        out = pdf[["tree_id", "part_id", "parent_id", "level", "id"]].assign(new_part=pdf["left_id"].iloc[0] + side)
        out["centroid"] = [two[s].tolist() for s in side]
        out["dispersion"] = [0.0 if prepared else kernel.dispersion(means[s]) for s in side]
        return out

    return one


def _moves(moving: DataFrame, config: IndexConfig, least: int, prepared: bool) -> DataFrame:
    id_type, one = moving.schema["id"].dataType.simpleString(), _halves(config, least)
    schema = f"tree_id long, part_id long, parent_id long, level int, id {id_type}, new_part long, centroid array<float>, dispersion double"
    return keep(moving.groupBy("tree_id", "part_id").applyInPandas(lambda pdf: one(pdf, prepared), schema), "moves")


def split_leaves(snapshot: Snapshot, config: IndexConfig) -> dict[str, DataFrame | Shards]:
    """One wave: each leaf over its capacity becomes two; a root leaf becomes an internal root above them."""
    full = keep(actionable(snapshot.table("partitions"), config).filter("action = 'split' and level = 1").select("tree_id", "part_id", "parent_id", "level"), "full")
    shards = shards_in(snapshot.table("synopses").withColumnRenamed("leaf_id", "part_id").join(full, ["tree_id", "part_id"], "left_semi"))
    rows = snapshot.table("records", shards).withColumnRenamed("leaf_id", "part_id").select("tree_id", "part_id", "id", "vector")
    moved = _moves(rows.join(_numbered(snapshot, full), ["tree_id", "part_id"]), config, config.leaf_min, False)
    return _split_topology(snapshot, moved, full) | _rewritten(snapshot, config, moved.select("id", F.col("new_part").alias("new_leaf")), shards)


def split_inner(snapshot: Snapshot, config: IndexConfig) -> dict[str, DataFrame]:
    """One wave on the lowest level that has internal partitions over their capacity: their children are shared out."""
    partitions = snapshot.table("partitions")
    full = actionable(partitions, config).filter("action = 'split' and level > 1")
    full = keep(full.join(full.agg(F.min("level").alias("level")), "level").select("tree_id", "part_id", "parent_id", "level"), "full")
    children = partitions.select("tree_id", F.col("parent_id").alias("part_id"), F.col("part_id").alias("id"), F.col("centroid").alias("vector"))
    moved = _moves(children.join(_numbered(snapshot, full), ["tree_id", "part_id"]), config, config.internal_min, True)
    return _split_topology(snapshot, moved, full)


def _split_topology(snapshot: Snapshot, moved: DataFrame, full: DataFrame) -> dict[str, DataFrame]:
    """partitions and trees after the members of ``full`` went to new partitions; a split root stays, one level up."""
    partitions = snapshot.table("partitions")
    made = moved.groupBy("tree_id", "new_part").agg(
        F.first("part_id").alias("source"), F.first("parent_id").alias("parent_id"), F.first("level").alias("level"), F.count("*").alias("entry_count"), F.first("centroid").alias("centroid"), F.first("dispersion").alias("dispersion")
    )
    root = F.lit(1).cast("long")
    fresh = made.select(
        "tree_id", F.col("new_part").alias("part_id"), F.when(F.col("source") == 1, root).otherwise(F.col("parent_id")).alias("parent_id"), "level",
        F.col("entry_count").cast("long").alias("entry_count"), root.alias("epoch"), F.lit("Ready").alias("state"), "centroid", "dispersion",
    )
    left = partitions.join(full.filter("part_id <> 1").select("tree_id", "part_id"), ["tree_id", "part_id"], "left_anti")
    grown = full.filter("part_id = 1").select("tree_id", "part_id", F.lit(1).alias("up"))
    left = left.join(grown, ["tree_id", "part_id"], "left").withColumn("level", (F.col("level") + F.coalesce("up", F.lit(0))).cast("int")).select(*partitions.columns)
    if moved.schema["id"].dataType.simpleString() == "bigint":
        # Children of split internal partitions; of leaves, ``id`` is a record's, and no partition of a leaf level has children.
        to = moved.filter("level > 1").select("tree_id", F.col("id").alias("part_id"), "new_part")
        left = left.join(to, ["tree_id", "part_id"], "left").withColumn("parent_id", F.coalesce("new_part", "parent_id")).select(*partitions.columns)
    counted = recounted(left.unionByName(fresh.select(*partitions.columns)))
    highest = counted.groupBy("tree_id").agg(F.max("part_id").alias("highest"))
    trees = snapshot.table("trees").join(highest, "tree_id").withColumn("key_high_water", F.greatest("key_high_water", "highest")).drop("highest")
    return {"partitions": counted, "trees": trees}


def recounted(partitions: DataFrame) -> DataFrame:
    """Internal partitions hold as many entries as they have children."""
    children = partitions.filter("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("part_id")).agg(F.count("*").alias("children"))
    joined = partitions.join(children, ["tree_id", "part_id"], "left")
    return joined.withColumn("entry_count", F.when(F.col("level") > 1, F.coalesce("children", F.lit(0))).otherwise(F.col("entry_count")).cast("long")).select(*partitions.columns)


def _rewritten(snapshot: Snapshot, config: IndexConfig, to: DataFrame, shards: list[int], places: DataFrame | None = None) -> dict[str, DataFrame | Shards]:
    """records, leaf_entries and synopses after records went to other leaves (id, new_leaf).

    They stay in their shard or, with ``places`` (tree_id, new_leaf, new_shard), go to the leaf's; ``shards`` has all of these.
    """

    def moved(table: str) -> DataFrame:
        own = snapshot.table(table, shards)
        joined = own.join(to, "id", "left")
        if places is not None:
            joined = joined.join(places, ["tree_id", "new_leaf"], "left").withColumn("shard", F.coalesce("new_shard", "shard"))
        return joined.withColumn("leaf_id", F.coalesce("new_leaf", "leaf_id")).select(*own.columns)

    records, old = moved("records"), snapshot.table("synopses")
    now = synopses(records, config).select(*old.columns)
    return {"records": Shards(records, shards), "leaf_entries": Shards(moved("leaf_entries"), shards), "synopses": old.filter(~F.col("shard").isin(shards)).unionByName(now)}


def merge_targets(partitions: DataFrame, config: IndexConfig) -> DataFrame:
    """For each partition to merge, the nearest Ready partition of its tree and level; ties go to the smaller key."""
    from vecgrove.operators.refine import nearest_parts

    marked = keep(partitions.withColumn("action", action(config)).select("tree_id", "part_id", "level", "state", "action", "centroid"), "marked")
    out = []
    for level in sorted(r["level"] for r in marked.filter("action = 'merge'").select("level").distinct().collect()):
        own = marked.filter(F.col("level") == level)
        found = nearest_parts(own.filter("action = 'merge'"), own.filter("state = 'Ready'"), kernel_of(config), 1)
        out.append(found.select("tree_id", F.lit(level).alias("level"), F.col("part_id").alias("source"), "target"))
    return reduce(DataFrame.unionByName, out) if out else marked.limit(0).select("tree_id", "level", F.col("part_id").alias("source"), F.col("part_id").alias("target"))


def nearest(rows: DataFrame, targets: DataFrame, config: IndexConfig, prepared: bool, ceiling: int = 256 << 20) -> DataFrame:
    """tree_id, id and new_part, the nearest of ``targets`` (tree_id, part_id, centroid; checked against ``ceiling``) in the tree."""
    require(targets.count() * (4 * config.dimension + 64) <= ceiling, "merge targets", "LimitExceeded")
    kernel, of = kernel_of(config), {}
    for r in targets.orderBy("tree_id", "part_id").select("tree_id", "part_id", "centroid").collect():
        of.setdefault(r["tree_id"], ([], []))
        of[r["tree_id"]][0].append(r["part_id"])
        of[r["tree_id"]][1].append(r["centroid"])
    shared = rows.sparkSession.sparkContext.broadcast({t: (np.array(p, np.int64), np.array(c, np.float32)) for t, (p, c) in of.items()})

    def run(batches):
        for pdf in batches:
            new = np.zeros(len(pdf), np.int64)
            for tree, at in pdf.groupby("tree_id").indices.items():
                points = np.stack(pdf["vector"].to_numpy()[at]).astype(np.float32)
                parts, centres = shared.value[tree]
                new[at] = parts[np.argmin(kernel.routing(points if prepared else kernel.prepare(points), centres), axis=1)]
            yield pdf[["tree_id", "id"]].assign(new_part=new)

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.select("tree_id", "id", "vector").mapInPandas(run, f"tree_id long, id {id_type}, new_part long")


def _scanty(partitions: DataFrame, config: IndexConfig, level: int) -> tuple[DataFrame, DataFrame]:
    """Partitions of a level to merge and those that stay in their trees; a tree of which none would stay keeps its first."""
    marked = partitions.withColumn("action", action(config)).filter(F.col("level") == level)
    sources = marked.filter("action = 'merge'").select("tree_id", "part_id")
    stay = marked.filter("action is null or action <> 'merge'").select("tree_id", "part_id", "centroid")
    none = sources.join(stay.select("tree_id").distinct(), "tree_id", "left_anti").groupBy("tree_id").agg(F.min("part_id").alias("part_id"))
    first = partitions.join(none, ["tree_id", "part_id"]).select(*stay.columns)
    sources = keep(sources.join(none, ["tree_id", "part_id"], "left_anti"), "scanty")
    return sources, keep(stay.unionByName(first).join(sources.select("tree_id").distinct(), "tree_id", "left_semi"), "stay")


def merge_leaves(snapshot: Snapshot, config: IndexConfig) -> dict[str, DataFrame | Shards]:
    """One wave: the entries of each leaf below its least occupancy go to the nearest Ready leaf that stays."""
    partitions, leaves = snapshot.table("partitions"), snapshot.table("synopses").select("tree_id", F.col("leaf_id").alias("part_id"), "shard")
    sources, stay = _scanty(partitions, config, 1)
    from_shards = shards_in(leaves.join(sources, ["tree_id", "part_id"], "left_semi"))
    rows = snapshot.table("records", from_shards).withColumnRenamed("leaf_id", "part_id").join(sources, ["tree_id", "part_id"], "left_semi")
    moved = keep(nearest(rows, stay, config, False).withColumnRenamed("new_part", "new_leaf"), "moves")
    places = leaves.join(moved.select("tree_id", F.col("new_leaf").alias("part_id")).distinct(), ["tree_id", "part_id"]).select("tree_id", F.col("part_id").alias("new_leaf"), F.col("shard").alias("new_shard"))
    places = keep(places, "places")
    shards = sorted({*from_shards, *(r["new_shard"] for r in places.select("new_shard").distinct().collect())})
    come = moved.groupBy("tree_id", F.col("new_leaf").alias("part_id")).agg(F.count("*").alias("come"))
    left = partitions.join(sources, ["tree_id", "part_id"], "left_anti").join(come, ["tree_id", "part_id"], "left")
    left = left.withColumn("entry_count", (F.col("entry_count") + F.coalesce("come", F.lit(0))).cast("long")).select(*partitions.columns)
    return {"partitions": recounted(left)} | _rewritten(snapshot, config, moved.select("id", "new_leaf"), shards, places)


def merge_inner(snapshot: Snapshot, config: IndexConfig) -> dict[str, DataFrame]:
    """One wave on the lowest level that has internal partitions to merge: each child goes to the nearest that stays."""
    partitions = snapshot.table("partitions")
    level = actionable(partitions, config).filter("action = 'merge' and level > 1").agg(F.min("level")).first()[0]
    sources, stay = _scanty(partitions, config, level)
    children = partitions.join(sources.withColumnRenamed("part_id", "parent_id"), ["tree_id", "parent_id"], "left_semi").select("tree_id", F.col("part_id").alias("id"), F.col("centroid").alias("vector"))
    to = nearest(children, stay, config, True).withColumnRenamed("id", "part_id")
    left = partitions.join(sources, ["tree_id", "part_id"], "left_anti").join(to, ["tree_id", "part_id"], "left")
    return {"partitions": recounted(left.withColumn("parent_id", F.coalesce("new_part", "parent_id")).select(*partitions.columns))}


def lonely(partitions: DataFrame) -> DataFrame:
    """Roots (tree_id) with one child, with that child's number, level and entries."""
    only = partitions.filter("parent_id = 1").groupBy("tree_id").agg(F.count("*").alias("n"), F.first(F.struct("part_id", "level", "entry_count", "centroid", "dispersion")).alias("c")).filter("n = 1")
    return only.select("tree_id", F.col("c.part_id").alias("child"), F.col("c.level").alias("child_level"), F.col("c.entry_count").alias("child_count"), F.col("c.centroid").alias("child_centroid"), F.col("c.dispersion").alias("child_dispersion"))


def collapse(snapshot: Snapshot, config: IndexConfig) -> dict[str, DataFrame | Shards]:
    """One wave: a root with one child takes that child's place."""
    partitions = snapshot.table("partitions")
    only = keep(lonely(partitions), "lonely")
    left = partitions.join(only.select("tree_id", F.col("child").alias("part_id")), ["tree_id", "part_id"], "left_anti").join(only, "tree_id", "left")
    root, has = F.col("part_id") == 1, F.col("child").isNotNull()
    for c, new in (("level", "child_level"), ("entry_count", "child_count"), ("centroid", "child_centroid"), ("dispersion", "child_dispersion")):
        left = left.withColumn(c, F.when(root & has, F.col(new)).otherwise(F.col(c)))
    left = left.withColumn("parent_id", F.when(F.col("parent_id") == F.col("child"), F.lit(1).cast("long")).otherwise(F.col("parent_id")))
    out: dict[str, DataFrame | Shards] = {"partitions": recounted(left.select(*partitions.columns))}
    leaf = only.filter("child_level = 1").select("tree_id", F.col("child").alias("leaf_id"))
    shards = shards_in(snapshot.table("synopses").join(leaf, ["tree_id", "leaf_id"], "left_semi"))
    if not shards:
        return out
    to = snapshot.table("records", shards).join(leaf, ["tree_id", "leaf_id"], "left_semi").select("id", F.lit(1).cast("long").alias("new_leaf"))
    return out | _rewritten(snapshot, config, keep(to, "moves"), shards)


def next_wave(snapshot: Snapshot, config: IndexConfig):
    """What to do next to a snapshot, None if nothing is actionable."""
    partitions = snapshot.table("partitions")
    rows = actionable(partitions, config).select("action", (F.col("level") > 1).alias("inner")).distinct().collect()
    pending = {(r["action"], r["inner"]) for r in rows}
    for what, step in ((("split", False), split_leaves), (("split", True), split_inner)):
        if what in pending:
            return step
    if not lonely(partitions).isEmpty():
        return collapse
    for what, step in ((("merge", False), merge_leaves), (("merge", True), merge_inner)):
        if what in pending:
            return step
    return None
