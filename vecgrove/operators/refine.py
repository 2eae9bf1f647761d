"""Offline refinement: records move to strictly nearer leaves of a fixed topology, then centroids are refreshed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecgrove.config import IndexConfig, RefineOptions
from vecgrove.errors import require
from vecgrove.functions import distance
from vecgrove.functions.distance import Kernel
from vecgrove.operators.build import kernel_of, synopses
from vecgrove.sources.scratch import keep
from vecgrove.sources.store import Snapshot


def routing(metric: str, a, b):
    return distance.squared_l2(a, b) if metric == "l2" else -distance.dot(a, b)


def nearest_parts(sources: DataFrame, targets: DataFrame, config_kernel: Kernel, wanted: int, ceiling: int = 256 << 20) -> DataFrame:
    """Of each source (tree_id, part_id, centroid) the ``wanted`` nearest other targets of its tree: target, target_centroid.

    The targets' centres, whose size is checked, travel to the tasks that have the sources; no pairs are emitted but the
    nearest.  Ties go to the smaller number.
    """
    require(targets.count() * (4 * config_kernel.dimension + 64) <= ceiling, "partition centres", "LimitExceeded")
    of: dict[int, tuple[list, list]] = {}
    for r in targets.select("tree_id", "part_id", "centroid").orderBy("tree_id", "part_id").toLocalIterator():
        parts, centres = of.setdefault(r["tree_id"], ([], []))
        parts.append(r["part_id"])
        centres.append(np.asarray(r["centroid"], np.float32))
    shared = sources.sparkSession.sparkContext.broadcast({t: (np.array(p, np.int64), np.stack(c)) for t, (p, c) in of.items()})

    def run(batches):
        for pdf in batches:
            for tree, at in pdf.groupby("tree_id").indices.items():
                parts, centres = shared.value.get(tree, (np.zeros(0, np.int64), np.zeros((0, 1), np.float32)))
                for k in range(0, len(at) if len(parts) else 0, 256):
                    own = pdf.iloc[at[k : k + 256]]
                    far = config_kernel.routing(np.stack(own["centroid"].to_numpy()).astype(np.float32), centres).astype(float)
                    far[parts[None, :] == own["part_id"].to_numpy()[:, None]] = np.inf
                    take = min(wanted, len(parts))
                    best = np.argsort(far, axis=1, kind="stable")[:, :take]
                    rows, which = np.repeat(np.arange(len(own)), take), best.reshape(-1)
                    good = np.isfinite(far[rows, which])
                    rows, which = rows[good], which[good]
                    yield pd.DataFrame({"tree_id": tree, "part_id": own["part_id"].to_numpy()[rows], "target": parts[which], "target_centroid": list(centres[which])})

    return sources.select("tree_id", "part_id", "centroid").mapInPandas(run, "tree_id long, part_id long, target long, target_centroid array<float>")


def neighbour_leaves(leaves: DataFrame, kernel: Kernel, neighbours: int) -> DataFrame:
    """Of each leaf (tree_id, leaf_id, centroid) its nearest other leaves in the tree."""
    parts = leaves.select("tree_id", F.col("leaf_id").alias("part_id"), "centroid")
    return nearest_parts(parts, parts, kernel, neighbours).withColumnRenamed("part_id", "leaf_id")


def proposals(rows: DataFrame, leaves: DataFrame, kernel: Kernel, neighbours: int = 32) -> DataFrame:
    """(tree_id, leaf_id, id, target, gain) of rows (prepared vectors) with a strictly nearer neighbour leaf."""
    metric, near = kernel.metric, keep(neighbour_leaves(leaves, kernel, neighbours))
    own = rows.join(leaves.select("tree_id", "leaf_id", "centroid"), ["tree_id", "leaf_id"]).withColumn("now", routing(metric, F.col("vector"), F.col("centroid")))
    tried = own.join(near, ["tree_id", "leaf_id"]).withColumn("d", routing(metric, F.col("vector"), F.col("target_centroid")))
    best = tried.groupBy("tree_id", "leaf_id", "id").agg(F.first("now").alias("now"), F.min(F.struct("d", "target")).alias("best"))
    return best.filter("best.d < now").select("tree_id", "leaf_id", "id", F.col("best.target").alias("target"), (F.col("now") - F.col("best.d")).alias("gain"))


def accepted(wanted: DataFrame, counts: DataFrame, config: IndexConfig) -> DataFrame:
    """Proposals in order of gain, as many as leave their source its least and their target within its most, whatever else moves.

    Each leaf ranks what would leave it and what would come, so a group is a leaf's and never a tree's.
    """
    size = lambda name: counts.select("tree_id", F.col("leaf_id").alias(name), F.col("entry_count").alias(f"{name}_count"))
    both = wanted.join(size("leaf_id"), ["tree_id", "leaf_id"]).join(size("target"), ["tree_id", "target"])
    rank = lambda name: F.row_number().over(Window.partitionBy("tree_id", name).orderBy(F.desc("gain"), "id"))
    leaving = both.withColumn("out", rank("leaf_id")).filter(F.col("out") <= F.col("leaf_id_count") - config.leaf_min)
    coming = leaving.withColumn("in", rank("target")).filter(F.col("in") <= config.leaf_max - F.col("target_count"))
    return coming.select("tree_id", "id", "target")


def refine(snapshot: Snapshot, config: IndexConfig, options: RefineOptions = RefineOptions()) -> dict[str, DataFrame]:
    """Tables after the rounds; each round's state is written."""
    kernel = kernel_of(config)
    records = snapshot.table("records")

    def prepare(batches):
        for pdf in batches:
            yield pdf.assign(vector=list(kernel.prepare(np.stack(pdf["vector"].to_numpy())))) if len(pdf) else pdf

    rows = keep(records.select("tree_id", "leaf_id", "id", "vector").mapInPandas(prepare, records.select("tree_id", "leaf_id", "id", "vector").schema))
    leaves = keep(_centres(rows, config))
    for _ in range(options.rounds):
        moves = keep(accepted(proposals(rows, leaves, kernel, options.neighbours), leaves.select("tree_id", "leaf_id", "entry_count"), config))
        if not moves.limit(1).count():
            break
        rows = keep(rows.join(moves.select("id", "target"), "id", "left").withColumn("leaf_id", F.coalesce("target", "leaf_id")).drop("target"))
        leaves = keep(_centres(rows, config))
    return _tables(snapshot, config, rows.select("id", "leaf_id"), leaves)


def _centres(rows: DataFrame, config: IndexConfig) -> DataFrame:
    """tree_id, leaf_id, centroid, dispersion and entry_count of each leaf, in one aggregation over components."""
    kernel = kernel_of(config)
    sums = rows.select("tree_id", "leaf_id", F.posexplode("vector").alias("at", "x")).groupBy("tree_id", "leaf_id", "at").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("*").alias("n"))
    means = sums.groupBy("tree_id", "leaf_id").agg(F.max("n").alias("entry_count"), F.transform(F.array_sort(F.collect_list(F.struct("at", (F.col("s") / F.col("n")).alias("m")))), lambda v: v["m"]).alias("mean"))

    def run(batches):
        for pdf in batches:
            mean = [np.asarray(m) for m in pdf["mean"]]
            yield pdf[["tree_id", "leaf_id", "entry_count"]].assign(centroid=[kernel.centre(m) for m in mean], dispersion=[kernel.dispersion(m) for m in mean])

    return means.mapInPandas(run, "tree_id long, leaf_id long, entry_count long, centroid array<float>, dispersion double")


def _tables(snapshot: Snapshot, config: IndexConfig, places: DataFrame, leaves: DataFrame) -> dict[str, DataFrame]:
    partitions = snapshot.table("partitions")
    shard = snapshot.table("synopses").select("tree_id", "leaf_id", "shard")
    move = lambda df: df.drop("leaf_id", "shard").join(places, "id").join(shard, ["tree_id", "leaf_id"]).select(*df.columns)
    records = move(snapshot.table("records"))
    new = leaves.select("tree_id", F.col("leaf_id").alias("part_id"), F.col("centroid").alias("c"), F.col("dispersion").alias("d"), F.col("entry_count").alias("n"))
    joined = partitions.join(new, ["tree_id", "part_id"], "left")
    refreshed = joined.select(
        "tree_id", "part_id", "parent_id", "level", F.coalesce("n", "entry_count").alias("entry_count"), (F.col("epoch") + 1).alias("epoch"), "state",
        F.coalesce("c", "centroid").alias("centroid"), F.coalesce("d", "dispersion").alias("dispersion"),
    )
    return {
        "records": records,
        "leaf_entries": move(snapshot.table("leaf_entries")),
        "partitions": parents_refreshed(refreshed, config),
        "synopses": synopses(records, config),
    }


def parents_refreshed(partitions: DataFrame, config: IndexConfig) -> DataFrame:
    """Centroids of internal partitions as unweighted means of their children, level by level from the bottom."""
    top = partitions.agg(F.max("level")).first()[0] or 1
    kernel = kernel_of(config)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        mean = np.stack(pdf["centroid"].to_numpy()).astype(np.float64).mean(axis=0)
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "part_id": [pdf["parent_id"].iloc[0]], "c": [kernel.centre(mean)]})

    for level in range(2, top + 1):
        means = partitions.filter(F.col("level") == level - 1).select("tree_id", "parent_id", "centroid").groupBy("tree_id", "parent_id").applyInPandas(run, "tree_id long, part_id long, c array<float>")
        partitions = partitions.join(means, ["tree_id", "part_id"], "left").withColumn("centroid", F.coalesce("c", "centroid")).drop("c").select(*partitions.columns)
    return partitions
