"""Offline construction of the forest: records in, snapshot tables out.

The clustering is written once, and all tables are derived from that.  Records are grouped by tree key and each tree is built bottom-up where its rows meet.  A tree of more rows than
``resident`` is first dealt out to coarse centres, trained on a bounded sample, so that no group is held by one
task that doesn't fit; partitions of a level get parents in the same way, until no more than ``resident`` are left for one task
to join under a root.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgrove.config import MAX_ID_BYTES, MAX_PAYLOAD_BYTES, IndexConfig
from vecgrove.errors import IndexError_, invalid
from vecgrove.functions.distance import Kernel
from vecgrove.functions.predicate import BLOOM_HASHES, bloom_bit
from vecgrove.functions.rabitq import encode
from vecgrove.operators import training
from vecgrove.sources.scratch import keep

PARTITION_SCHEMA = (
    "tree_id long, part_id long, parent_id long, level int, entry_count long, epoch long, state string, "
    "centroid array<float>, dispersion double"
)
CODE_FIELDS = ("code", "scale", "norm_sq", "err")


def kernel_of(config: IndexConfig) -> Kernel:
    return Kernel(config.metric, config.dimension, config.seed)


def checked(records: DataFrame, config: IndexConfig) -> DataFrame:
    """Fails on values that an index does not take; brings -0.0 to 0.0."""
    fail = lambda message: F.raise_error(F.lit(message))
    good = F.col("id").isNotNull() & (F.octet_length(F.col("id").cast("binary") if dict(records.dtypes)["id"] == "binary" else F.col("id").cast("string")).between(1, MAX_ID_BYTES))
    good = good & F.col("vector").isNotNull() & (F.size("vector") == config.dimension)
    good = good & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    if config.metric == "cosine":
        good = good & F.exists("vector", lambda x: x != 0)
    columns: list[Column] = [F.col("id"), F.col("vector")]
    for f in config.fields:
        c = F.col(f"`{f.name}`").cast(f.sql_type)
        if not f.nullable:
            good = good & c.isNotNull()
        if f.type == "f64":
            good = good & (c.isNull() | (~F.isnan(c) & (F.abs(c) != float("inf"))))
            c = c + F.lit(0.0)
        if f.type == "string":
            good = good & (c.isNull() | (F.octet_length(c) <= 1024))
        columns.append(c.alias(f.name))
    if "payload" in records.columns:
        good = good & (F.col("payload").isNull() | (F.octet_length("payload") <= MAX_PAYLOAD_BYTES))
        columns.append(F.col("payload"))
    ok = F.when(F.coalesce(good, F.lit(False)), F.col("id")).otherwise(fail("invalid argument"))
    return records.select(ok.cast(records.schema["id"].dataType).alias("id"), *columns[1:])


def tree_id_of(config: IndexConfig) -> Column:
    """A surrogate of the tree key, the same wherever it is computed."""
    return F.xxhash64(*[F.col(f"`{k}`") for k in config.tree_key]) if config.tree_key else F.lit(0).cast("long")


def coded(rows: DataFrame, config: IndexConfig) -> DataFrame:
    """Adds the code columns from ``vector``, and drops it."""
    kernel = kernel_of(config)
    kept = [c for c in rows.columns if c != "vector"]

    def run(batches):
        for pdf in batches:
            x = np.stack(pdf["vector"].to_numpy()) if len(pdf) else np.zeros((0, config.dimension), np.float32)
            c = encode(kernel.prepare(x))
            yield pdf[kept].assign(code=[row.tobytes() for row in c.code], scale=c.scale, norm_sq=c.norm_sq, err=c.err)

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.mapInPandas(run, f"{fields}, code binary, scale float, norm_sq int, err float")


def _mean(points: np.ndarray) -> np.ndarray:
    return np.add.accumulate(points.astype(np.float64), axis=0)[-1] / len(points)


def construct_tree(points: np.ndarray, keys: np.ndarray, config: IndexConfig, kernel: Kernel, leaf_base: int = 0) -> tuple[np.ndarray, pd.DataFrame]:
    """(leaf of each point, partitions) of one tree, bottom-up; the root has part_id 1."""
    leaf_rows = training.groups(points, keys, config.leaf_max, config.leaf_min, config.sample_items, kernel)
    leaf_of, parts, next_id = np.zeros(len(points), np.int64), [], 2
    members, level = leaf_rows, 1
    child_ids: list[int] | None = None
    while True:
        root = len(members) == 1
        ids, means = [], []
        for rows in members:
            part = 1 if root else next_id
            next_id += not root
            own = points[rows] if child_ids is None else points_up[rows]
            mean = _mean(own)
            ids.append(part)
            means.append(kernel.centre(mean))
            parts.append([part, None, level, len(rows), means[-1].tolist(), kernel.dispersion(mean) if level == 1 else 0.0])
            if child_ids is None:
                leaf_of[rows] = part
            else:
                for r in rows:
                    parent_of[child_ids[r]] = part
        if child_ids is None:
            parent_of: dict[int, int] = {}
        if root:
            break
        points_up, child_ids = np.stack(means), ids
        stable = np.arange(len(ids))
        members = training.groups(points_up, stable, config.internal_max, min(config.internal_min, max(1, len(ids) // 2)), config.sample_items, kernel)
        level += 1
    frame = pd.DataFrame(parts, columns=["part_id", "parent_id", "level", "entry_count", "centroid", "dispersion"])
    frame["parent_id"] = frame["part_id"].map(parent_of).astype("Int64")
    return leaf_of, frame


NEIGHBOURS = 64
"""Leaves of consecutive numbers, which are neighbours when built, that share a shard."""


def shard_of(shards: int) -> Column:
    """The shard of a leaf that has none yet."""
    return F.pmod(F.xxhash64("tree_id", F.floor(F.col("leaf_id") / NEIGHBOURS).cast("long")), F.lit(shards)).cast("int")


def shards_for(records: DataFrame, config: IndexConfig) -> int:
    return max(1, -(-records.count() // config.shard_rows))


def build(records: DataFrame, config: IndexConfig, resident: int = 500_000, shards: int = 1) -> dict[str, DataFrame]:
    """All tables of a snapshot from a frame of records (id, vector, fields and perhaps payload)."""
    rows = checked(records, config).withColumn("tree_id", tree_id_of(config))
    if rows.groupBy("id").count().filter("count > 1").limit(1).count():
        raise invalid("duplicate ids")
    keys = [f"`{k}`" for k in config.tree_key]
    if keys and rows.select("tree_id", *keys).distinct().groupBy("tree_id").count().filter("count > 1").limit(1).count():
        raise IndexError_("Corruption", None, "two tree keys with one number")
    built = keep(_constructed(rows, config, resident), "clustering")
    assigned = built.filter("part_id is null").select("id", "leaf_id")
    partitions = built.filter("part_id is not null").select(*[c.strip().split()[0] for c in PARTITION_SCHEMA.replace("array<float>", "array").split(",")])
    return tables_from(keep(rows.join(assigned, "id").withColumn("shard", shard_of(shards)), "assigned"), partitions, config)


def tables_from(rows: DataFrame, partitions: DataFrame, config: IndexConfig) -> dict[str, DataFrame]:
    """Snapshot tables from records with tree_id, leaf_id and shard, and the partitions."""
    names = [f.name for f in config.fields]
    keys = [F.first(f"`{k}`").alias(k) for k in config.tree_key]
    trees = rows.groupBy("tree_id").agg(F.count("*").alias("records"), *keys)
    high = partitions.groupBy("tree_id").agg(F.max("part_id").alias("key_high_water"))
    out = {
        "records": rows.select("id", "vector", *[f"`{n}`" for n in names], "tree_id", "leaf_id", "shard"),
        "trees": trees.join(high, "tree_id").withColumn("root", F.lit(1).cast("long")).drop("records"),
        "partitions": partitions,
        "leaf_entries": coded(rows.select("shard", "tree_id", "leaf_id", "id", *[f"`{n}`" for n in names], "vector"), config),
        "synopses": synopses(rows, config),
    }
    if "payload" in rows.columns:
        out["payloads"] = rows.filter("payload is not null").select("id", "payload")
    return out


def synopses(rows: DataFrame, config: IndexConfig, by: tuple[str, ...] = ("tree_id", "leaf_id")) -> DataFrame:
    """Per leaf: has_null, min, max of each field, and the set bits of its Bloom filter if it has one."""
    aggregates = [F.count("*").alias("entries"), *([F.min("shard").alias("shard")] if "shard" in rows.columns else [])]
    for f in config.fields:
        c = F.col(f"`{f.name}`")
        aggregates += [F.max(c.isNull()).alias(f"{f.name}_has_null"), F.min(c).alias(f"{f.name}_min"), F.max(c).alias(f"{f.name}_max")]
        if f.bloom_bits:
            bits = F.when(c.isNotNull(), F.array(*[bloom_bit(c, f.bloom_bits, k) for k in range(BLOOM_HASHES)]))
            aggregates.append(F.array_sort(F.array_distinct(F.flatten(F.collect_set(bits)))).alias(f"{f.name}_bloom"))
    return rows.groupBy(*by).agg(*aggregates)


def _constructed(rows: DataFrame, config: IndexConfig, resident: int) -> DataFrame:
    """Rows (tree_id, id, leaf_id) of assignments and rows of PARTITION_SCHEMA, in one frame."""
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"{PARTITION_SCHEMA}, id {id_type}, leaf_id long"
    narrow = rows.select("tree_id", "id", "vector", F.xxhash64("id").alias("key"))
    kernel = kernel_of(config)
    large = [r["tree_id"] for r in rows.groupBy("tree_id").count().filter(F.col("count") > resident).collect()]

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        points = kernel.prepare(np.stack(pdf["vector"].to_numpy()))
        leaf_of, parts = construct_tree(points, pdf["key"].to_numpy(), config, kernel)
        tree = pdf["tree_id"].iloc[0]
        assigned = pd.DataFrame({"tree_id": tree, "id": pdf["id"], "leaf_id": leaf_of})
        parts = parts.assign(tree_id=tree, epoch=1, state="Ready")
        return _aligned(pd.concat([assigned, parts], ignore_index=True))

    small = narrow.filter(~F.col("tree_id").isin(large)) if large else narrow
    frames = [small.groupBy("tree_id").applyInPandas(one, schema)]
    frames += [_large_tree(narrow.filter(F.col("tree_id") == t), t, config, kernel, resident, schema) for t in large]
    return reduce(DataFrame.unionByName, frames)


_COLUMNS = ["tree_id", "part_id", "parent_id", "level", "entry_count", "epoch", "state", "centroid", "dispersion", "id", "leaf_id"]


def _aligned(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.reindex(columns=_COLUMNS)
    for c in ("part_id", "parent_id", "entry_count", "epoch", "leaf_id"):
        frame[c] = frame[c].astype("Int64")
    frame["level"] = frame["level"].astype("Int32")
    for c in ("centroid", "state", "id"):
        frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
    return frame


def _dealt(rows: DataFrame, column: str, kernel: Kernel, resident: int, prepared: bool) -> DataFrame:
    """Adds ``part`` and ``piece``, which tell apart groups of about ``resident`` rows near a coarse centre.

    ``column`` has the vectors and ``key`` a hash.  Centres are trained on a bounded sample.
    """
    n = rows.count()
    sample = rows.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(65536 / n * (1 << 20)) + 1).select(column).limit(131072).toPandas()
    ready = (lambda x: x.astype(np.float32)) if prepared else kernel.prepare
    seen = ready(np.stack(sample[column].to_numpy()))
    coarse = training.centres(seen, min(2 * -(-n // resident), len(seen)), kernel)

    def label(batches):
        for pdf in batches:
            yield pdf.assign(part=np.argmin(kernel.routing(ready(np.stack(pdf[column].to_numpy())), coarse), axis=1))

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in rows.columns)
    dealt = keep(rows.mapInPandas(label, f"{fields}, part int"), "dealt")
    # A part that is still too large, as of equal vectors, is dealt on by a hash.
    sizes = dealt.groupBy("part").agg(F.ceil(F.count("*") / resident).cast("int").alias("pieces"))
    return dealt.join(F.broadcast(sizes), "part").withColumn("piece", F.pmod(F.col("key"), F.col("pieces"))).drop("pieces")


def _large_tree(rows: DataFrame, tree: int, config: IndexConfig, kernel: Kernel, resident: int, schema: str) -> DataFrame:
    """Coarse parts of a tree are built apart; their leaves then get common parents, level by level."""

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id", ignore_index=True)
        points = kernel.prepare(np.stack(pdf["vector"].to_numpy()))
        base = (int(pdf["part"].iloc[0]) << 34) + (int(pdf["piece"].iloc[0]) << 17) + 2
        out, parts = np.zeros(len(pdf), np.int64), []
        for k, own in enumerate(training.groups(points, pdf["key"].to_numpy(), config.leaf_max, config.leaf_min, config.sample_items, kernel)):
            mean = _mean(points[own])
            out[own] = base + k
            parts.append([tree, base + k, 1, len(own), 1, "Ready", kernel.centre(mean).tolist(), kernel.dispersion(mean)])
        assigned = pd.DataFrame({"tree_id": tree, "id": pdf["id"], "leaf_id": out})
        made = pd.DataFrame(parts, columns=["tree_id", "part_id", "level", "entry_count", "epoch", "state", "centroid", "dispersion"])
        return _aligned(pd.concat([assigned, made], ignore_index=True))

    def parents(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part_id", ignore_index=True)
            points = np.stack(pdf["centroid"].to_numpy()).astype(np.float32)
            # Numbers below what a double holds exactly, as pandas may pass through doubles.
            base = (1 << 51) + (level << 46) + (int(pdf["part"].iloc[0]) << 30) + (int(pdf["piece"].iloc[0]) << 20)
            parent, made = np.zeros(len(pdf), np.int64), []
            least = min(config.internal_min, max(1, len(pdf) // 2))
            for k, own in enumerate(training.groups(points, np.arange(len(pdf)), config.internal_max, least, config.sample_items, kernel)):
                parent[own] = base + k
                made.append([tree, base + k, level, len(own), 1, "Ready", kernel.centre(_mean(points[own])).tolist(), 0.0])
            frame = pd.DataFrame(made, columns=["tree_id", "part_id", "level", "entry_count", "epoch", "state", "centroid", "dispersion"])
            return _aligned(pd.concat([pdf.assign(parent_id=parent), frame], ignore_index=True))

        return run

    def above(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part_id", ignore_index=True)
            up = config.with_(leaf_min=min(config.internal_min, config.internal_max // 2), leaf_max=config.internal_max)
            points = np.stack(pdf["centroid"].to_numpy()).astype(np.float32)
            parent_of, parts = construct_tree(points, np.arange(len(points)), up, kernel)
            # Above all other numbers but the root's.
            lifted = lambda p: None if pd.isna(p) else 1 if p == 1 else (1 << 52) + int(p)
            parts["parent_id"] = pd.array([lifted(p) for p in parts["parent_id"]], "Int64")
            parts["part_id"] = [lifted(p) for p in parts["part_id"]]
            parts = parts.assign(level=parts["level"] + level, tree_id=tree, epoch=1, state="Ready", dispersion=0.0)
            own = pdf.assign(parent_id=[lifted(p) for p in parent_of])
            return _aligned(pd.concat([own, parts], ignore_index=True))

        return run

    bottom = keep(_dealt(rows, "vector", kernel, resident, False).groupBy("part", "piece").applyInPandas(leaves, schema), "leaves")
    done, now, level = [bottom.filter("part_id is null")], bottom.filter("part_id is not null"), 1
    while now.count() > max(resident, 2 * config.internal_max):
        dealt = _dealt(now.withColumn("key", F.xxhash64("part_id")), "centroid", kernel, resident, True)
        made = keep(dealt.drop("key").groupBy("part", "piece").applyInPandas(parents(level + 1), schema), "parents")
        done.append(made.filter(F.col("level") == level))
        now, level = made.filter(F.col("level") == level + 1), level + 1
    done.append(now.groupBy("tree_id").applyInPandas(above(level), schema))
    return reduce(DataFrame.unionByName, done)
