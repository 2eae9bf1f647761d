"""Integrity checks of a snapshot, as joins: each returns the rows at fault with the kind of issue."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.config import IndexConfig, VerifyOptions
from vecgrove.functions.rabitq import encode
from vecgrove.operators.build import CODE_FIELDS, kernel_of, synopses
from vecgrove.operators.maintain import action
from vecgrove.sources.store import Snapshot


def _issue(df: DataFrame, kind: str, subject) -> DataFrame:
    return df.select(F.lit(kind).alias("kind"), subject.cast("string").alias("subject"))


def membership(records: DataFrame, entries: DataFrame) -> DataFrame:
    """Records without a leaf entry where they say, and entries that no record points to; entries that repeat."""
    key = ["id", "tree_id", "leaf_id"]
    missing = records.select(*key).join(entries.select(*key), key, "left_anti")
    dangling = entries.select(*key).join(records.select(*key), key, "left_anti")
    twice = entries.groupBy("id").count().filter("count > 1")
    return reduce(DataFrame.unionByName, [_issue(missing, "Membership", F.col("id")), _issue(dangling, "Membership", F.col("id")), _issue(twice, "Membership", F.col("id"))])


def payload_membership(records: DataFrame, payloads: DataFrame) -> DataFrame:
    return _issue(payloads.select("id").join(records.select("id"), "id", "left_anti"), "Membership", F.col("id"))


def projection(records: DataFrame, entries: DataFrame, config: IndexConfig) -> DataFrame:
    """Entries whose fields differ from their record's."""
    a, b = records.alias("a"), entries.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.`{f.name}`").eqNullSafe(F.col(f"b.`{f.name}`")) for f in config.fields], F.lit(True))
    both = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.tree_id") == F.col("b.tree_id")) & (F.col("a.leaf_id") == F.col("b.leaf_id")))
    return _issue(both.filter(~same), "RecordProjectionMismatch", F.col("a.id"))


def codes(records: DataFrame, entries: DataFrame, config: IndexConfig) -> DataFrame:
    """Entries whose code isn't that of their record's vector.

    A component may be off by one step, as matrix products differ in the last bit between machines and batches.
    """
    kernel, key = kernel_of(config), ["id", "tree_id", "leaf_id"]
    both = records.select(*key, "vector").join(entries.select(*key, *CODE_FIELDS), key)
    id_type = records.schema["id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            now = encode(kernel.prepare(np.stack(pdf["vector"].to_numpy())))
            whole = pdf["code"].map(len).to_numpy() == now.code.shape[1]
            stored = np.zeros_like(now.code)
            stored[whole] = np.frombuffer(b"".join(pdf["code"][whole]), np.int8).reshape(-1, now.code.shape[1])
            good = whole & (np.abs(stored.astype(int) - now.code.astype(int)) <= 1).all(axis=1)
            for c, bound in (("scale", 1e-3), ("err", 1e-2)):
                good &= np.isclose(pdf[c].to_numpy(float), getattr(now, c).astype(float), rtol=bound, atol=1e-5)
            good &= np.abs(pdf["norm_sq"].to_numpy(float) - now.norm_sq.astype(float)) <= 1 + 2 * np.abs(now.code.astype(float)).sum(axis=1) * (stored != now.code).any(axis=1)
            yield pdf.loc[~good, ["id"]]

    return _issue(both.mapInPandas(run, f"id {id_type}"), "RecordProjectionMismatch", F.col("id"))


def counts(partitions: DataFrame, entries: DataFrame) -> DataFrame:
    """Leaves and internal partitions whose count isn't that of their entries or children."""
    leaf = entries.groupBy("tree_id", F.col("leaf_id").alias("part_id")).agg(F.count("*").alias("n"))
    child = partitions.filter("parent_id is not null").groupBy("tree_id", F.col("parent_id").alias("part_id")).agg(F.count("*").alias("n"))
    held = leaf.withColumn("bottom", F.lit(True)).unionByName(child.withColumn("bottom", F.lit(False)))
    joined = partitions.withColumn("bottom", F.col("level") == 1).join(held, ["tree_id", "part_id", "bottom"], "left")
    return _issue(joined.filter(F.col("entry_count") != F.coalesce("n", F.lit(0))), "CountMismatch", F.concat_ws("/", "tree_id", "part_id"))


def reachability(trees: DataFrame, partitions: DataFrame, entries: DataFrame) -> DataFrame:
    """Missing roots, partitions without a parent that exists one level above, and entries of no leaf."""
    own = partitions.select("tree_id", "part_id", "parent_id", "level")
    above = own.select("tree_id", F.col("part_id").alias("parent_id"), (F.col("level") - 1).alias("level"))
    lost = own.filter("part_id <> 1").join(above, ["tree_id", "parent_id", "level"], "left_anti")
    rootless = trees.select("tree_id", F.lit(1).cast("long").alias("part_id")).join(own, ["tree_id", "part_id"], "left_anti")
    leaves = own.filter("level = 1").select("tree_id", F.col("part_id").alias("leaf_id"))
    nowhere = entries.select("tree_id", "leaf_id").distinct().join(leaves, ["tree_id", "leaf_id"], "left_anti")
    name = lambda c: F.concat_ws("/", "tree_id", c)
    return reduce(DataFrame.unionByName, [_issue(lost, "Reachability", name("part_id")), _issue(rootless, "Reachability", name("part_id")), _issue(nowhere, "Reachability", name("leaf_id"))])


def edges(partitions: DataFrame) -> DataFrame:
    """Partitions with more than one incoming edge."""
    return _issue(partitions.groupBy("tree_id", "part_id").count().filter("count > 1"), "Membership", F.concat_ws("/", "tree_id", "part_id"))


def allocators(trees: DataFrame, partitions: DataFrame) -> DataFrame:
    """Trees whose next free key has been used."""
    used = partitions.groupBy("tree_id").agg(F.max("part_id").alias("used"))
    return _issue(trees.join(used, "tree_id").filter("key_high_water < used"), "CountMismatch", F.col("tree_id"))


def narrow_synopses(stored: DataFrame, entries: DataFrame, config: IndexConfig) -> DataFrame:
    """Leaves whose synopsis doesn't cover what their entries hold; wider ones are fine."""
    now = synopses(entries, config)
    renamed = now.select("tree_id", "leaf_id", *[F.col(f"`{c}`").alias(f"now_{c}") for c in now.columns if c not in ("tree_id", "leaf_id")])
    joined = renamed.join(stored.withColumn("here", F.lit(True)), ["tree_id", "leaf_id"], "left")
    bad = F.col("here").isNull()
    for f in config.fields:
        n = f.name
        bad = bad | (F.col(f"now_{n}_has_null") & ~F.coalesce(f"{n}_has_null", F.lit(False)))
        bad = bad | (F.col(f"now_{n}_min").isNotNull() & (F.col(f"{n}_min").isNull() | (F.col(f"now_{n}_min") < F.col(f"{n}_min")) | (F.col(f"now_{n}_max") > F.col(f"{n}_max"))))
        if f.bloom_bits:
            bad = bad | (F.size(F.array_except(f"now_{n}_bloom", F.coalesce(F.col(f"{n}_bloom"), F.array().cast("array<int>")))) > 0)
    return _issue(joined.filter(F.coalesce(bad, F.lit(False))), "SynopsisNotConservative", F.concat_ws("/", "tree_id", "leaf_id"))


def issues(snapshot: Snapshot, config: IndexConfig) -> DataFrame:
    t = snapshot.table
    records, entries, partitions, trees = t("records"), t("leaf_entries"), t("partitions"), t("trees")
    parts = [
        membership(records, entries), projection(records, entries, config), codes(records, entries, config), counts(partitions, entries), reachability(trees, partitions, entries),
        edges(partitions), allocators(trees, partitions), narrow_synopses(t("synopses"), entries, config),
    ]
    if snapshot.has("payloads"):
        parts.append(payload_membership(records, t("payloads")))
    return reduce(DataFrame.unionByName, parts)


def report(snapshot: Snapshot, config: IndexConfig, options: VerifyOptions = VerifyOptions()) -> dict:
    """At most ``issues`` issues in order, whether that is all of them, and the topology."""
    found = issues(snapshot, config).orderBy("kind", "subject").limit(options.issues + 1).collect()
    objects = snapshot.table("records").count() + snapshot.table("partitions").count()
    complete = len(found) <= options.issues and objects <= options.objects
    return {"complete": complete, "issues": [(r["kind"], r["subject"]) for r in found[: options.issues]], "topology": topology(snapshot.table("partitions"), config)}


def by_level(partitions: DataFrame) -> DataFrame:
    return partitions.groupBy("level").agg(F.count("*").alias("partitions"), F.sum("entry_count").alias("entries"))


def by_state(partitions: DataFrame) -> DataFrame:
    return partitions.groupBy("state").agg(F.count("*").alias("partitions"))


def topology(partitions: DataFrame, config: IndexConfig) -> dict:
    row = partitions.agg(F.countDistinct("tree_id").alias("trees"), F.count("*").alias("partitions"), F.max("level").alias("max_level"), F.count(action(config)).alias("actionable")).first()
    return row.asDict() | {"levels": {r["level"]: r["partitions"] for r in by_level(partitions).collect()}, "states": {r["state"]: r["partitions"] for r in by_state(partitions).collect()}}
