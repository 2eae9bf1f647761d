"""Recall of search results against the truth, where truth is lost, beam sweeps, and comparison with a baseline."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.config import IndexConfig, SearchOptions
from vecgrove.functions.predicate import Predicate
from vecgrove.sources.store import Snapshot


def per_query(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """qid, wanted, found and recall; a query of which nothing was wanted has recall one."""
    found = truth.select("qid", "id").join(hits.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left")
    each = found.groupBy("qid").agg(F.count("*").alias("wanted"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found"))
    return each.withColumn("recall", F.when(F.col("wanted") > 0, F.col("found") / F.col("wanted")).otherwise(1.0))


def summary(recalls: DataFrame) -> DataFrame:
    return recalls.agg(F.avg("recall").alias("mean_recall"), F.min("recall").alias("min_recall"), F.count("*").alias("queries"))


def coverage(truth: DataFrame, entries: DataFrame, visited: DataFrame, pool: DataFrame) -> DataFrame:
    """Per query: how many true hits were in visited leaves, in the candidate pool, and among those reranked."""
    placed = truth.select("qid", "id").join(entries.select("id", "tree_id", "leaf_id"), "id")
    # All visits may be far more than the truth: those of true hits are looked up first.
    seen = visited.select("qid", "tree_id", "leaf_id").join(F.broadcast(placed.select("qid", "tree_id", "leaf_id").distinct()), ["qid", "tree_id", "leaf_id"]).withColumn("in_leaf", F.lit(1))
    found = placed.join(seen, ["qid", "tree_id", "leaf_id"], "left")
    both = found.join(pool.select("qid", "id", F.lit(1).alias("in_pool"), F.col("survivor").cast("int").alias("reranked")), ["qid", "id"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return both.groupBy("qid").agg(F.count("*").alias("truth"), total("in_leaf"), total("in_pool"), total("reranked"))


def sweep(snapshot: Snapshot, config: IndexConfig, queries: DataFrame, truth: DataFrame, beams: Iterable[int], options: SearchOptions = SearchOptions(), predicate: Predicate | None = None) -> DataFrame:
    """Mean recall and work per beam."""
    from functools import reduce

    from vecgrove.operators.search import search

    rows = []
    for beam in beams:
        out = search(snapshot, config, queries, predicate, replace(options, leaf_beam=beam))
        found = summary(per_query(truth, out.hits)).withColumn("beam", F.lit(beam))
        work = out.usage.agg(F.avg("visited_partitions").alias("visited_partitions"), F.avg("visited_leaf_entries").alias("visited_leaf_entries"), F.avg("exact_rerank_candidates").alias("exact_rerank_candidates")).withColumn("beam", F.lit(beam))
        rows.append(found.join(work, "beam"))
    return reduce(DataFrame.unionByName, rows)


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, extremes and the usual percentiles of a measure."""
    p = F.expr(f"percentile(`{column}`, array(0.5, 0.9, 0.95, 0.99))")
    return df.agg(F.count("*").alias("n"), F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most"), p[0].alias("p50"), p[1].alias("p90"), p[2].alias("p95"), p[3].alias("p99"))


# Allowed changes, relative but for recall and rejections, and least change of a latency in ms.
THRESHOLDS = {"p95_ms": 0.2, "throughput": -0.2, "cpu": 0.2, "rss": 0.2, "write_amplification": 0.2, "recall": -0.02, "rejection_rate": 0.05}
LEAST_MS = 1.0


def regressions(now: dict[str, float], before: dict[str, float]) -> list[str]:
    """Measures that are worse than before by more than their threshold."""
    out = []
    for name, limit in THRESHOLDS.items():
        if name in now and name in before:
            change = now[name] - before[name]
            if name in ("recall", "rejection_rate"):
                worse = change < limit if limit < 0 else change > limit
            else:
                relative = change / before[name] if before[name] else 0.0
                worse = relative < limit if limit < 0 else relative > limit
                worse = worse and not (name == "p95_ms" and abs(change) < LEAST_MS)
            if worse:
                out.append(name)
    return out
