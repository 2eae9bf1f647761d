"""Which leaves a query visits: a pure function of the routing tables, the match counts and the budgets."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark import SparkContext
from pyspark.sql import DataFrame

from vecgrove.errors import require
from vecgrove.functions.distance import DISPERSION_WEIGHT, Kernel
from vecgrove.plans.local_graph import LocalGraph, seed_of

ROOT = 1
NO_BOUND = 1 << 62


def beam_width(beam: int, level: int) -> int:
    return max(1, beam >> (level - 1))


class Topology:
    """The partitions of a snapshot as arrays.  Its size is checked against the caller's ceiling before it is loaded."""

    def __init__(self, tree: np.ndarray, part: np.ndarray, parent: np.ndarray, level: np.ndarray, centroid: np.ndarray, dispersion: np.ndarray):
        self.level_of = dict(zip(zip(tree.tolist(), part.tolist(), strict=True), level.tolist(), strict=True))
        self.children: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray, int]] = {}
        self.graphs: dict[tuple[int, int], LocalGraph] = {}
        has = np.flatnonzero(parent > 0)
        order = has[np.lexsort((part[has], parent[has], tree[has]))]
        if len(order):
            t, p = tree[order], parent[order]
            at = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (p[1:] != p[:-1])]))
            for a, b in zip(at, np.append(at[1:], len(order)), strict=True):
                own = order[a:b]
                self.children[int(tree[own[0]]), int(parent[own[0]])] = (part[own], centroid[own], dispersion[own], int(level[own[0]]))

    def build_graphs(self, kernel: Kernel, m: int, ef_construction: int, seed: int, least: int = 64, context: SparkContext | None = None) -> None:
        """For partitions of at least ``least`` children; fewer are scored one by one in any case.  With a context, tasks build one each."""
        own = [(key, found[1]) for key, found in self.children.items() if len(found[1]) >= least]

        def built(item):
            (tree, part), centroid = item
            return LocalGraph(centroid, kernel, m, ef_construction, seed_of(seed, tree, part)).parts

        if context is None or len(own) < 2:
            made = [built(x) for x in own]
        else:
            made = context.parallelize(own, len(own)).map(built).collect()
        for (key, centroid), parts in zip(own, made, strict=True):
            self.graphs[key] = LocalGraph.made(centroid, kernel, m, parts)

    @staticmethod
    def load(partitions: DataFrame, dimension: int, ceiling: int) -> Topology:
        require(partitions.count() * (4 * dimension + 64) <= ceiling, "routing tables", "LimitExceeded")
        pdf = partitions.select("tree_id", "part_id", "parent_id", "level", "centroid", "dispersion").toPandas()
        centroid = np.stack(pdf["centroid"].to_numpy()).astype(np.float32) if len(pdf) else np.zeros((0, dimension), np.float32)
        return Topology(pdf["tree_id"].to_numpy(np.int64), pdf["part_id"].to_numpy(np.int64), pdf["parent_id"].fillna(0).to_numpy(np.int64), pdf["level"].to_numpy(np.int64), centroid, pdf["dispersion"].to_numpy(np.float64))


@dataclass
class Visits:
    leaves: list[tuple[int, int]] = field(default_factory=list)
    partitions: int = 0
    exhausted: bool = False
    distances: int = 0
    walks: int = 0
    """Partitions whose children a graph found."""


def everything(topology: Topology, trees: list[int], beam: int, budget: int, matches: dict[tuple[int, int], int] | None = None) -> Visits | None:
    """What any query visits if neither beam nor budget can cut a level short, else nothing: all partitions of the trees."""
    own = [(t, ROOT) for t in trees if (t, ROOT) in topology.level_of]
    for part in own:  # grows meanwhile
        found = topology.children.get(part)
        own += [(part[0], int(p)) for p in found[0]] if found is not None else []
    levels, hits = Counter((t, topology.level_of[t, p]) for t, p in own), Counter(t for (t, _), n in (matches or {}).items() if n)
    if matches is None:
        narrow = any(n > beam_width(beam, level) for (_, level), n in levels.items())
    else:  # goes on past any width until as many leaves with matches are seen as the beam is wide
        narrow = any(n >= beam for n in hits.values())
    return None if narrow or len(own) > budget else Visits([x for x in own if topology.level_of[x] == 1], len(own))


def traverse(topology: Topology, kernel: Kernel, query: np.ndarray, trees: list[int], beam: int, budget: int, matches: dict[tuple[int, int], int] | None = None, trees_order: dict[int, int] | None = None, ef: int = 0) -> Visits:
    """``query`` is prepared.  With ``ef``, children of partitions that have a graph are found by it.  With ``matches`` (entries per leaf that pass the filter) the search goes on past leaves
    without a match, tree by tree, until ``beam`` leaves with one are seen or nothing is left."""
    out = Visits()
    rank = trees_order or {t: i for i, t in enumerate(trees)}

    def scored(tree: int, part: int) -> list[tuple[float, int, int, int]]:
        found = topology.children.get((tree, part))
        if found is None:
            return []
        parts, centroid, dispersion, level = found
        graph = topology.graphs.get((tree, part)) if ef else None
        if graph is not None and beam_width(beam, level) < len(parts):
            out.walks += 1
            near = graph.search(query, beam_width(beam, level), ef)
            rows = np.array([i for _, i in near])
            score, parts, dispersion = np.array([d for d, _ in near]), parts[rows], dispersion[rows]
        else:
            score = kernel.routing(query[None], centroid)[0]
        if kernel.metric == "cosine" and level == 1:
            score = score + DISPERSION_WEIGHT * dispersion
        out.distances += len(parts)
        return [(float(s), rank[tree], int(p), level) for s, p in zip(score, parts, strict=True)]

    tree_at = {i: t for t, i in rank.items()}
    frontier = [(0.0, rank[t], ROOT, topology.level_of[t, ROOT]) for t in trees if (t, ROOT) in topology.level_of]
    pending: dict[tuple[int, int], list] = {}
    effective = dict.fromkeys(rank.values(), 0)

    def done(r: int) -> bool:
        return matches is not None and effective[r] >= beam

    while True:
        following: dict[tuple[int, int], list] = {}
        for position, (_, r, part, level) in enumerate(sorted(frontier)):
            if out.partitions == budget:
                out.exhausted = position < len(frontier)
                return out
            out.partitions += 1
            tree = tree_at[r]
            if level == 1:
                out.leaves.append((tree, part))
                if matches is not None and matches.get((tree, part), 0):
                    effective[r] += 1
            else:
                for child in scored(tree, part):
                    following.setdefault((child[3], r), []).append(child)
        if matches is None:
            frontier = [c for (level, _), found in following.items() for c in sorted(found)[: beam_width(beam, level)]]
        else:
            for key, found in following.items():
                pending[key] = sorted(pending.get(key, []) + found)[:budget]
            open_levels = [level for (level, r), found in pending.items() if found and not done(r)]
            frontier = []
            if open_levels:
                level = min(open_levels)
                for (own, r), found in list(pending.items()):
                    if own == level and found and not done(r):
                        take = beam - effective[r] if level == 1 else beam_width(beam, level)
                        frontier += found[:take]
                        pending[own, r] = found[take:]
        if not frontier:
            return out
