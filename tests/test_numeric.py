import itertools

import numpy as np
import pytest

from vecgrove.functions.distance import Kernel, half_away
from vecgrove.functions.rabitq import LEVELS, Query, encode
from vecgrove.operators import recall, training
from vecgrove.plans.local_graph import LocalGraph
from vecgrove.plans.traverse import Topology, traverse
from vecgrove.sources import datasets


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
@pytest.mark.parametrize("d", [1, 3, 16, 65])
def test_intervals_hold_the_exact_distance(metric, d):
    rng = np.random.default_rng(d)
    x = (rng.normal(size=(300, d)) * rng.choice([1e-3, 1, 50], size=(300, 1))).astype(np.float32)
    x[0] = 0 if metric != "cosine" else 1
    kernel = Kernel(metric, d, 7)
    p = kernel.prepare(x)
    codes = encode(p)
    assert np.abs(codes.code.astype(int)).max() <= LEVELS
    rebuilt = codes.scale[:, None].astype(float) * codes.code
    assert (np.linalg.norm(p - rebuilt, axis=1) <= codes.err.astype(float) + 1e-12).all()
    for q in kernel.prepare(x[:10] + 0.01):
        rough, low, high = Query(q, metric).rough(codes)
        a, b = q.astype(float), p.astype(float)
        exact = ((a - b) ** 2).sum(1) if metric == "l2" else -(b @ a) if metric == "inner_product" else 1 - b @ a
        slack = 1e-9 * (1 + np.abs(exact))
        assert (low <= exact + slack).all() and (exact <= high + slack).all()


def test_half_away():
    assert half_away(np.array([0.5, 2.5, -2.5, 0.49999999999999994])).tolist() == [1, 3, -3, 0]


def test_rotation_keeps_norms_and_dots():
    x = np.random.default_rng(0).normal(size=(20, 33)).astype(np.float32)
    y = Kernel("l2", 33, 3).prepare(x)
    assert np.allclose(x @ x.T, y @ y.T, atol=1e-4)


def test_balanced_split_and_cut_sizes():
    x = np.concatenate([np.zeros((5, 2)), np.ones((6, 2))]).astype(np.float32)
    left, two = training.balanced_split(x, Kernel("l2", 2, 1))
    assert left.sum() == 5 and len(two) == 2
    assert training.cut_sizes([5, 5], 2) == [5, 5]
    for counts, least in (([9, 1, 0], 2), ([0, 0, 12], 3), ([5, 1, 1, 1], 1), ([3, 0, 9, 4], 2), ([20, 1], 4), ([1, 1, 1, 30], 5)):
        n, k = sum(counts), len(counts)
        may = [s for s in itertools.product(range(least, n * 3 // 4 + 1), repeat=k) if sum(s) == n]
        got = training.cut_sizes(counts, least)
        assert tuple(got) in may and (tuple(counts) not in may or got == counts)
    assert sum(training.cut_sizes([10, 0, 0], 2)) == 10 and min(training.cut_sizes([10, 0, 0], 2)) >= 2


def test_groups_of_equal_vectors_shrink():
    x = np.zeros((1000, 4), np.float32)
    parts = training.groups(x, np.arange(1000), 32, 8, 64, Kernel("l2", 4, 1))
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000)) and all(8 <= len(p) <= 32 for p in parts)


def two_trees():
    """Two trees of a root with four leaves on a line each."""
    tree, part, parent, level, centre = [], [], [], [], []
    for t in (0, 1):
        tree += [t] * 5
        part += [1, 2, 3, 4, 5]
        parent += [0, 1, 1, 1, 1]
        level += [2, 1, 1, 1, 1]
        centre += [[0.0]] + [[float(i + t / 2)] for i in range(4)]
    return Topology(np.array(tree), np.array(part), np.array(parent), np.array(level), np.array(centre, np.float32), np.zeros(10))


class Plain(Kernel):
    def prepare(self, vectors):
        return np.asarray(vectors, np.float32)


def test_traversal_budget_and_beam():
    kernel, q = Plain("l2", 1, 1), np.zeros(1, np.float32)
    v = traverse(two_trees(), kernel, q, [0, 1], 1, 100)
    assert v.leaves == [(0, 2), (1, 2)] and v.partitions == 4 and not v.exhausted
    v = traverse(two_trees(), kernel, q, [0, 1], 2, 3)
    assert v.partitions == 3 and v.exhausted and v.leaves == [(0, 2)]
    assert not traverse(two_trees(), kernel, q, [0, 1], 2, 6).exhausted


def test_filtered_search_goes_on_past_leaves_without_a_match():
    kernel, q = Plain("l2", 1, 1), np.zeros(1, np.float32)
    matches = {(0, 5): 1, (1, 2): 3}
    v = traverse(two_trees(), kernel, q, [0, 1], 1, 100, matches)
    assert [x for x in v.leaves if x[0] == 0] == [(0, 2), (0, 3), (0, 4), (0, 5)]
    assert [x for x in v.leaves if x[0] == 1] == [(1, 2)]
    assert v.partitions == 7 and not v.exhausted
    assert traverse(two_trees(), kernel, q, [0, 1], 1, 5, matches).exhausted


def test_files_and_generators():
    rows = np.arange(6, dtype="<f4").reshape(2, 3)
    raw = b"".join(np.int32(3).tobytes() + r.tobytes() for r in rows)
    assert np.array_equal(datasets.decode(raw, "fvecs"), rows)
    image = bytes([0, 0, 8, 3, 0, 0, 0, 2, 0, 0, 0, 2, 0, 0, 0, 1, 1, 2, 3, 4])
    assert datasets.decode(image, "idx").tolist() == [[1, 2], [3, 4]]
    with pytest.raises(Exception):
        datasets.decode(raw[:-1], "fvecs")
    assert np.array_equal(datasets.clustered(50, 3, 4, seed=7), datasets.clustered(50, 3, 4, seed=7))
    assert np.abs(datasets.uniform(100, 2)).max() <= 1


def test_regressions():
    before = {"p95_ms": 10.0, "throughput": 100.0, "recall": 0.95}
    assert recall.regressions({"p95_ms": 13.0, "throughput": 90.0, "recall": 0.94}, before) == ["p95_ms"]
    assert recall.regressions({"p95_ms": 0.9, "throughput": 70.0, "recall": 0.92}, {"p95_ms": 0.5} | before | {"p95_ms": 0.5}) == ["throughput", "recall"]


def test_local_graph_finds_neighbours():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    kernel = Plain("l2", 8, 1)
    graph = LocalGraph(x, kernel, 8, 60, 3)
    found = 0
    for q in x[:50] + 0.05:
        exact = np.argsort(kernel.routing(q[None], x)[0], kind="stable")[:10]
        got = graph.search(q, 10, 64)
        assert [d for d, _ in got] == sorted(d for d, _ in got) and len(got) == 10
        found += len({i for _, i in got} & set(exact.tolist()))
    assert found >= 480
    assert len(graph.search(x[0], 600, 64)) == 600 and graph.search(x[0], 1, 1)[0][1] == 0
    assert LocalGraph(x, kernel, 8, 60, 3).links == graph.links


def test_traversal_by_graph():
    topology, kernel = two_trees(), Plain("l2", 1, 1)
    topology.build_graphs(kernel, 2, 8, 7, least=2)
    q = np.zeros(1, np.float32)
    assert traverse(topology, kernel, q, [0, 1], 2, 100, ef=4).leaves == traverse(topology, kernel, q, [0, 1], 2, 100).leaves


def test_a_walk_that_may_hold_all_it_reaches_equals_scoring_these():
    x = np.random.default_rng(6).normal(size=(300, 6)).astype(np.float32)
    for metric in ("l2", "cosine"):
        graph, walks = LocalGraph(x, Plain(metric, 6, 1), 4, 30, 3), []
        assert 40 < len(graph.reached) and graph.core[graph.entry]
        real = graph._nearest
        graph._nearest = lambda q, start, ef, level: walks.append(level) or real(q, start, ef, level)
        for q in x[:10] + 0.1:
            at_once = graph.search(q, 40, 300)
            assert 0 not in walks
            walked = real(q.astype(float), [graph.entry], 300, 0)[:40]
            assert [i for _, i in at_once] == [i for _, i in walked] and np.allclose([d for d, _ in at_once], [d for d, _ in walked])


def test_graphs_built_by_tasks_are_those_of_the_driver(spark):
    one, many = two_trees(), two_trees()
    one.build_graphs(Plain("l2", 1, 1), 2, 8, 7, least=2)
    many.build_graphs(Plain("l2", 1, 1), 2, 8, 7, least=2, context=spark.sparkContext)
    assert len(many.graphs) == 2 and {k: repr(g.parts) for k, g in many.graphs.items()} == {k: repr(g.parts) for k, g in one.graphs.items()}
