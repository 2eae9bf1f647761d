"""Searches that visit many leaves: bits and blocks give what a row per query and leaf, or per query and entry, would."""

import numpy as np
import pytest

from tests.test_numeric import Plain, two_trees
from vecgrove.config import Field, IndexConfig, SearchOptions
from vecgrove.functions.predicate import Compare
from vecgrove.functions.rabitq import Codes, Queries, Query, encode
from vecgrove.index import Runtime
from vecgrove.operators import recall, search
from vecgrove.plans.traverse import NO_BOUND, everything, traverse


def test_full_visits_are_known_without_walks():
    kernel, q, matches = Plain("l2", 1, 1), np.zeros(1, np.float32), {(0, 5): 1, (1, 2): 3}
    for beam, budget, m in ((4, 10, None), (NO_BOUND, NO_BOUND, None), (2, 10, matches)):
        each, at_once = traverse(two_trees(), kernel, q, [0, 1], beam, budget, m), everything(two_trees(), [0, 1], beam, budget, m)
        assert sorted(each.leaves) == sorted(at_once.leaves) and (each.partitions, each.exhausted) == (at_once.partitions, at_once.exhausted)
    assert [everything(two_trees(), [0, 1], *x) for x in ((3, 10, None), (4, 9, None), (1, 10, matches))] == [None] * 3


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
def test_many_code_queries_have_the_bits_of_one(metric):
    x = np.random.default_rng(1).normal(size=(70, 33)).astype(np.float32)
    x[3] = 0
    c, many = encode(x), Queries(x[:20], metric)
    for i, q in enumerate(x[:20]):
        one = Query(q, metric).rough(c)
        assert all(np.array_equal(a, b[i]) for a, b in zip(one, many.bounds(c, slice(0, 20)), strict=True))
        assert all(np.array_equal(a, b) for a, b in zip(one, many.pairs(c, np.full(70, i), np.arange(70)), strict=True))
        assert np.array_equal(one[0], many.rough(Codes(c.code, c.scale, c.norm_sq, c.err), slice(i, i + 1))[0])


def test_visits_and_pools_of_narrow_and_unbounded_searches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(search, "CHUNK", 60)
    x = np.random.default_rng(5).normal(size=(400, 8)).astype(np.float32)
    data = spark.createDataFrame([(f"r{i:03d}", v.tolist(), i % 2, None if i % 5 == 3 else i + 0.5) for i, v in enumerate(x)], "id string, vector array<float>, bucket long, score double")
    config = IndexConfig(8, "l2", (Field("bucket", "i64"), Field("score", "f64", True)), ("bucket",), leaf_min=2, leaf_max=6, internal_min=2, internal_max=6)
    index = Runtime(spark, f"file://{tmp_path}").create_index("wide", config, data)
    q = data.limit(9).selectExpr("id as qid", "vector")
    entries = {(r["tree_id"], r["leaf_id"], r["id"]): r for r in index.snapshot().table("leaf_entries").collect()}
    prepared = search.kernel_of(config).prepare(x[:9])
    for predicate, passes, options in (
        (None, lambda r: True, SearchOptions(k=3, leaf_beam=None, partitions=None)),
        (None, lambda r: True, SearchOptions(k=3, leaf_beam=2, rerank=7)),
        (Compare("score", "gt", 150.0), lambda r: (r["score"] or 0) > 150, SearchOptions(k=3, leaf_beam=None, partitions=None)),
    ):
        out = index.search(q, predicate, options)
        pool, visits = {}, {}
        for r in out.visited.collect():
            visits.setdefault(r["qid"], set()).add((r["tree_id"], r["leaf_id"], r["leaf_class"]))
        for r in out.pool.collect():
            pool.setdefault(r["qid"], {})[r["id"]] = (r["rough"], r["lower"], r["upper"])
        usage = {r["qid"]: r for r in out.usage.collect()}
        for i in range(9):
            may = {v[:2] for v in visits[f"r{i:03d}"] if v[2] != "NoMatch"}
            own = [r for (t, p, _), r in entries.items() if (t, p) in may and passes(r)]
            code = Codes(np.stack([np.frombuffer(r["code"], np.int8) for r in own]), *(np.array([r[c] for r in own], t) for c, t in (("scale", np.float32), ("norm_sq", np.int32), ("err", np.float32))))
            bounds = np.stack(Query(prepared[i], "l2").rough(code), axis=1)
            best = sorted(range(len(own)), key=lambda j: (bounds[j, 0], own[j]["id"]))[: options.pool]
            assert pool[f"r{i:03d}"] == {own[j]["id"]: tuple(bounds[j].tolist()) for j in best}
            told = usage[f"r{i:03d}"]
            assert told["rerank_exhausted"] == (len(own) > options.pool) and told["visited_leaf_entries"] == sum((t, p) in may for t, p, _ in entries)
        if options.leaf_beam is None:
            truth = search.exact_knn(data, q, "l2", 3, predicate, config)
            assert sorted(map(tuple, out.hits.collect())) == sorted(map(tuple, truth.collect()))
            found = recall.coverage(truth, index.snapshot().table("leaf_entries"), out.visited, out.pool)
            assert {tuple(r)[1:] for r in found.collect()} == {(3, 3, 3, 3)}
