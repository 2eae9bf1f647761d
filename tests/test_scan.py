"""Stated queries against all rows: the very rows of a join with all pairs, without such a join."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecgrove.functions import distance
from vecgrove.functions.rabitq import Query, encode
from vecgrove.operators import scan, search


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def tied(n, d=6, seed=4):
    """Few values, so that distances tie and vectors recur; norms differ."""
    rng = np.random.default_rng(seed)
    x = rng.integers(-1, 2, (n, d)).astype(np.float32) * rng.choice([0.5, 1, 3], (n, 1)).astype(np.float32)
    x[(x == 0).all(axis=1), 0] = 1
    return x


def frame(spark, x, key=lambda i: i, kind="long"):
    return spark.createDataFrame([(key(i), v.tolist()) for i, v in enumerate(x)], f"id {kind}, vector array<float>")


def by_pairs(r, q, metric, k):
    pairs = r.select("id", F.col("vector").alias("x")).crossJoin(q.select("qid", F.col("vector").alias("q")))
    out = search.top_k(pairs.select("qid", "id", distance.rank(metric, F.col("q"), F.col("x")).alias("rank")), k)
    return out.select("qid", "id", distance.exposed(metric, F.col("rank")).alias("distance"), "position")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[-1]))


@pytest.mark.parametrize("metric", ["l2", "cosine", "inner_product"])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_exact_search_gives_the_rows_of_all_pairs_without_such_a_join(spark, metric, kind, monkeypatch):
    monkeypatch.setattr(scan, "BEST", 7 * 11)  # four blocks of queries
    monkeypatch.setattr(scan, "TILE", 200)
    r = frame(spark, tied(300), (lambda i: f"r{i % 7}{i}") if kind == "string" else lambda i: i, kind)
    q = frame(spark, np.concatenate([tied(20, seed=9), tied(300)[:5]])).withColumnRenamed("id", "qid")
    got = search.exact_knn(r, q, metric, 11)
    assert "Join" not in plan(got)
    assert rows_of(got) == rows_of(by_pairs(r, q, metric, 11))


def test_odd_values_are_ordered_like_all_pairs_with_nulls_last(spark):
    x = tied(40).tolist()
    x[3][2], x[5][0], x[7] = float("nan"), float("inf"), None
    x[9][1] = None
    r = spark.createDataFrame(list(enumerate(x)), "id long, vector array<float>")
    q = spark.createDataFrame([(0, x[0]), (1, x[5]), (2, x[3]), (3, None), (4, x[1])], "qid long, vector array<float>")
    for k in (5, 40):
        got, want = (rows_of(f(r, q, "l2", k)) for f in (search.exact_knn, by_pairs))
        assert repr(got) == repr(want) and len(got) == 5 * k
    assert [r[1] for r in got if r[0] == 0][-2:] == [7, 9]


def test_a_task_hands_on_no_more_than_the_best_of_its_share(spark):
    r = frame(spark, tied(4000))
    q = r.filter("id < 60").selectExpr("id as qid", "vector")
    near = scan.nearest(r, q, "l2", 3)
    assert near.count() <= 60 * 3 * near.rdd.getNumPartitions() < 60 * 4000


def test_rough_ranks_and_intervals_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(scan, "TILE", 500)
    monkeypatch.setattr(scan, "HELD", 300)
    x = np.concatenate([tied(150, 16), np.random.default_rng(2).normal(size=(150, 16)).astype(np.float32)])
    r = frame(spark, x)
    q = r.filter("id % 20 = 0").selectExpr("id as qid", "vector")
    codes, k = encode(x), 5
    rough, left, cut = [], [], {}
    for i in range(0, 300, 20):
        value, low, high = Query(x[i], "l2").rough(codes)
        exact = distance.sequential_sum((x[i].astype(float) - x) ** 2)
        assert ((low <= exact) & (exact <= high)).all()
        rough += [(i, int(j), float(value[j])) for j in np.lexsort((np.arange(300), value))[:k]]
        left += [(i, int(j), float(low[j]), float(high[j]), float(exact[j])) for j in np.flatnonzero(low <= np.sort(high)[k - 1])]
        cut[i] = np.sort(high)[k - 1]
    got = search.top_k(scan.roughly_nearest(r, q, k), k)
    assert "Join" not in plan(got)
    assert sorted((r["qid"], r["id"], r["rank"]) for r in got.collect()) == sorted(rough)
    assert tuple(scan.inside(r, q).first()) == (15 * 300, 15 * 300)
    some = [tuple(r) for r in scan.not_excluded(r, q, k).collect()]
    assert sorted(r for r in some if r[2] <= cut[r[0]]) == sorted(left) and len(some) < 15 * 300


def test_intervals_that_do_not_hold_are_counted(spark, monkeypatch):
    monkeypatch.setattr(scan.CodeQueries, "bounds", lambda self, c, at: (None, np.full((len(self.a[at]), len(c.scale)), 0.5), np.full((len(self.a[at]), len(c.scale)), 2.0)))
    x = np.arange(6, dtype=np.float32).reshape(-1, 1)
    q = scan.Vectors.of(*(b for b in frame(spark, x[:2]).toArrow().columns))
    seen = {}
    monkeypatch.setattr(scan, "scan", lambda rows, queries, fields, work, held: seen.update(work=work) or spark.range(0).selectExpr("id as pairs", "id as inside"))
    scan.inside(None, None)
    rows = scan.Vectors.of(*(b for b in frame(spark, x).toArrow().columns))
    # Squared distances of 0 and 1 to 0..5: those of 1 alone lie within.
    assert [b.to_pydict() for b in seen["work"](q, iter([rows]))] == [{"pairs": [12], "inside": [3]}]
