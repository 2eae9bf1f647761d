import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from vecgrove.config import Field, IndexConfig, SearchOptions
from vecgrove.control import Control
from vecgrove.errors import IndexError_
from vecgrove.functions.predicate import Compare, IsNull
from vecgrove.index import Runtime
from vecgrove.operators import build, recall, search
from vecgrove.sources.store import Snapshot
from vecgrove.streaming.ingest import ingest

FIELDS = (Field("bucket", "i64"), Field("score", "f64", True))
CONFIG = IndexConfig(8, "l2", FIELDS, ("bucket",), leaf_min=4, leaf_max=12, internal_min=2, internal_max=6)


def rows(spark, n, seed=1, d=8):
    x = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return spark.createDataFrame([(i, x[i].tolist(), i % 3, None if i % 7 == 3 else i + 0.5) for i in range(n)], "id long, vector array<float>, bucket long, score double")


def truth(index, queries, k=10, predicate=None):
    r = index.snapshot().table("records")
    return search.exact_knn(r, queries, index.config.metric, k, predicate, index.config)


def same(a, b):
    key = lambda df: sorted((r["qid"], r["position"], r["id"], round(r["distance"], 9)) for r in df.collect())
    return key(a) == key(b)


WIDE = SearchOptions(k=10, leaf_beam=1000)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    return "file://" + str(tmp_path_factory.mktemp("store"))


@pytest.mark.parametrize("metric", ["cosine", "inner_product"])
def test_wide_search_is_exact_and_reports_its_work(spark, root, metric):
    data = rows(spark, 240)
    index = Runtime(spark, root).create_index(f"wide-{metric}", CONFIG.with_(metric=metric), data)
    q = data.filter("id < 20").selectExpr("id as qid", "vector")
    out = index.search(q, None, WIDE)
    assert same(out.hits, truth(index, q))
    usage = out.usage.collect()
    assert all(u["scanned_tree_keys"] == 3 and u["visited_leaf_entries"] == 240 and u["rerank_exhausted"] and not u["partitions_exhausted"] for u in usage)
    p = IsNull("score")
    assert same(index.search(q, p, WIDE).hits, truth(index, q, predicate=p))
    one_tree = index.search(q, Compare("bucket", "eq", 2), WIDE)
    assert {u["scanned_tree_keys"] for u in one_tree.usage.collect()} == {1}
    assert recall.summary(recall.per_query(truth(index, q), index.search(q, None, SearchOptions(leaf_beam=4)).hits)).first()["mean_recall"] > 0.5
    found = index.verify()
    assert found["issues"] == [] and found["complete"]


def test_narrow_search_is_exact_within_what_it_visits(spark, root):
    data = rows(spark, 240)
    index = Runtime(spark, root).create_index("narrow", CONFIG, data)
    q = data.filter("id < 12").selectExpr("id as qid", "vector")
    for predicate, where in ((None, "true"), (Compare("score", "gt", 60.0), "score > 60")):
        out = index.search(q, predicate, SearchOptions(k=4, leaf_beam=1, rerank=500))
        seen = index.snapshot().table("records").join(out.visited.select("qid", "tree_id", "leaf_id"), ["tree_id", "leaf_id"]).join(q.selectExpr("qid", "vector as q"), "qid").collect()
        wanted, passed = {}, {}
        for r in seen:
            passed[r["qid"]] = passed.get(r["qid"], 0) + 1
            if where == "true" or (r["score"] or 0) > 60:
                d = float(np.linalg.norm(np.array(r["vector"], np.float64) - np.array(r["q"], np.float64)))
                wanted.setdefault(r["qid"], []).append((round(d, 6), r["id"]))
        got = {}
        for r in out.hits.orderBy("qid", "position").collect():
            got.setdefault(r["qid"], []).append((round(r["distance"], 6), r["id"]))
        assert got == {k: sorted(v)[:4] for k, v in wanted.items()}
        usage = {r["qid"]: r for r in out.usage.collect()}
        assert all(u["scanned_tree_keys"] == 3 and 0 < u["visited_partitions"] <= 240 for u in usage.values())
        if predicate is None:
            assert {k: u["visited_leaf_entries"] for k, u in usage.items()} == passed


def test_mutations_upkeep_and_refinement_against_a_dictionary(spark, root):
    data = rows(spark, 120)
    index = Runtime(spark, root).create_index("model", CONFIG, data)
    model = {r["id"]: r for r in data.collect()}
    schema = "pos long, op string, id long, vector array<float>, bucket long, score double"
    rng = np.random.default_rng(5)
    for _ in range(2):
        batch = []
        for pos, i in enumerate(rng.permutation(300)[:80].tolist()):
            op = "delete" if i % 4 == 0 else "upsert" if i % 4 < 3 else "insert" if i not in model else "upsert"
            batch.append((pos, op, i, rng.normal(size=8).astype(np.float32).tolist(), i % 4, None))
        said = index.batch_mutate(spark.createDataFrame(batch, schema)).select("pos", "outcome").collect()
        for (pos, outcome), row in zip(said, batch, strict=True):
            expected = {"insert": "Inserted", "upsert": "Replaced" if row[2] in model else "Created", "delete": "Deleted" if row[2] in model else "Missing"}[row[1]]
            assert (pos, outcome) == (row[0], expected)
            model.pop(row[2], None) if row[1] == "delete" else model.__setitem__(row[2], row)
        index.maintain()
    index.refine()
    assert index.verify()["issues"] == []
    stored = {r["id"]: r["bucket"] for r in index.snapshot().table("records").collect()}
    assert stored.keys() == model.keys()
    q = data.filter("id < 10").selectExpr("id as qid", "vector")
    assert same(index.search(q, None, WIDE).hits, truth(index, q))
    with pytest.raises(IndexError_) as e:
        index.batch_mutate(spark.createDataFrame([(0, "insert", next(iter(model)), [0.0] * 8, 1, None)], schema))
    assert e.value.kind == "RecordAlreadyExists" and e.value.position == 0
    with pytest.raises(IndexError_):
        index.batch_mutate(spark.createDataFrame([(0, "upsert", 1, [0.0] * 8, 1, None), (1, "delete", 1, None, None, None)], schema))
    assert index.batch_mutate(spark.createDataFrame([], schema)).isEmpty()


def test_lifecycle(spark, root):
    runtime = Runtime(spark, root)
    runtime.create_index("life", CONFIG)
    runtime.create_index("life", CONFIG)
    for make, kind in (
        (lambda: runtime.create_index("life", CONFIG.with_(leaf_max=16)), "IndexAlreadyExists"),
        (lambda: runtime.open_index("nowhere"), "IndexNotFound"),
        (lambda: runtime.open_index("life").snapshot(), "IndexBuilding"),
    ):
        with pytest.raises(IndexError_) as e:
            make()
        assert e.value.kind == kind
    assert runtime.open_index("life").config == CONFIG
    runtime.drop_index("life")
    runtime.drop_index("life")
    with pytest.raises(IndexError_):
        runtime.open_index("life")


def test_get_keeps_order_and_tells_payloads_apart(spark, root):
    data = rows(spark, 30).selectExpr("*", "case when id % 3 = 0 then null when id % 3 = 1 then cast('' as binary) else cast('p' as binary) end as payload")
    index = Runtime(spark, root).create_index("payloads", CONFIG, data)
    ids = spark.createDataFrame(list(enumerate([5, 3, 5, 99, 4])), "pos long, id long")
    got = index.get(ids, payload=True).select("id", "bucket", "payload_status", "payload").collect()
    assert [(r[0], r[1], r[2], None if r[3] is None else bytes(r[3])) for r in got] == [(5, 2, "Present", b"p"), (3, 0, "Absent", None), (5, 2, "Present", b"p"), (99, None, "Absent", None), (4, 1, "Present", b"")]


def test_bad_records_are_refused(spark):
    bad = [(None, [1.0] * 8), (1, [1.0] * 7), (1, [float("nan")] + [0.0] * 7), (1, None)]
    for id_, v in bad:
        df = spark.createDataFrame([(id_, v, 1, 1.0)], "id long, vector array<float>, bucket long, score double")
        with pytest.raises(Exception, match="invalid argument"):
            build.checked(df, CONFIG).collect()


def test_a_large_tree_is_built_in_parts(spark, root):
    data = rows(spark, 600).selectExpr("id", "vector", "0L as bucket", "score")
    runtime = Runtime(spark, root)
    runtime.store.create("large", CONFIG)
    runtime.store.commit("large", lambda old: build.build(data, CONFIG, resident=200))
    index = runtime.open_index("large")
    assert index.verify()["issues"] == []
    # So small that leaves, too, get parents in parts.
    runtime.store.create("larger", CONFIG)
    runtime.store.commit("larger", lambda old: build.build(data, CONFIG, resident=30))
    larger = runtime.open_index("larger")
    found = larger.verify()
    assert found["issues"] == [] and found["topology"]["max_level"] >= 3
    q = data.filter("id < 10").selectExpr("id as qid", "vector")
    assert same(index.search(q, None, WIDE).hits, truth(index, q))
    assert same(larger.search(q, None, WIDE).hits, truth(larger, q))


def test_streaming_ingest(spark, root, tmp_path):
    index = Runtime(spark, root).create_index("stream", CONFIG, rows(spark, 40))
    schema = "op string, id long, vector array<float>, bucket long, score double, ts long, seq long"
    changes = [("upsert", i, [float(t)] * 8, 1, None, t, i) for t in range(3) for i in range(35, 45)] + [("delete", 36, None, None, None, 9, 0)]
    spark.createDataFrame(changes, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), lambda b: index.batch_mutate(b), str(tmp_path / "checkpoint")).awaitTermination(120)
    got = {r["id"]: r["vector"][0] for r in index.snapshot().table("records").filter("id >= 35").collect()}
    assert got == {i: 2.0 for i in range(35, 45) if i != 36}


def asked_for(monkeypatch):
    """The shards that each read of a sharded table names."""
    seen = []
    real = Snapshot.table

    def table(self, name, shards=None):
        if name in ("records", "leaf_entries"):
            seen.append((name, None if shards is None else sorted(set(shards))))
        return real(self, name, shards)

    monkeypatch.setattr(Snapshot, "table", table)
    return seen


def test_search_and_mutations_touch_their_shards_only(spark, root, monkeypatch):
    data = rows(spark, 600, d=8).selectExpr("id", "vector", "0L as bucket", "score")
    config = CONFIG.with_(shard_rows=60, leaf_max=8, internal_max=64)
    monkeypatch.setattr(build, "NEIGHBOURS", 4)
    index = Runtime(spark, root).create_index("sharded", config, data)
    before = index.snapshot()
    every = {r["shard"] for r in before.table("records").select("shard").distinct().collect()}
    assert before.shards == 10 and len(every) > 5 and index.verify()["issues"] == []
    q = data.filter("id = 7").selectExpr("id as qid", "vector")
    seen = asked_for(monkeypatch)
    out = index.search(q, None, SearchOptions(k=5, leaf_beam=2))
    assert len(out.hits.collect()) == 5 and all(s is not None and len(s) <= 2 for _, s in seen)
    scans = [x for x in out.hits._jdf.queryExecution().executedPlan().toString().split("\n") if "/data/1-" in x]
    assert scans and all(re.search(r"PartitionFilters: \[[^]]*shard", x) for x in scans)
    # A filter counts matches in open leaves alone, and gives what brute force gives.
    p = IsNull("score")
    wide = SearchOptions(k=5, leaf_beam=1000, partitions=16384)
    assert same(index.search(q, p, wide).hits, truth(index, q, 5, p))
    seen.clear()
    index.upsert(id=7, vector=[0.5] * 8, bucket=0, score=None)
    now = index.snapshot()
    parts = now.manifest["tables"]["records"]["parts"]
    assert len(parts) == 2 and 1 <= len(parts[0]["without"]) <= 2 and parts[1]["without"] == []
    written = spark.read.parquet(f"{now.root}/{parts[1]['path']}").count()
    assert written < 200 and now.table("records").count() == 600 and before.table("records").count() == 600
    assert now.manifest["tables"]["payloads" if now.has("payloads") else "trees"] and index.verify()["issues"] == []
    assert same(index.search(q, None, wide).hits, truth(index, q, 5))
    index.delete(7)
    assert index.expire(keep=1) == [1, 2] and index.snapshot().table("records").count() == 599
    with pytest.raises(Exception):  # noqa: B017
        before.table("trees").count()


def test_inner_partitions_split_merge_and_collapse(spark, root):
    config = CONFIG.with_(tree_key=(), leaf_min=2, leaf_max=4, internal_min=2, internal_max=4)
    index = Runtime(spark, root).create_index("levels", config, rows(spark, 8))
    schema = "pos long, op string, id long, vector array<float>, bucket long, score double"
    x = np.random.default_rng(3).normal(size=(48, 8)).astype(np.float32)
    index.batch_mutate(spark.createDataFrame([(i, "upsert", 100 + i, x[i].tolist(), 1, None) for i in range(48)], schema))
    assert index.maintain() > 0
    tall = index.snapshot().table("partitions")
    assert index.actionable().count() == 0 and tall.agg({"level": "max"}).first()[0] >= 3 and index.verify()["issues"] == []
    q = rows(spark, 8).selectExpr("id as qid", "vector")
    assert same(index.search(q, None, SearchOptions(k=10, leaf_beam=1000, partitions=16384)).hits, truth(index, q))
    index.batch_mutate(spark.createDataFrame([(i, "delete", 100 + i, None, None, None) for i in range(46)], schema))
    index.maintain()
    assert index.actionable().count() == 0 and index.verify()["issues"] == [] and index.snapshot().table("records").count() == 10
    assert same(index.search(q, None, WIDE).hits, truth(index, q))
    index.batch_mutate(spark.createDataFrame([(i, "delete", i, None, None, None) for i in range(8)], schema))
    index.maintain()
    assert index.actionable().count() == 0 and index.verify()["issues"] == []


def test_graph_routing_walks_and_finds(spark, root):
    config = IndexConfig(8, "l2", FIELDS, (), leaf_min=2, leaf_max=4, internal_min=2, internal_max=16384)
    index = Runtime(spark, root).create_index("graph", config, rows(spark, 400))
    q = rows(spark, 20).selectExpr("id as qid", "vector")
    out = index.search(q, None, SearchOptions(k=5, leaf_beam=40, routing="hnsw", ef=80))
    assert all(r["graph_walks"] == 1 for r in out.usage.collect())
    assert recall.summary(recall.per_query(truth(index, q, 5), out.hits)).first()["mean_recall"] >= 0.9


def test_verification_finds_damage(spark, root):
    index = Runtime(spark, root).create_index("damage", CONFIG, rows(spark, 60).selectExpr("*", "cast('p' as binary) as payload"))
    store, sound = index.runtime.store, index.snapshot()
    assert index.verify()["issues"] == []
    broken = sound.table("leaf_entries").withColumn("code", F.when(F.col("id") == 5, F.lit(bytes(8))).when(F.col("id") == 6, F.lit(b"short")).otherwise(F.col("code")))
    broken = broken.withColumn("scale", F.when(F.col("id") == 8, F.col("scale") * 2).otherwise(F.col("scale")))
    store.commit("damage", lambda old: {"leaf_entries": broken, "payloads": old.table("payloads").unionByName(old.table("payloads").limit(1).withColumn("id", F.lit(999).cast("long")))})
    assert sorted(index.verify()["issues"]) == [("Membership", "999"), *(("RecordProjectionMismatch", str(i)) for i in (5, 6, 8))]
    # An entry whose record is elsewhere, and an id in two leaves, stop a search.
    moved = sound.table("leaf_entries").withColumn("id", F.when(F.col("id") == 5, F.lit(777)).otherwise(F.col("id")).cast("long"))
    store.commit("damage", lambda old: {"leaf_entries": moved})
    q = rows(spark, 6).selectExpr("id as qid", "vector")
    with pytest.raises(Exception, match="without its record"):
        index.search(q, None, WIDE).hits.collect()
    twice = sound.table("leaf_entries").unionByName(sound.table("leaf_entries").filter("id = 5"))
    store.commit("damage", lambda old: {"leaf_entries": twice})
    with pytest.raises(IndexError_) as e:
        index.search(q, None, WIDE)
    assert e.value.kind == "Corruption"


def test_get_without_payloads_and_operations_under_a_control(spark, root):
    index = Runtime(spark, root).create_index("plain", CONFIG, rows(spark, 30))
    assert [r["payload_status"] for r in index.get(spark.createDataFrame([(0, 3), (1, 99)], "pos long, id long"), payload=True).collect()] == ["Absent", "Absent"]
    control = Control(spark)
    assert index.under(control).verify()["issues"] == []
    control.cancel()
    with pytest.raises(IndexError_) as e:
        index.under(control).maintain()
    assert e.value.kind == "Cancelled"


def test_a_commit_that_comes_second_is_derived_anew(spark, root):
    index = Runtime(spark, root).create_index("race", CONFIG, rows(spark, 30))
    other, schema = Runtime(spark, root).open_index("race"), "pos long, op string, id long, vector array<float>, bucket long, score double"
    real, first = index.runtime.store.write, []

    def write(*args):
        if not first:
            first.append(other.upsert(id=500, vector=[1.0] * 8, bucket=0, score=None))
        return real(*args)

    index.runtime.store.write = write
    said = index.batch_mutate(spark.createDataFrame([(0, "upsert", 500, [2.0] * 8, 0, None)], schema)).collect()
    assert first == ["Created"] and [r["outcome"] for r in said] == ["Replaced"] and index.snapshot().version == 3
    assert index.snapshot().table("records").filter("id = 500").first()["vector"] == [2.0] * 8
