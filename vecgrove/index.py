"""The public surface: open or create an index in a store, search it, change it, look after it."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecgrove.config import IndexConfig, RefineOptions, SearchOptions, VerifyOptions
from vecgrove.control import Control
from vecgrove.functions.predicate import Predicate
from vecgrove.operators import build, maintain, mutate, refine, search, verify
from vecgrove.sources.scratch import keep
from vecgrove.sources.store import Snapshot, Store


class Runtime:
    """A store bound to a session."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def create_index(self, name: str, config: IndexConfig, records: DataFrame | None = None) -> Index:
        self.store.create(name, config)
        index = Index(self, name, config)
        if records is not None and not self.store.versions(name):
            shards = build.shards_for(records, config)
            self.store.commit(name, lambda old: build.build(records, config, shards=shards), shards)
        return index

    def open_index(self, name: str) -> Index:
        return Index(self, name, self.store.open(name))

    def drop_index(self, name: str) -> None:
        self.store.drop(name)


def _controlled(operation):
    """Under the index's control, if it has one: jobs end at the deadline or when cancelled."""

    @functools.wraps(operation)
    def run(self: Index, *args, **named):
        if self.control is None:
            return operation(self, *args, **named)
        return self.control.run(lambda: operation(self, *args, **named))

    return run


class Index:
    def __init__(self, runtime: Runtime, name: str, config: IndexConfig, control: Control | None = None):
        self.runtime, self.name, self.config, self.control = runtime, name, config, control

    def under(self, control: Control) -> Index:
        """The same index, whose operations obey ``control``."""
        return Index(self.runtime, self.name, self.config, control)

    def __repr__(self) -> str:
        return f"Index(dimension={self.config.dimension}, metric={self.config.metric})"

    def snapshot(self) -> Snapshot:
        return self.runtime.store.snapshot(self.name)

    @_controlled
    def search(self, queries: DataFrame, predicate: Predicate | None = None, options: SearchOptions = SearchOptions()) -> search.Outcome:
        return search.search(self.snapshot(), self.config, queries, predicate, options)

    def search_one(self, vector: list[float], predicate: Predicate | None = None, options: SearchOptions = SearchOptions()) -> search.Outcome:
        one = self.runtime.spark.createDataFrame([(0, [float(x) for x in vector])], "qid long, vector array<float>")
        return self.search(one, predicate, options)

    def get(self, ids: DataFrame, payload: bool = False) -> DataFrame:
        return search.get(self.snapshot(), ids, payload)

    @_controlled
    def batch_mutate(self, batch: DataFrame) -> DataFrame:
        """Applies all or nothing; pos, id and outcome of each, as they were in the commit that counts."""
        said: list[DataFrame] = []

        def make(old: Snapshot) -> dict:
            said[:] = [keep(mutate.outcomes(batch, old.table("records")), "outcomes")]
            return mutate.apply(old, batch, self.config)

        if batch.isEmpty():
            return mutate.outcomes(batch, self.snapshot().table("records"))
        self.runtime.store.commit(self.name, make)
        return said[0].orderBy("pos")

    def _single(self, op: str, row: dict) -> str:
        fields = ", ".join(f"`{f.name}` {f.sql_type}" for f in self.config.fields)
        id_type = self.snapshot().table("records").schema["id"].dataType.simpleString()
        schema = f"pos long, op string, id {id_type}, vector array<float>" + (f", {fields}" if fields else "") + ", payload binary"
        values = [0, op, row["id"], row.get("vector"), *[row.get(f.name) for f in self.config.fields], row.get("payload")]
        return self.batch_mutate(self.runtime.spark.createDataFrame([tuple(values)], schema)).first()["outcome"]

    def insert(self, **row) -> str:
        return self._single("insert", row)

    def upsert(self, **row) -> str:
        return self._single("upsert", row)

    def delete(self, id) -> bool:
        return self._single("delete", {"id": id}) == "Deleted"

    @_controlled
    def maintain(self, waves: int = 64) -> int:
        """Splits and merges on every level until nothing is actionable; returns the waves run."""
        for wave in range(waves):
            before = self.snapshot()
            step = maintain.next_wave(before, self.config)
            if step is None:
                return wave
            state = before.table("partitions").agg(F.count("*"), F.sum("entry_count")).first()
            after = self.runtime.store.commit(self.name, lambda old, step=step: step(old, self.config))
            if step in (maintain.merge_leaves, maintain.merge_inner) and after.table("partitions").agg(F.count("*"), F.sum("entry_count")).first() == state:
                return wave + 1
        return waves

    def expire(self, keep: int = 2) -> list[int]:
        """Forgets old versions and what only they hold."""
        return self.runtime.store.expire(self.name, keep)

    @_controlled
    def refine(self, options: RefineOptions = RefineOptions()) -> None:
        self.runtime.store.commit(self.name, lambda old: refine.refine(old, self.config, options))

    @_controlled
    def verify(self, options: VerifyOptions = VerifyOptions()) -> dict:
        return verify.report(self.snapshot(), self.config, options)

    def actionable(self) -> DataFrame:
        return maintain.actionable(self.snapshot().table("partitions"), self.config)

    def fingerprint(self) -> str:
        """Of the leaf layout: equal layouts have equal fingerprints."""
        rows = self.snapshot().table("leaf_entries").select(F.xxhash64("tree_id", "leaf_id", "id").alias("h")).agg(F.sum(F.col("h").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n")).first()
        return f"{rows['s']}-{rows['n']}"
