"""Resumable bulk builds: capture the input, construct, load a hidden version, check it, publish it.

A job's folder holds what each stage wrote and a marker once it is whole, so any process can take a job up where
another left it.  Nothing is visible to readers until ``publish``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.config import IndexConfig
from vecgrove.errors import IndexError_, require
from vecgrove.operators import build, verify
from vecgrove.sources.store import Files, Snapshot, Store

STAGES = ("captured", "constructed", "checked", "published")


def digest(df: DataFrame) -> str:
    """An order-free checksum of a frame's rows, with their number."""
    columns = [F.col(f"`{c}`") for c in sorted(df.columns)]
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias("x")).first()
    return f"{row['n']}:{row['s'] or 0}:{row['x'] or 0}"


class BulkBuildJob:
    def __init__(self, store: Store, name: str, job: str):
        self.store, self.name, self.job = store, name, job
        self.files = Files(store.spark, f"{store.root}/{name}/jobs/{job}")

    @staticmethod
    def start(store: Store, name: str, job: str, config: IndexConfig, records: DataFrame) -> BulkBuildJob:
        """Captures the records; does nothing more if the job has them already."""
        store.create(name, config)
        own = BulkBuildJob(store, name, job)
        if not own.done("captured"):
            own.files.delete("input")
            records.write.parquet(f"{own.files.root}/input")
            own._mark("captured", {"digest": digest(own._input())})
        return own

    def _input(self) -> DataFrame:
        return self.store.spark.read.parquet(f"{self.files.root}/input")

    def done(self, stage: str) -> bool:
        return self.files.exists(stage)

    def _mark(self, stage: str, what: dict | None = None) -> None:
        self.files.create(stage, json.dumps(what or {}), overwrite=True)

    def status(self) -> str:
        if self.files.exists("aborted"):
            return "aborted"
        return next((s for s in reversed(STAGES) if self.done(s)), "none")

    def run(self) -> None:
        """The stages that are left up to ``checked``."""
        if self.status() == "aborted":
            raise IndexError_("BulkBuildSuperseded")
        require(self.done("captured"), "no input")
        config = self.store.open(self.name)
        if not self.done("constructed"):
            if json.loads(self.files.read("captured"))["digest"] != digest(self._input()):
                raise IndexError_("Corruption")
            # Under a name of its own: another runner may be at the same stage.
            shards, folder = build.shards_for(self._input(), config), f"built-{uuid.uuid4().hex}"
            manifest = self.store.write(self.files.root, folder, build.build(self._input(), config, shards=shards), None, shards)
            made = Snapshot(self.store.spark, self.files.root, 1, manifest)
            self._mark("constructed", {"manifest": manifest, "digests": {t: digest(made.table(t)) for t in manifest["tables"]}})
        if not self.done("checked"):
            if verify.issues(self.hidden(), config).limit(1).count():
                raise IndexError_("Corruption")
            self._mark("checked")

    def hidden(self) -> Snapshot:
        return Snapshot(self.store.spark, self.files.root, 1, json.loads(self.files.read("constructed"))["manifest"])

    def publish(self) -> None:
        """Commits the tables as the index's next version and holds them against what was constructed."""
        if self.done("published"):
            return
        if not self.done("checked"):
            raise IndexError_("BulkBuildBusy")
        wanted, hidden = json.loads(self.files.read("constructed"))["digests"], self.hidden()
        new = self.store.commit(self.name, lambda old: {t: hidden.table(t) for t in wanted}, hidden.shards)
        if any(digest(new.table(t)) != d for t, d in wanted.items()):
            raise IndexError_("Corruption")
        self._mark("published")

    def complete(self) -> None:
        self.run()
        self.publish()

    def abort(self) -> None:
        if self.done("published"):
            raise IndexError_("BulkBuildBusy")
        self._mark("aborted")

    def cleanup(self) -> None:
        """Removes what a published or aborted job no longer needs."""
        if self.status() not in ("published", "aborted"):
            raise IndexError_("BulkBuildBusy")
        for part in self.files.names():
            if part == "input" or part.startswith("built-"):
                self.files.delete(part)


def schedule(store: Store, name: str) -> list[str]:
    """Completes every job of an index that is neither published nor aborted; returns their names."""
    out = []
    for job in sorted(Files(store.spark, f"{store.root}/{name}").names("jobs")):
        own = BulkBuildJob(store, name, job)
        if own.status() not in ("published", "aborted", "none"):
            own.complete()
            out.append(job)
    return out
