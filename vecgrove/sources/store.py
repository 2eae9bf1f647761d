"""Versioned snapshots of Parquet tables under a folder of any Hadoop file system.

A version is a commit file that names the parts of each table.  It is created exclusively, so of two writers of one
version one fails and retries.  Readers take the highest version committed and see it unchanged until it expires.  A
table that a commit doesn't touch keeps its parts.  The large tables (``records``, ``leaf_entries``) are cut into shards:
a commit may replace some of them, and then adds a part with these alone.
"""

from __future__ import annotations

import json
import random
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vecgrove.config import IndexConfig
from vecgrove.errors import IndexError_, require

TABLES = ("records", "payloads", "trees", "partitions", "leaf_entries", "synopses")
SHARDED = ("records", "leaf_entries")


@dataclass
class Shards:
    """Rows that replace all rows of these shards of a table."""

    rows: DataFrame
    shards: list[int]


class Files:
    """The few file operations that the store needs, through Spark's own file systems."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = root

    def _path(self, name: str):
        path = self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.conf), path

    def exists(self, name: str) -> bool:
        fs, path = self._path(name)
        return fs.exists(path)

    def names(self, name: str = "") -> list[str]:
        fs, path = self._path(name)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def create(self, name: str, text: str, overwrite: bool = False) -> bool:
        """False if it exists and may not be overwritten."""
        fs, path = self._path(name)
        try:
            out = fs.create(path, overwrite)
        except Exception as e:
            if "exist" in str(e).lower():
                return False
            raise
        try:
            out.write(text.encode())
        finally:
            out.close()
        return True

    def read(self, name: str) -> str:
        fs, path = self._path(name)
        stream = fs.open(path)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str = "") -> None:
        fs, path = self._path(name)
        fs.delete(path, True)


class Snapshot:
    def __init__(self, spark: SparkSession, root: str, version: int, manifest: dict):
        self.spark, self.root, self.version, self.manifest = spark, root, version, manifest

    def has(self, name: str) -> bool:
        return name in self.manifest["tables"]

    @property
    def shards(self) -> int:
        return self.manifest["shards"]

    def table(self, name: str, shards: Iterable[int] | None = None) -> DataFrame:
        """A table or, of a sharded one, the rows of some shards: only their folders are read."""
        require(name in TABLES, "table")
        own = self.manifest["tables"][name]
        schema = StructType.fromJson(own["schema"])
        wanted = None if shards is None else sorted(set(shards))
        frames = []
        for part in own["parts"]:
            df = self.spark.read.schema(schema).parquet(f"{self.root}/{part['path']}")
            if part["without"]:
                df = df.filter(~F.col("shard").isin(part["without"]))
            frames.append(df if wanted is None else df.filter(F.col("shard").isin(wanted)))
        return reduce(DataFrame.unionByName, frames)


class Store:
    """Indexes of one root folder."""

    def __init__(self, spark: SparkSession, root: str, attempts: int = 8):
        self.spark, self.root, self.attempts = spark, root.rstrip("/"), attempts

    def files(self, name: str) -> Files:
        require(1 <= len(name.encode()) <= 255 and "/" not in name, "index name")
        return Files(self.spark, f"{self.root}/{name}")

    def create(self, name: str, config: IndexConfig) -> None:
        """Does nothing if the index exists with this very configuration."""
        files = self.files(name)
        manifest = json.dumps({"format": 1, "config": config.to_json()}, sort_keys=True)
        if not files.create("manifest.json", manifest) and files.read("manifest.json") != manifest:
            raise IndexError_("IndexAlreadyExists")

    def open(self, name: str) -> IndexConfig:
        files = self.files(name)
        if files.exists("DROPPING"):
            raise IndexError_("IndexDropping")
        if not files.exists("manifest.json"):
            raise IndexError_("IndexNotFound")
        manifest = json.loads(files.read("manifest.json"))
        if manifest.get("format") != 1:
            raise IndexError_("UnsupportedFormat")
        return IndexConfig.from_json(manifest["config"])

    def drop(self, name: str) -> None:
        files = self.files(name)
        if files.exists(""):
            files.create("DROPPING", "", overwrite=True)
            files.delete()

    def versions(self, name: str) -> list[int]:
        return sorted(int(f.removeprefix("commit-")) for f in self.files(name).names("commits") if f.startswith("commit-"))

    def snapshot(self, name: str, version: int | None = None) -> Snapshot:
        found = self.versions(name)
        if not found or (version is not None and version not in found):
            raise IndexError_("IndexBuilding")
        version = found[-1] if version is None else version
        return Snapshot(self.spark, f"{self.root}/{name}", version, json.loads(self.files(name).read(f"commits/commit-{version}")))

    def write(self, root: str, folder: str, tables: dict[str, DataFrame | Shards], old: dict | None, shards: int) -> dict:
        """Writes tables to ``root/folder``; returns the manifest, in which what isn't written stays as it was."""
        kept = {} if old is None else old["tables"]
        out = dict(kept)
        for table, value in tables.items():
            rows = value.rows if isinstance(value, Shards) else value
            path, writer = f"{folder}/{table}", rows.write
            if table in SHARDED:
                by = [c for c in ("shard", "tree_id", "leaf_id", "id") if c in rows.columns]
                writer = rows.repartition("shard").sortWithinPartitions(*by).write.partitionBy("shard")
            writer.parquet(f"{root}/{path}")
            parts = [{"path": path, "without": []}]
            if isinstance(value, Shards) and table in kept:
                parts = [{"path": p["path"], "without": sorted({*p["without"], *value.shards})} for p in kept[table]["parts"]] + parts
            out[table] = {"schema": rows.schema.jsonValue(), "parts": parts}
        return {"shards": shards, "tables": out}

    def commit(self, name: str, make: Callable[[Snapshot | None], dict[str, DataFrame | Shards]], shards: int | None = None) -> Snapshot:
        """Writes what ``make`` derives from the newest snapshot; a table left out keeps its parts.

        If another writer commits first, all is done again from the new state, after a pause that grows.
        """
        files, root = self.files(name), f"{self.root}/{name}"
        for attempt in range(self.attempts):
            before = self.versions(name)
            old = self.snapshot(name, before[-1]) if before else None
            version = (before[-1] if before else 0) + 1
            folder = f"data/{version}-{uuid.uuid4().hex}"
            try:
                manifest = self.write(root, folder, make(old), old.manifest if old else None, shards or (old.shards if old else 1))
            except Exception:
                files.delete(folder)
                raise
            if files.create(f"commits/commit-{version}", json.dumps(manifest)):
                return Snapshot(self.spark, root, version, manifest)
            files.delete(folder)  # another writer has this version
            time.sleep(random.uniform(0, 0.05 * 2**attempt))
        raise IndexError_("ContentionExhausted")

    def expire(self, name: str, keep: int = 2) -> list[int]:
        """Forgets all but the newest versions and deletes the parts that none of these names; returns what is forgotten.

        A part of a commit under way belongs to a newer version than the newest and stays.
        """
        files, versions = self.files(name), self.versions(name)
        gone, stay = versions[:-keep], versions[-keep:]
        if not gone:
            return []
        used = {p["path"] for v in stay for t in self.snapshot(name, v).manifest["tables"].values() for p in t["parts"]}
        for v in gone:
            files.delete(f"commits/commit-{v}")
        for folder in files.names("data"):
            if int(folder.split("-")[0]) <= stay[-1]:
                for table in files.names(f"data/{folder}"):
                    if f"data/{folder}/{table}" not in used:
                        files.delete(f"data/{folder}/{table}")
                if not files.names(f"data/{folder}"):
                    files.delete(f"data/{folder}")
        return gone
