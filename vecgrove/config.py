"""Index, search and maintenance settings with their limits."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, replace

from vecgrove.errors import require

TYPES = {"i64": "bigint", "f64": "double", "bool": "boolean", "string": "string"}
METRICS = ("l2", "inner_product", "cosine")

# Limits.
MAX_DIMENSION = 16384
MAX_FIELDS = 16
MAX_BLOOM_FIELDS = 4
MAX_NAME_BYTES = 255
MAX_STRING_BYTES = 1024
MAX_ID_BYTES = 256
MAX_PAYLOAD_BYTES = 65536
MAX_TREE_KEY_BYTES = 8192
MAX_SYNOPSIS_BYTES = 65536
MAX_PREDICATE_NODES = 1024
MAX_PREDICATE_DEPTH = 64
MAX_IN_VALUES = 1024
MAX_K = 65536
MAX_BEAM = 16384


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    nullable: bool = False
    bloom_bits: int = 0
    """Bits of the leaf synopsis's Bloom filter; zero for none."""

    def __post_init__(self):
        require(self.type in TYPES, "field type")
        require(1 <= len(self.name.encode()) <= MAX_NAME_BYTES, "field name")
        require(self.bloom_bits == 0 or 64 <= self.bloom_bits <= 1 << 16, "bloom bits")

    @property
    def sql_type(self) -> str:
        return TYPES[self.type]

    def worst_bytes(self) -> int:
        size = {"bool": 1, "i64": 8, "f64": 8, "string": MAX_STRING_BYTES + 2}[self.type]
        return 1 + 2 * size + self.bloom_bits // 8


@dataclass(frozen=True)
class IndexConfig:
    dimension: int
    metric: str = "l2"
    fields: tuple[Field, ...] = ()
    tree_key: tuple[str, ...] = ()
    leaf_min: int = 16
    leaf_max: int = 128
    internal_min: int = 64
    internal_max: int = 16384
    write_beam: int = 4
    key_ranges: int = 1024
    sample_items: int = 1024
    shard_rows: int = 200_000
    """Rows per shard of the tables at the build: what a search reads and a mutation rewrites at least."""
    seed: int = 7
    hnsw: tuple[int, int, int] | None = (16, 200, 7)
    """M, efConstruction and seed of partition-local graphs, which the ``hnsw`` routing uses."""

    def __post_init__(self):
        require(1 <= self.dimension <= MAX_DIMENSION, "dimension")
        require(self.metric in METRICS, "metric")
        require(len(self.fields) <= MAX_FIELDS, "fields")
        names = [f.name for f in self.fields]
        require(len(set(names)) == len(names), "duplicate field names")
        require(sum(f.bloom_bits > 0 for f in self.fields) <= MAX_BLOOM_FIELDS, "bloom fields")
        require(sum(f.worst_bytes() for f in self.fields) <= MAX_SYNOPSIS_BYTES, "synopsis size")
        require(len(set(self.tree_key)) == len(self.tree_key), "duplicate tree key fields")
        require(all(k in names and not self.field(k).nullable for k in self.tree_key), "tree key fields")
        size = {"bool": 1, "i64": 8, "f64": 8, "string": 2 * MAX_STRING_BYTES + 2}
        require(sum(size[self.field(k).type] for k in self.tree_key) <= MAX_TREE_KEY_BYTES, "tree key size")
        require(self.leaf_min >= 1 and 2 * self.leaf_min <= self.leaf_max <= 65536, "leaf capacity")
        require(1 <= self.internal_min <= 128 and 2 * self.internal_min <= self.internal_max <= 16384, "internal capacity")
        require(1 <= self.write_beam <= MAX_BEAM, "write beam")
        require(self.sample_items >= 2, "sample")
        require(self.shard_rows >= 1, "shard size")
        if self.hnsw is not None:
            m, ef, _ = self.hnsw
            require(2 <= m <= 16 and ef >= m, "graph")

    def field(self, name: str | int) -> Field:
        if isinstance(name, int):
            require(0 <= name < len(self.fields), "field position")
            return self.fields[name]
        found = [f for f in self.fields if f.name == name]
        require(bool(found), "field name")
        return found[0]

    def with_(self, **changes) -> IndexConfig:
        return replace(self, **changes)

    def to_json(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_json(data: dict) -> IndexConfig:
        graph = data.get("hnsw")
        return IndexConfig(**data | {"fields": tuple(Field(**f) for f in data["fields"]), "tree_key": tuple(data["tree_key"]), "hnsw": tuple(graph) if graph else None})


@dataclass(frozen=True)
class SearchOptions:
    k: int = 10
    leaf_beam: int | None = 384
    tree_keys: int = 4096
    partitions: int | None = 1024
    """``None`` for either: as many as there are."""
    rerank: int | None = None
    routing: str = "exact"
    """``exact`` or ``hnsw``: the first continues a filtered search past leaves without a match."""
    ef: int = 64
    working_bytes: int = 256 << 20
    """The routing tables of a search may not be larger."""

    def __post_init__(self):
        require(1 <= self.k <= MAX_K, "k")
        require(self.leaf_beam is None or 1 <= self.leaf_beam <= MAX_BEAM, "beam")
        require(1 <= self.tree_keys <= 65536, "tree key budget")
        require(self.partitions is None or 1 <= self.partitions <= 16384, "partition budget")
        require(self.routing in ("exact", "hnsw") and (self.routing == "exact" or self.ef >= 1), "routing")
        require(self.rerank is None or self.rerank >= self.k, "rerank budget")

    @property
    def pool(self) -> int:
        """Candidates kept for exact reranking."""
        wanted = min(65536, max(64, self.k + math.ceil(self.k / 4)))
        return wanted if self.rerank is None else max(self.k, min(self.rerank, wanted) if self.rerank < wanted else self.rerank)


@dataclass(frozen=True)
class RefineOptions:
    rounds: int = 2
    neighbours: int = 32

    def __post_init__(self):
        require(0 <= self.rounds <= 5, "rounds")


@dataclass(frozen=True)
class VerifyOptions:
    issues: int = 100
    objects: int = 1_000_000

    def __post_init__(self):
        require(1 <= self.issues <= 10_000 and 1 <= self.objects <= 100_000_000, "verify limits")


