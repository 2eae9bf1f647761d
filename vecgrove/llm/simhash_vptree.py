"""SimHash near-duplicates through vantage-point trees.

The fingerprint of a text has a bit set where over half of its word shingles' XXH64 values have it.  Distinct
fingerprints are partitioned by vantage-point trees: at each node those within a radius of the vantage point
go left.  The bits of each word of 64 are cut into ``groups`` groups with a tree each (``splits`` times, each time
another way), under the Hamming distance of its bits: a pair within ``distance`` is within ``distance // groups`` in one
group at least, and for so small a distance the triangle inequality rules out far more branches.  A tree is fitted on a
bounded sample (``sample``), and every fingerprint is then placed in its own leaf.  It also visits, as a query, each earlier
leaf that the triangle inequality cannot rule out, so a pair within a group's distance meets once in its tree.  Leaves
that are still large get trees of their own, each fitted on a bounded sample of its own leaf, and so on.  What cannot be
split further (equal bits) is cut into blocks that all visitors meet; queries stream past, so a task holds one block only.
Within a task the links of a block become stars, and connected components of these run as DataFrames.

Defined results: a null or empty text has fingerprint zero and is linked like any other; equal rows share a
component; a null id never names a component unless all its ids are null; of ties in distance all are links; other
columns are ignored, whatever their names; a very long text is one task's, whole; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import spans
from vecgrove.llm.common import materialise, spread_join
from vecgrove.llm.components import components, least_labels


@dataclass(frozen=True)
class Settings:
    width: int = 4
    distance: int = 4
    seed: int = 42
    words: int = 1
    """Words of 64 bits that a fingerprint has."""
    groups: int = 3
    splits: int = 1
    """Ways to cut each word into groups."""
    reach: int | None = None
    """Distance within a group at which pairs are looked at; None: distance // groups, which loses no pair."""
    checked: int = 1
    """Words, from the tree's own on, whose bits make up the distance."""
    sample: int = 65536
    leaf: int = 4096

    @property
    def kinds(self) -> list[tuple[int, np.uint64]]:
        """The word and the bits of each tree."""
        return [(w, m) for w in range(self.words) for m in masks(self.groups, self.splits)]

    @property
    def near(self) -> int:
        return self.distance // (self.groups * self.words) if self.reach is None else self.reach


def majority(values: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Of each run of ``count`` values from ``begin`` on, a word of the bits that over half of them have (none: zero)."""
    out = np.zeros(len(count), np.uint64)
    has = np.flatnonzero(count)
    if len(has):
        bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, begin[has], axis=0, dtype=np.int32)
        out[has] = np.packbits(2 * ones > count[has, None], axis=1, bitorder="little").reshape(-1).view(np.uint64)
    return out


def fingerprints_of(data: np.ndarray, offsets: np.ndarray, width: int, seed: int) -> np.ndarray:
    import xxhash

    n = len(offsets) - 1
    data = spans.lower(data)
    starts, ends, first = spans.words(data, offsets, spans.SPACE)
    if not len(starts):
        return np.zeros(n, np.uint64)
    sizes = ends - starts
    at = np.concatenate([[0], np.cumsum(sizes + 1)])
    joined = np.full(int(at[-1]), 32, np.uint8)
    shift = np.repeat(at[:-1] - starts, sizes)
    source = np.arange(int(sizes.sum())) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    joined[source + shift] = data[source]
    raw = joined.tobytes()
    counts = np.diff(first)
    shingles = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    begin = np.concatenate([[0], np.cumsum(shingles)])
    word = np.arange(int(begin[-1])) - np.repeat(begin[:-1] - first[:-1], shingles)
    last = np.minimum(word + width, np.repeat(first[1:], shingles)) - 1
    digest = xxhash.xxh64_intdigest
    values = np.fromiter((digest(raw[a:b], seed) for a, b in zip(at[word].tolist(), (at[last] + sizes[last]).tolist(), strict=True)), np.uint64, len(word))
    return majority(values, begin[:-1], shingles)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id and ``fp``, the fingerprint's bits as a signed long."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    width, seed = settings.width, settings.seed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in spans.pieces(batch.column("text")):
                fp = fingerprints_of(data, offsets, width, seed)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(fp)), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return narrow.mapInArrow(run, "doc_id long, fp long")


@dataclass
class Tree:
    """Inner node k has children 2k+1 and 2k+2; leaves are numbered from left to right."""

    depth: int
    mask: np.uint64
    point: np.ndarray
    radius: np.ndarray

    @staticmethod
    def fit(sample: np.ndarray, depth: int, mask: np.uint64) -> Tree:
        inner = 2**depth - 1
        point, radius = np.zeros(inner, np.uint64), np.full(inner, 64, np.int64)
        groups = {0: sample & mask}
        for k in range(inner):
            own = groups.pop(k)
            if len(own) > 1:
                tried = own[np.linspace(0, len(own) - 1, min(24, len(own))).astype(int)]
                seen = own[np.linspace(0, len(own) - 1, min(512, len(own))).astype(int)]
                spread = np.bitwise_count(tried[:, None] ^ seen[None, :]).std(axis=1)
                point[k] = tried[int(spread.argmax())]
                far = np.bitwise_count(own ^ point[k]).astype(np.int64)
                radius[k] = int(np.median(far))
                left = far <= radius[k]
            else:
                left = np.ones(len(own), bool)
            if 2 * k + 2 < inner:
                groups[2 * k + 1], groups[2 * k + 2] = own[left], own[~left]
        return Tree(depth, mask, point, radius)

    def visits(self, fp: np.ndarray, distance: int, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, is home) of each fingerprint's own leaf and of the earlier leaves that it has to visit.

        Rows that aren't ``home`` in this tree are queries only: they visit every leaf that cannot be ruled out.
        """
        fp = fp & self.mask
        row, node = np.arange(len(fp)), np.zeros(len(fp), np.int64)
        home = np.ones(len(fp), bool) if home is None else home
        for _ in range(self.depth):
            far = np.bitwise_count(fp[row] ^ self.point[node]).astype(np.int64)
            left = far <= self.radius[node]
            go_left = np.where(home, left | (far - distance <= self.radius[node]), far - distance <= self.radius[node])
            go_right = np.where(home, ~left, far + distance > self.radius[node])
            row, node, home = (
                np.concatenate([row[go_left], row[go_right]]),
                np.concatenate([2 * node[go_left] + 1, 2 * node[go_right] + 2]),
                np.concatenate([(home & left)[go_left], home[go_right]]),
            )
        return row, node - (2**self.depth - 1), home


def masks(groups: int, splits: int = 1) -> list[np.uint64]:
    """For each way, disjoint groups of bits that make up all 64: by neighbouring bits, by every ``groups``-th bit, then shuffled."""
    out = []
    for k in range(splits):
        of = np.arange(64) * groups // 64 if k == 0 else np.arange(64) % groups if k == 1 else np.random.default_rng(k).permutation(np.arange(64) % groups)
        out += [np.uint64(sum(1 << int(b) for b in np.flatnonzero(of == g))) for g in range(groups)]
    return out


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Joins the components of a[i] and b[i]; labels stay the least member."""
    a, b = label[a], label[b]
    differ = a != b
    if not differ.any():
        return label
    pair = np.unique(np.stack([a[differ], b[differ]]), axis=1)
    return least_labels(len(label), pair[0], pair[1])[label]


PAIRS = 1 << 20


def _near(a: list[np.ndarray], b: list[np.ndarray], mask: np.uint64, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows (of the words that are checked) that are near in the group of bits and then in all bits.

    The group is cut into one part more than bits may differ: a near pair agrees in one part, so only rows that agree
    in some bits of a part are held against each other.  A pair may come several times.
    """
    if not len(a[0]) or not len(b[0]):
        return
    bits = np.flatnonzero((int(mask) >> np.arange(64, dtype=object)) & 1)
    shift = np.uint64(bits[0])
    narrow = np.uint32 if bits[-1] - bits[0] < 32 else np.uint64
    own, other = ((v[0] & mask) >> shift for v in (a, b))
    used = int(np.clip(np.log2(max(1, len(other) / 32)), 0, 7))
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def checked() -> tuple[np.ndarray, np.ndarray]:
        x, y = (np.concatenate(v) for v in zip(*held, strict=True))
        far = sum(np.bitwise_count(p[x] ^ q[y]).astype(np.int64) for p, q in zip(a, b, strict=True))
        good = far <= settings.distance
        return x[good], y[good]

    for part in np.array_split(bits - bits[0], settings.near + 1):
        places = part[:used].tolist()
        key = [sum((((v >> np.uint64(at)) & np.uint64(1)) << np.uint64(k) for k, at in enumerate(places)), np.zeros(len(v), np.uint64)) for v in (own, other)]
        order = [np.argsort(k, kind="stable") for k in key]
        cuts = [np.searchsorted(k[o], np.arange(2 ** len(places) + 1, dtype=np.uint64)).tolist() for k, o in zip(key, order, strict=True)]
        left, right = own[order[0]].astype(narrow), other[order[1]].astype(narrow)
        for v in range(2 ** len(places)):
            (i, i_stop), (j, j_stop) = cuts[0][v : v + 2], cuts[1][v : v + 2]
            rows = max(1, PAIRS // max(1, j_stop - j))
            for k in range(i, i_stop if j < j_stop else i, rows):
                x, y = np.nonzero(np.bitwise_count(left[k : min(k + rows, i_stop), None] ^ right[None, j:j_stop]) <= settings.near)
                if len(x):
                    held.append((order[0][x + k], order[1][y + j]))
                    if sum(len(h[0]) for h in held) >= PAIRS:
                        yield checked()
                        held = []
    if held:
        yield checked()


def _columns(settings: Settings) -> list[str]:
    """The words that are checked, the tree's own first."""
    return [f"x{k}" for k in range(settings.checked)]


def _layout(settings: Settings) -> str:
    return f"node long, {', '.join(f'{c} long' for c in _columns(settings))}, tree int, leaf long, home boolean"


def _link_block(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by shard, homes first.  Yields stars that connect all that is linked within a shard."""
    kinds = settings.kinds
    shard, label, gathered = None, None, []
    homes: dict[str, np.ndarray] = {}

    def words_of(part: dict[str, np.ndarray]) -> list[np.ndarray]:
        return [part[c] for c in _columns(settings)]

    def settle() -> pa.RecordBatch:
        nonlocal homes, label
        homes = {c: np.concatenate([g[c] for g in gathered]) for c in gathered[0]}
        label, own = np.arange(len(homes["node"])), words_of(homes)
        for x, y in _near(own, own, kinds[int(homes["tree"][0])][1], settings):
            label = _merge(label, x, y)
        linked = np.flatnonzero(label != np.arange(len(label)))
        return _edges(homes["node"][linked], homes["node"][label[linked]])

    for batch in batches:
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        rows |= {c: rows[c].view(np.uint64) for c in _columns(settings)}
        new = np.ones(len(rows["shard"]), bool)
        new[1:] = (rows["shard"][1:] != rows["shard"][:-1]) | (rows["home"][1:] != rows["home"][:-1])
        at = np.flatnonzero(new)
        for s, stop in zip(at.tolist(), np.append(at[1:], len(new)).tolist(), strict=True):
            if rows["shard"][s] != shard:
                if label is None and gathered:
                    yield settle()
                shard, gathered, label = rows["shard"][s], [], None
            part = {c: v[s:stop] for c, v in rows.items()}
            if part["home"][0]:
                gathered.append(part)
                continue
            if not gathered:
                continue  # nobody lives here
            if label is None:
                yield settle()
            for x, y in _near(words_of(part), words_of(homes), kinds[int(part["tree"][0])][1], settings):
                pair = np.unique(np.stack([x, label[y]]), axis=1)
                yield _edges(part["node"][pair[0]], homes["node"][pair[1]])
    if label is None and gathered:
        yield settle()


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["a", "b"])


def _placed(prints: DataFrame, settings: Settings) -> DataFrame:
    """A row per fingerprint and leaf that it lives in or visits, from trees fitted on one sample of all."""
    n, words = prints.count(), [f"w{k}" for k in range(settings.words)]
    sample = prints.filter(F.pmod(F.xxhash64("node", F.lit(7)), F.lit(max(1, n // settings.sample))) == 0).limit(2 * settings.sample)
    points = np.array([tuple(r) for r in sample.select(words).collect()], np.int64).reshape(-1, settings.words).view(np.uint64)
    depth = max(0, int(np.ceil(np.log2(max(1, n / settings.leaf)))))
    depth = min(depth, max(0, int(np.log2(max(1, len(points) / 8)))))
    trees = [(w, Tree.fit(np.sort(points[:, w]), depth, m)) for w, m in settings.kinds]
    names = ["node", *_columns(settings), "tree", "leaf", "home"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 8192):
                batch = whole.slice(i, 8192)
                value = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
                for k, (w, tree) in enumerate(trees):
                    row, leaf, home = tree.visits(value[f"w{w}"].view(np.uint64), settings.near)
                    own = [value[c][row] for c in ("node", *[f"w{(w + j) % settings.words}" for j in range(settings.checked)])]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*own, np.full(len(row), k, np.int32), leaf + k * 2**depth, home)], names)

    return prints.select("node", *words).mapInArrow(place, _layout(settings))


def _refitted(placed: DataFrame, large: DataFrame, settings: Settings) -> DataFrame:
    """The rows of the leaves ``large`` (leaf, n), in the leaves of trees fitted on samples of each of them.

    A leaf of which the sample holds nothing stays as it is.
    """
    kinds, columns, most = settings.kinds, _columns(settings), settings.leaf
    # A bounded sample of each large leaf, chosen by hash.
    chosen = placed.filter("home").join(large, "leaf").filter(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(1 << 20)) * F.col("n") < F.lit(float(most) * (1 << 20)))

    def fit(batch: pa.Table) -> pa.Table:
        mask = kinds[batch.column("tree")[0].as_py()][1]
        points = np.sort(batch.column("x0").to_numpy().view(np.uint64))
        n = batch.column("n")[0].as_py()
        depth = max(1, min(int(np.ceil(np.log2(n / most))), int(np.log2(max(2, len(points) / 8))), 10))
        tree = Tree.fit(points, depth, mask)
        return pa.table({"leaf": batch.column("leaf")[:1], "depth": pa.array([depth], pa.int32()), "point": pa.array([tree.point.tobytes()]), "radius": pa.array([tree.radius.tobytes()])})

    trees = materialise(chosen.select("leaf", "tree", "n", *columns).groupBy("leaf").applyInArrow(fit, "leaf long, depth int, point binary, radius binary"), "subtrees")
    names = ["node", *columns, "tree"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int, Tree] | None = None
        for batch in batches:
            leaf, of = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("leaf", "tree"))
            home = batch.column("home").to_numpy(zero_copy_only=False)
            at, length = spans.runs(leaf)
            for a, size in zip(at.tolist(), length.tolist(), strict=True):
                if known is None or known[0] != leaf[a]:
                    known = leaf[a], Tree(batch.column("depth")[a].as_py(), kinds[int(of[a])][1], np.frombuffer(batch.column("point")[a].as_py(), np.uint64), np.frombuffer(batch.column("radius")[a].as_py(), np.int64))
                part = batch.slice(a, size)
                row, inner, lives = known[1].visits(part.column("x0").to_numpy(zero_copy_only=False).view(np.uint64), settings.near, home[a : a + size])
                own = part.select(names).take(pa.array(row))
                base = spans.mix(np.array([leaf[a]], np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
                place_of = spans.mix(base + inner.astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(place_of), pa.array(lives)], [*names, "leaf", "home"])

    # A leaf is dealt to several tasks by its fingerprints, each with a copy of the leaf's small tree.
    pieces = large.join(trees, "leaf").withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / (4 * most)).cast("int") - 1)))
    count = F.ceil(F.col("n") / (4 * most)).cast("int")
    alone = placed.join(large, "leaf", "left_semi").join(trees, "leaf", "left_anti")
    rows = placed.join(large, "leaf").withColumn("piece", F.pmod(F.xxhash64("node"), count).cast("int")).drop("n")
    joined = rows.join(pieces.drop("n"), ["leaf", "piece"]).sortWithinPartitions("leaf")
    moved = joined.select(*names, "leaf", "home", "depth", "point", "radius").mapInArrow(place, _layout(settings))
    return moved.select(*placed.columns).unionByName(alone)


def links(prints: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Edges (a, b) between nodes of ``prints`` (node and words w0, w1, ..., written): stars whose components are those of all
    near pairs."""
    placed, done = _placed(prints, settings), None
    known = 0
    while True:
        sizes = materialise(placed.filter("home").groupBy("leaf").agg(F.count("*").alias("n")), "sizes")
        large = sizes.filter(F.col("n") > 4 * settings.leaf)
        state = large.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("n").alias("most")).first()
        fixed = placed.join(sizes, "leaf") if state["k"] == 0 or state == known else None
        if fixed is not None:
            done = fixed if done is None else done.unionByName(fixed)
            break
        known = state
        small = placed.join(sizes.filter(F.col("n") <= 4 * settings.leaf), "leaf")
        done = small if done is None else done.unionByName(small)
        placed = materialise(_refitted(placed, large, settings), "placed")
    blocks = F.ceil(F.col("n") / settings.leaf).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sized = done.withColumn("blocks", blocks)
    spread = sized.withColumn("own", F.when(F.col("home"), own).otherwise(F.col("blocks"))).withColumn("block", F.explode(F.sequence(F.lit(0), F.least("own", F.col("blocks") - 1))))
    sharded = spread.select("node", *_columns(settings), "tree", F.xxhash64("leaf", "block").alias("shard"), (F.col("home") & (F.col("block") == F.col("own"))).alias("home"))
    ready = sharded.repartition("shard").sortWithinPartitions("shard", F.desc("home"))
    return ready.mapInArrow(lambda batches: _link_block(batches, settings), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, one row per document."""
    prints = materialise(fingerprints(docs, id_col, text_col, settings), "fingerprints")
    distinct = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    roots = components(links(distinct.select(F.col("fp").alias("node"), F.col("fp").alias("w0")), settings))
    of = materialise(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root")), "roots")
    named = materialise(of.groupBy("root").agg(F.min("least_id").alias("component_id")), "named")
    classes = materialise(spread_join(of, named, "root").select("fp", "component_id"), "classes")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return spread_join(prints, classes, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")
