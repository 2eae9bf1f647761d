"""Stupid-backoff scores of every document under the counts of all documents.

S(w | c) is count(c w) / count(c) if the n-gram occurs at least ``least_count`` times, else ``penalty`` times the
score with the context's first word left out; at one word it is the count (zero counts as a half) over all words.
A document's own n-grams are in the counts, so two occurrences are the least that say anything of a document: with one,
every n-gram would be known and nothing would ever back off.  Words are runs of anything but ASCII white space, A-Z in
lower case; n-grams don't cross documents.

The count tables are partitioned by hash.  Documents are dealt out into chunks; a chunk explodes its n-grams, keeps
each distinct one once with its number (this combines before the shuffle) and sends it to the partition of
its hash range.  A partition sums the numbers of all chunks and joins them back to the chunks that asked; a chunk
sums the scores per document.  N-grams travel as sorted 56-bit hashes, packed by chunk and partition, so a hot
n-gram is one entry per chunk.  An n-gram of three words or more is asked for in a later round, and only if both n-grams
of one word less within it are known: no other can be.  That leaves the scores as they are and moves less than half.  A partition
holds about ``range_keys`` keys and a chunk about ``chunk_bytes`` of text, however large the corpus.

Defined results: a null or empty text has no words and a null score; ``n_oov`` counts words below least_count;
rows are dealt and scored one by one, so repeated rows get the same score each (and count each), as do ties; a very long
text is held whole by its chunk; other columns are ignored, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import spans

BITS = 56


@dataclass(frozen=True)
class Settings:
    order: int = 3
    penalty: float = 0.4
    least_count: int = 2
    chunk_bytes: int = 8 << 20
    range_keys: int = 2 << 20


def _grams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Per length the hash of the n-gram that ends at each word (0: none), and each text's first word."""
    hashes, sizes = [], []
    for _, data, offsets in spans.pieces(texts):
        data = spans.lower(data)
        starts, ends, first = spans.words(data, offsets, spans.SPACE)
        hashes.append(spans.hashes(data, starts, ends))
        sizes.append(np.diff(first))
    word = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    first = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))]).astype(np.int64)
    place = np.arange(len(word)) - np.repeat(first[:-1], np.diff(first))
    out = []
    for n in range(1, order + 1):
        h = np.zeros(len(word), np.uint64)
        h[n - 1 :] = spans.windows(word, n)
        h &= np.uint64((1 << BITS) - 1)
        h = np.where(h == 0, np.uint64(1), h)
        h[place < n - 1] = 0
        out.append(h)
    return out, first


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ordered = np.sort(h[h != 0])
    at, size = spans.runs(ordered)
    return ordered[at], size


def _pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte of equal weight, so that empty high bytes vanish and skewed ones shrink."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(-1)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Of sorted keys, the differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(_unpack(packed), dtype=np.uint64)


ASKED = "chunk int, range int, n int, keys binary, counts binary"
ANSWERED = "chunk int, range int, n int, sums binary"


def _asked(levels: list[np.ndarray], count: list[np.ndarray], n: int, least: int) -> np.ndarray:
    """The n-grams that may be known: of three words or more, those of which both shorter ones are."""
    if n <= 2:
        return levels[n - 1]
    known = count[n - 2] >= least
    return np.where(known & np.append(False, known[:-1]), levels[n - 1], np.uint64(0)) if len(known) else levels[n - 1]


def _known(levels: list[np.ndarray], answers: pa.Table | None, upto: int, least: int) -> list[np.ndarray]:
    """The counts of the n-grams that end at each word, for lengths up to ``upto``; zero for those not asked for."""
    count: list[np.ndarray] = []
    if upto == 0:
        return count
    ordered = answers.sort_by([("n", "ascending"), ("range", "ascending")])
    of_n, packed = np.array(ordered.column("n").to_pylist()), ordered.column("sums").to_pylist()
    for n in range(1, upto + 1):
        h = _asked(levels, count, n, least)
        keys, _ = _distinct(h)
        if not len(keys):
            count.append(np.zeros(len(h), np.int64))
            continue
        total = np.concatenate([_unpack(packed[i]).astype(np.int64) for i in np.flatnonzero(of_n == n)])
        count.append(np.where(h != 0, total[np.minimum(np.searchsorted(keys, h), len(keys) - 1)], 0))
    return count


def _ask(docs: pa.Table, answers: pa.Table | None, chunk: int, wanted: range, ranges: int, settings: Settings) -> pa.Table:
    levels, _ = _grams(docs.column("text"), wanted[-1])
    count = _known(levels, answers, wanted[0] - 1, settings.least_count)
    rows = []
    for n in wanted:
        keys, counts = _distinct(_asked(levels, count, n, settings.least_count))
        of = ((keys >> np.uint64(BITS - 32)) * np.uint64(ranges)) >> np.uint64(32)
        for a, size in zip(*(x.tolist() for x in spans.runs(of)), strict=True):
            rows.append((chunk, int(of[a]), n, _pack_keys(keys[a : a + size]), _pack(counts[a : a + size])))
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    return pa.table({c.split()[0]: pa.array([r[i] for r in rows], kinds[i]) for i, c in enumerate(ASKED.split(", "))})


def _answer(table: pa.Table) -> pa.Table:
    """Sums each key's numbers over all chunks; every chunk gets the sums in the order in which it asked."""
    keys = [_unpack_keys(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([_unpack(x) for x in table.column("counts").to_pylist()]).astype(np.int64)
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    at, size = spans.runs(flat[order])
    total = np.repeat(np.add.reduceat(counts[order], at), size)
    sums = np.empty(len(flat), np.int64)
    sums[order] = total
    cuts = np.cumsum([len(k) for k in keys])[:-1]
    packed = pa.array([_pack(s) for s in np.split(sums, cuts)], pa.binary())
    return pa.table({"chunk": table.column("chunk"), "range": table.column("range"), "n": table.column("n"), "sums": packed})


def _score(docs: pa.Table, answers: pa.Table, words: int, settings: Settings) -> pa.Table:
    levels, first = _grams(docs.column("text"), settings.order)
    least = settings.least_count
    count = _known(levels, answers, settings.order, least)
    score = np.log(np.where(count[0] >= least, count[0], 0.5) / max(1, words)) if len(count[0]) else np.zeros(0)
    for n in range(2, settings.order + 1):
        context = np.concatenate([[0], count[n - 2][:-1]]) if len(count[0]) else count[0]
        known = count[n - 1] >= least
        backed = np.where(levels[n - 1] != 0, score + np.log(settings.penalty), score)
        score = np.where(known, np.log(np.maximum(count[n - 1], 1) / np.maximum(context, 1)), backed)
    owner, n_docs = spans.owner(first), len(first) - 1
    sizes = np.diff(first)
    total = np.bincount(owner, score, n_docs).astype(float)
    missing = np.bincount(owner[count[0] < least], minlength=n_docs)
    empty = sizes == 0
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "n_words": pa.array(sizes.astype(np.int64)),
            "n_oov": pa.array(missing.astype(np.int64)),
            "log_score": pa.array(np.where(empty, 0, total), mask=empty),
            "mean_log_score": pa.array(total / np.maximum(sizes, 1), mask=empty),
        }
    )


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, n_words, n_oov, log_score (natural logarithm, summed) and mean_log_score (per word)."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    sums = narrow.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(r"[^\x09-\x0D\x20]+")).cast("long"))).first()
    size, words, order = int(sums[0] or 0), int(sums[1] or 0), settings.order
    chunks = max(1, -(-size // settings.chunk_bytes))
    # About a word per six bytes, each the end of one n-gram of a length at most.
    ranges = max(1, -(-(size // 6) // settings.range_keys))
    # By row, so that equal rows don't meet in one chunk.
    dealt = narrow.withColumn("chunk", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(chunks)).cast("int")).repartition("chunk")

    def first_ask(key: tuple, table: pa.Table) -> pa.Table:
        return _ask(table, None, key[0].as_py(), range(1, min(order, 2) + 1), ranges, settings)

    def answered_of(asked: DataFrame) -> DataFrame:
        return asked.groupBy("n", "range").applyInArrow(lambda table: _answer(table), ANSWERED)

    answered = answered_of(dealt.groupBy("chunk").applyInArrow(first_ask, ASKED))
    def next_ask(n: int):
        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            return _ask(left, right, key[0].as_py(), range(n, n + 1), ranges, settings)

        return run

    for n in range(3, order + 1):
        asked = dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(next_ask(n), ASKED)
        answered = answered.unionByName(answered_of(asked))

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        return _score(left, right, words, settings)

    return dealt.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(join, "doc_id long, n_words long, n_oov long, log_score double, mean_log_score double")


ORACLE_SQL = """
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x09-\\x0D\\x20]+') AS ws FROM documents)
), g AS (
  SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM w
), one AS (SELECT w, count(*) AS n FROM w GROUP BY w),
two AS (SELECT v, w, count(*) AS n FROM g WHERE v IS NOT NULL GROUP BY v, w),
three AS (SELECT u, v, w, count(*) AS n FROM g WHERE u IS NOT NULL GROUP BY u, v, w),
size AS (SELECT count(*)::double AS n FROM w),
s AS (
  SELECT g.doc_id, one.n AS c1,
    CASE WHEN three.n >= 2 THEN ln(three.n / start.n::double)
         ELSE CASE WHEN g.u IS NULL THEN 0 ELSE ln(0.4::double) END
            + CASE WHEN two.n >= 2 THEN ln(two.n / before.n::double)
                   ELSE CASE WHEN g.v IS NULL THEN 0 ELSE ln(0.4::double) END + ln((CASE WHEN one.n >= 2 THEN one.n ELSE 0.5::double END) / size.n) END END AS score
  FROM g JOIN one ON g.w = one.w CROSS JOIN size
  LEFT JOIN two ON g.v = two.v AND g.w = two.w LEFT JOIN one before ON g.v = before.w
  LEFT JOIN three ON g.u = three.u AND g.v = three.v AND g.w = three.w LEFT JOIN two start ON g.u = start.v AND g.v = start.w
), d AS (
  SELECT doc_id, count(*) AS n_words, sum((c1 < 2)::int)::bigint AS n_oov, sum(score) AS score FROM s GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_oov, 0) AS n_oov, round(score, 4) AS log_score, round(score / n_words, 6) AS mean_log_score
FROM documents LEFT JOIN d USING (doc_id)
"""
