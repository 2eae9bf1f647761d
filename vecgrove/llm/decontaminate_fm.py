"""Benchmark decontamination with an FM-index per shard of training text.

A task cuts its documents into shards of about two megabytes, which bounds what a worker holds.  A shard's distinct texts, word by word, are indexed whole: the
alphabet is the shard's own vocabulary, and a text that the shard holds several times is indexed once.  Every passage
(a window of ``window`` consecutive words of an item; a shorter item is one passage) is searched backwards through the
wavelet-tree ranks of the shard's index, found suffixes are located by sampled positions, and the spans are merged.  A very
long text is indexed in segments that overlap by a passage.

The benchmark is the query set: its passages are written to the shared folder in blocks of about ``block_bytes`` of text, and a
worker holds one or two blocks at a time.  A shard's index is built once and all blocks are searched in it.  Neither
documents nor items are shuffled to one place or collected.

Defined results: null and empty texts have no words and are clean; null or empty items have no passage; a null item id is
reported as null, repeated ids once and items of equal text each; rows are judged one by one, so repeated rows and ids get
the same answer each; other columns, whatever their names, are kept by ``remove_spans`` and ignored by ``find``; an empty
table or benchmark gives no hit.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import shared_files, spans
from vecgrove.llm.common import materialise, new_folder, total_bytes
from vecgrove.llm.fm_index import FMIndex
from vecgrove.llm.wordtokens import forget

FOUND = "n_words long, spans array<struct<first:long,stop:long,byte_first:long,byte_stop:long>>, items array<long>, cut string"


@dataclass(frozen=True)
class Settings:
    window: int = 10
    shard_bytes: int = 2 << 20
    segment_words: int = 1 << 19
    block_bytes: int = 1 << 20


class Passages:
    """The distinct passages of a block of items, as word hashes by length, and the items that have each."""

    def __init__(self, ids: list[int | None], texts: pa.Array, window: int):
        data, offsets = spans.buffers(texts)
        data = spans.lower(data)
        starts, ends, first = spans.words(data, offsets, spans.ALNUM)
        h, count = spans.hashes(data, starts, ends), np.diff(first)
        self.ids = ids
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(count[count > 0], window)).tolist():
            fits = count == size if size < window else count >= window
            windows = np.where(fits, count - size + 1, 0)
            at = np.repeat(first[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
            item = np.repeat(np.arange(len(ids)), windows)
            rows, which = np.unique(h[at[:, None] + np.arange(size)], axis=0, return_inverse=True)
            both = np.unique(np.stack([which.reshape(-1), item]), axis=1)
            self.by_length[size] = rows, np.searchsorted(both[0], np.arange(len(rows) + 1)), both[1]


def write_blocks(benchmark: DataFrame, id_col: str, text_col: str, settings: Settings) -> list[str]:
    """Writes all items' passages; returns the blocks' paths."""
    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    dealt = items.repartition(max(1, -(-total_bytes(items) // settings.block_bytes)), F.xxhash64("id", "text"))
    folder = new_folder(benchmark.sparkSession, "passages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for i, data, offsets in spans.pieces(batch.column("text"), settings.block_bytes):
                n = len(offsets) - 1
                file, path = shared_files.open_new(folder, ".passages")
                file.write(pickle.dumps(Passages(ids[i : i + n], batch.column("text").slice(i, n), settings.window)))
                file.close()
                yield pa.RecordBatch.from_arrays([pa.array([path])], ["path"])

    # A short list of names: one per block_bytes of the benchmark.
    return [r["path"] for r in materialise(dealt.mapInArrow(run, "path string"), "blocks").collect()]


_held: dict[str, Passages] = {}


def _block(path: str) -> Passages:
    if path not in _held:
        if len(_held) > 1:
            _held.clear()
        with shared_files.open_old(path) as file:
            _held[path] = pickle.loads(file.read())
    return _held[path]


def _segments(symbol: np.ndarray, first: np.ndarray, settings: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(symbols with a zero after each text, the word at each place) of runs of words that overlap by a passage."""
    n = len(symbol)
    for low in range(0, n, settings.segment_words):
        high = min(n, low + settings.segment_words + settings.window - 1)
        stops = np.unique(np.append(first[(first > low) & (first < high)], high)) - low
        place = np.arange(high - low) + np.searchsorted(stops, np.arange(high - low), "right")
        text, word = np.zeros(high - low + len(stops), np.int64), np.full(high - low + len(stops), -1, np.int64)
        text[place], word[place] = symbol[low:high], np.arange(low, high)
        yield text, word


def search(h: np.ndarray, first: np.ndarray, blocks: Iterable[Passages], settings: Settings) -> tuple[np.ndarray, list[list[int | None]]]:
    """Whether each word is hit, and the ids of the items found in each text, of a shard's word hashes."""
    n, change = len(first) - 1, np.zeros(len(h) + 1, np.int64)
    found: list[list[int | None]] = [[] for _ in range(n)]
    vocabulary = np.unique(h)
    if not len(vocabulary):
        return np.zeros(0, bool), found
    symbol, owner = np.searchsorted(vocabulary, h) + 1, spans.owner(first)
    indexes = [(FMIndex(text, len(vocabulary)), word) for text, word in _segments(symbol, first, settings)]
    for block in blocks:
        pairs = []
        for size, (passages, first_item, item_list) in block.by_length.items():
            near = np.minimum(np.searchsorted(vocabulary, passages), len(vocabulary) - 1)
            # A passage with a word that the shard doesn't have has an empty range from there on.
            can = np.flatnonzero((vocabulary[near] == passages).all(axis=1))
            for index, word_at in indexes if len(can) else []:
                low, high = index.search(near[can] + 1)
                count = high - low
                some = np.flatnonzero(count)
                if not len(some):
                    continue
                count = count[some]
                rows = np.repeat(low[some] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
                word = word_at[index.locate(rows)]
                # Segments overlap: a place may be found twice.
                np.maximum.at(change_at := np.zeros(len(h) + 1, np.int64), word, 1)
                at = np.flatnonzero(change_at)
                change[at] += 1
                np.add.at(change, at + size, -1)
                which = can[np.repeat(some, count)]
                items = first_item[which + 1] - first_item[which]
                pick = np.repeat(first_item[which] - (np.cumsum(items) - items), items) + np.arange(int(items.sum()))
                pairs.append(np.unique(np.stack([np.repeat(owner[word], items), item_list[pick]]), axis=1))
        for doc, item in np.unique(np.concatenate(pairs, axis=1), axis=1).T.tolist() if pairs else []:
            found[doc].append(block.ids[item])
    return np.cumsum(change[:-1]) > 0, found


def find_in_piece(data: np.ndarray, offsets: np.ndarray, blocks: Iterable[Passages], settings: Settings) -> list[pa.Array]:
    """The columns of FOUND for one piece of whole texts."""
    n = len(offsets) - 1
    low = spans.lower(data)
    starts, ends, first = spans.words(low, offsets, spans.ALNUM)
    h, count = spans.hashes(low, starts, ends), np.diff(first)
    # Texts of the same words are searched once.
    has, place = np.flatnonzero(count), np.arange(len(h)) - np.repeat(first[:-1], count)
    whole = np.zeros(n, np.uint64)
    whole[has] = np.add.reduceat(spans.mix(h + spans.mix(place.astype(np.uint64) + np.uint64(1))), first[:-1][has]) if len(has) else 0
    _, lead, of = np.unique(np.stack([whole, count.astype(np.uint64)]), axis=1, return_index=True, return_inverse=True)
    of = of.reshape(-1)
    own = np.concatenate([[0], np.cumsum(count[lead])])
    words = np.repeat(first[:-1][lead] - own[:-1], count[lead]) + np.arange(int(own[-1]))
    hit_once, items_once = search(h[words], own, blocks, settings)
    hit = hit_once[np.repeat(own[:-1][of] - first[:-1], count) + np.arange(len(h))] if len(h) else np.zeros(0, bool)
    owner = spans.owner(first)
    at = np.flatnonzero(hit)
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]) if len(at) else np.zeros(0, bool)
    begin = at[new]
    stop = at[np.append(np.flatnonzero(new)[1:], len(at)) - 1] if len(at) else at
    doc = owner[begin]
    byte_first, byte_stop = starts[begin] - offsets[doc], ends[stop] - offsets[doc]
    span = pa.StructArray.from_arrays([pa.array(x) for x in (begin - first[doc], stop + 1 - first[doc], byte_first, byte_stop)], ["first", "stop", "byte_first", "byte_stop"])
    span_at = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])
    cut: list[str | None] = [None] * n
    for k in np.unique(doc).tolist():
        raw, a, kept = data[offsets[k] : offsets[k + 1]].tobytes(), 0, []
        for x, y in zip(byte_first[span_at[k] : span_at[k + 1]].tolist(), byte_stop[span_at[k] : span_at[k + 1]].tolist(), strict=True):
            kept.append(raw[a:x])
            a = y
        cut[k] = b"".join([*kept, raw[a:]]).decode("utf-8", "replace")
    return [
        pa.array(count),
        pa.ListArray.from_arrays(pa.array(span_at.astype(np.int32)), span),
        pa.array([items_once[k] for k in of.tolist()], pa.list_(pa.int64())),
        pa.array(cut, pa.string()),
    ]


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """A struct ``row`` of the document's columns, its text's words, the merged hit spans, the items found (each row of the
    benchmark) and, where there is a hit, the text without the spans."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    paths = write_blocks(benchmark, item_id_col, item_text_col, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            for i, data, offsets in spans.pieces(spans.field(batch.column("row"), text_col), settings.shard_bytes):
                made = find_in_piece(data, offsets, (_block(p) for p in paths), settings)
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(i, len(offsets) - 1), *made], ["row", "n_words", "spans", "items", "cut"])

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, {FOUND}")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """One row per document: what it shares with the benchmark."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = find(narrow, benchmark, settings=settings)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["first"])
    found = found.withColumn("items", F.array_distinct("items"))
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", names), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "items",
    )


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", length_col: str = "n_chars", settings: Settings = Settings()) -> DataFrame:
    """The documents with all hit spans cut out; those of which no word is left go.  Keeps the columns; repeated rows stay."""
    found = find(docs, benchmark, text_col, settings=settings)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["first"])
    left = found.filter((F.size("spans") == 0) | (n_hit < F.col("n_words")))
    has = F.col("cut").isNotNull()
    out = []
    for c in docs.columns:
        own = F.expr(f"row.`{c}`")
        if c == text_col:
            own = F.when(has, F.col("cut")).otherwise(own)
        elif c == length_col:
            own = F.when(has, F.length("cut")).otherwise(own).cast(docs.schema[c].dataType)
        out.append(own.alias(c))
    return left.select(*out)
