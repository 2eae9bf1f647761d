"""Token-id output as sorted-string table shards, keyed by document id.

Documents are dealt out by ranges of their id, so shards follow each other in ascending order, and a task
encodes its documents and writes one shard as a stream.  Or they stay where they are (``ordered=False``), as after a
global shuffle: each shard then holds a run of the input, sorted by id, and shards follow each other as the input's
partitions do, so that a mixture stays one and nothing is shuffled.  Values are the ids as little-endian unsigned integers
of two bytes where the vocabulary allows, else four.  Shards live in the shared folder under names of their own; a
manifest row per shard, committed by Spark, says which count, so repeated or lost tasks do no harm.

Defined results: null and empty texts have the end id alone; a null id sorts first; repeated ids (ties, and copies of
rows) are kept, as entries of one key, in the order of their texts; a very long text is encoded whole, by one task; other
columns are ignored, whatever their names; an empty table has no shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecgrove.llm import shared_files, spans, sstable
from vecgrove.llm.common import materialise, new_folder, total_bytes
from vecgrove.llm.wordtokens import WordTokens, forget, listed


@dataclass(frozen=True)
class Settings:
    vocabulary: str = "word_bpe_49k.json"
    end_id: int = 1
    shard_bytes: int = 32 << 20
    """Bytes of text per shard."""
    ordered: bool = True
    """Ranges of ids over all shards; False: only within each."""


class Encoder:
    """Ids of whole texts, from parts that the tokeniser provably treats apart.

    It lowers case, drops white space, and takes runs of letters, single digits and runs of other characters as
    words.  So a text may be cut at white space and between ASCII letters, digits and punctuation, but for
    apostrophes (which contractions join) and within the vocabulary's special strings; A-Z may be lowered first.
    Runs of letters are encoded many at a time and told apart by the vocabulary's word-end mark.
    """

    def __init__(self, vocabulary: str):
        import os

        import public_tokenizers
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.model = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        known = self.model.get_vocab(with_added_tokens=True)
        self.size = max(known.values()) + 1
        self.special = [t.content.encode() for t in self.model.get_added_tokens_decoder().values()]
        self.last = np.zeros(self.size, bool)
        self.last[[i for t, i in known.items() if t.endswith("</w>")]] = True
        self.parts, self.whole = WordTokens(self.encode), WordTokens(self.alone)
        self.classes = np.zeros(256, np.uint8)
        for c in range(33, 127):
            ch = chr(c)
            self.classes[c] = 1 if ch.isalpha() else 2 if ch.isdigit() else 0 if ch == "'" else 3

    def alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return listed([e.ids for e in self.model.encode_batch(words, add_special_tokens=False)])

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        letters = np.fromiter((w.lower().isalpha() for w in words), bool, len(words))
        plain = [w for w, ok in zip(words, letters.tolist(), strict=True) if ok]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i in range(0, len(plain), 4096):
            own = plain[i : i + 4096]
            ids = np.array(self.model.encode(" ".join(own), add_special_tokens=False).ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            found.append((ids, np.diff(ends, prepend=0)) if len(ends) == len(own) else self.alone(own))
        found.append(self.alone([w for w, ok in zip(words, letters.tolist(), strict=True) if not ok]))
        flat, sizes = (np.concatenate(x) for x in zip(*found, strict=True))
        # Runs of letters come first in ``flat``; back to the order of the words.
        place = np.empty(len(words), np.int64)
        place[np.concatenate([np.flatnonzero(letters), np.flatnonzero(~letters)])] = np.arange(len(words))
        first, size = (np.cumsum(sizes) - sizes)[place], sizes[place]
        stop = np.cumsum(size)
        return flat[np.repeat(first - (stop - size), size) + np.arange(len(flat))], size

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of each."""
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            words, (starts, ends, first) = self.whole, spans.words(data, offsets, spans.SPACE)
        else:
            words, data = self.parts, spans.lower(data)
            starts, ends, first = spans.words(data, offsets, spans.SPACE, self.classes)
        ids, sizes = words(data, starts, ends, spans.hashes(data, starts, ends))
        return ids, np.concatenate([[0], np.cumsum(sizes)])[first]


_encoders: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


def encode_piece(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> Iterator[np.ndarray]:
    """The ids of each text, the end id included."""
    ids, at = _encoder(settings.vocabulary).texts(data, offsets)
    end = np.array([settings.end_id], np.uint32)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield np.concatenate([ids[a:b], end])


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Writes the shards and returns the manifest: path, shard (their order), first_id, last_id, n_docs, n_tokens, width."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    if settings.ordered:
        narrow = narrow.repartitionByRange(max(1, -(-total_bytes(narrow) // settings.shard_bytes)), F.col("doc_id").asc_nulls_first())
    dealt = narrow.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    layout = "path string, shard long, first_id long, last_id long, n_docs long, n_tokens long, width int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, first, last, docs_n, tokens = None, "", None, None, 0, 0
        kind = np.dtype("<u2" if _encoder(settings.vocabulary).size <= 1 << 16 and settings.end_id < 1 << 16 else "<u4")
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            for i, data, offsets in spans.pieces(batch.column("text")):
                for k, own in enumerate(encode_piece(data, offsets, settings), i):
                    if writer is None:
                        file, path = shared_files.open_new(folder, ".sst")
                        writer, first = sstable.Writer(file), ids[k]
                    writer.add(sstable.key_of(ids[k]), own.astype(kind).tobytes())
                    docs_n, tokens, last = docs_n + 1, tokens + len(own), ids[k]
        forget()  # an idle worker holds no more than the model
        if writer is not None:
            writer.close()
            made = (path, TaskContext.get().partitionId(), first, last, docs_n, tokens)
            yield pa.RecordBatch.from_arrays([*(pa.array([x], pa.string() if x is path else pa.int64()) for x in made), pa.array([kind.itemsize], pa.int32())], [c.split()[0] for c in layout.split(", ")])

    return materialise(dealt.mapInArrow(run, layout), "manifest")


def starts(manifest: DataFrame) -> DataFrame:
    """Adds ``start``, the tokens of all shards before: by ranges of shards first, so no task sorts all of them."""
    ranged = manifest.repartitionByRange("shard").sortWithinPartitions("shard").withColumn("part", F.spark_partition_id())
    ranged = materialise(ranged, "manifest")
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = sums.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    own = Window.partitionBy("part").orderBy("shard")
    return ranged.join(before, "part").withColumn("start", F.col("before") + F.sum("n_tokens").over(own) - F.col("n_tokens")).drop("part", "before")


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per entry, read back from the shards: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    # As many tasks as shards: rows of the manifest are tiny, and would else be taken together into one task.
    shards = starts(manifest).select("path", "start", "width").repartition(max(1, manifest.count()), "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                at, rows = shard["start"], []
                held = 0
                with shared_files.open_old(shard["path"]) as file:
                    for key, value in sstable.Reader(file):
                        ids = np.frombuffer(value, "<u2" if shard["width"] == 2 else "<u4").astype("<u4")
                        rows.append((sstable.id_of(key), at, len(ids), zlib.crc32(ids.tobytes()), ids))
                        at, held = at + len(ids), held + len(ids)
                        if held > 1 << 20:
                            yield _rows(rows, with_ids)
                            rows, held = [], 0
                if rows:
                    yield _rows(rows, with_ids)

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)


def _rows(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    ids, start, n, crc, values = zip(*rows, strict=True)
    arrays = [pa.array(c, pa.int64()) for c in (ids, start, n, crc)]
    if with_ids:
        at = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(values).astype(np.int64))))
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])


def lookup(manifest: DataFrame, doc_id: int | None) -> list[list[int]]:
    """The ids of all the entries of one document: of the shards whose range may hold it, a Bloom filter, then a binary search."""
    out = []
    known = F.col("first_id").isNull() if doc_id is None else (F.col("first_id").isNull() | (F.col("first_id") <= F.lit(doc_id))) & (F.col("last_id") >= F.lit(doc_id))
    for path, width in manifest.filter(known).orderBy("shard").select("path", "width").toLocalIterator():
        with shared_files.open_old(path) as file:
            out += [np.frombuffer(v, "<u2" if width == 2 else "<u4").tolist() for v in sstable.Reader(file).get(sstable.key_of(doc_id))]
    return out


def token_output(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """Writes the documents and returns what the files hold."""
    return read(write(docs, new_folder(docs.sparkSession, "sstable"), id_col, text_col, settings))
