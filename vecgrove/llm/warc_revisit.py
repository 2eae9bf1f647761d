"""WARC archives with revisit records for repeated payloads.

A first pass writes every record as a ``response``, a gzip member each, to a staged archive per task, and hands over
its header: id, target, payload digest and length, and the member's place.  Only these headers are shuffled: each
digest's original is its record of the largest id, found by an aggregation that combines before the shuffle, and a join
(hot digests apart) gives each other record its original.  A second pass goes through each staged archive once:
members of originals are copied byte for byte, the others are written anew as ``revisit`` records of headers alone.
A manifest row, committed by Spark, names each archive that counts; the staged ones are deleted.

Defined results: a null payload is empty; a null url is written as an empty target; every row becomes one record, with
a record id of its own.  Of rows with the same payload and the same largest id (repeated rows) one is the
response and the others revisit it.  A null id counts as less than any other: such a record revisits one with an id;
where all have none, one is the response and ``refers_to`` stays null.  A single payload is held whole by a task; other
columns are ignored; an empty table gives an empty table.  Reading an archive checks each response's digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import shared_files
from vecgrove.llm.common import materialise, new_folder, remove, spread_join

_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Settings:
    least_bytes: int = 0
    """Shorter payloads are always responses."""
    date: str = _DATE
    level: int = 1


def digest_of(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(path: str, at: int) -> str:
    """The id of the record that was staged at this place: of its own, however often a page id occurs."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{path}#{at}'.encode()).digest()[:16], version=5)}>"


def one_line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def member(page_id: int | None, urn: str, url: str | None, digest: str, size: int, payload: bytes | None, original: tuple[str, int | None] | None, settings: Settings) -> bytes:
    """A record as a gzip member: a response with its payload or, given the record id and page id of an original, a revisit."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload or b"")
    fields = [
        ("WARC-Type", "response" if original is None else "revisit"),
        ("WARC-Record-ID", urn),
        ("WARC-Date", settings.date),
        ("WARC-Target-URI", one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if original is not None:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", original[0])]
        if original[1] is not None:
            fields.append(("Refers-To-Page-ID", str(original[1])))
    made = ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"
    return gzip.compress(made, settings.level, mtime=0)


HEADERS = "page_id long, url string, payload_bytes long, payload_digest string, path string, at long, size long"


def stage(pages: DataFrame, folder: str, settings: Settings = Settings()) -> DataFrame:
    """Writes all records of (page_id, url, payload) as responses; returns their headers and places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, path, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload in zip(*(batch.column(c) for c in ("page_id", "url", "payload")), strict=True):
                if file is None:
                    file, path = shared_files.open_new(folder, ".staged")
                page_id, url, payload = page_id.as_py(), url.as_py(), payload.as_py()
                digest = digest_of(payload)
                made = member(page_id, record_id(path, at), url, digest, len(payload), payload, None, settings)
                file.write(made)
                rows.append((page_id, url, len(payload), digest, path, at, len(made)))
                at += len(made)
            if rows:
                yield _table(rows, HEADERS)
        if file is not None:
            file.close()

    return materialise(pages.mapInArrow(run, HEADERS), "headers")


def resolve(heads: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``original`` (page_id, path, at), null for responses."""
    place = F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "path", "at")
    long_enough = heads.filter(F.col("payload_bytes") >= settings.least_bytes)
    first = long_enough.groupBy("payload_digest").agg(F.max(place).alias("original"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = spread_join(heads, materialise(first, "originals"), "payload_digest", "left")
    other = (F.col("payload_bytes") >= settings.least_bytes) & ((F.col("original.path") != F.col("path")) | (F.col("original.at") != F.col("at")))
    return joined.withColumn("original", F.when(other, F.col("original")))


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", settings: Settings = Settings()) -> DataFrame:
    """Writes the archives and returns the manifest: path and records."""
    own = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.encode(F.col(f"`{payload_col}`").cast("string"), "utf-8"), F.lit(b"")).alias("payload"),
    )
    staged = f"{folder}-staged"
    heads = stage(own, staged, settings)
    flat = resolve(heads, settings).select("*", F.col("original.page_id").alias("original_id"), F.col("original.path").alias("original_path"), F.col("original.at").alias("original_at")).drop("original")
    archives = heads.select("path").distinct().count()
    sorted_heads = flat.repartition(max(1, archives), "path").sortWithinPartitions("path", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, source, out, now, path, n = [], None, None, None, "", 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["path"] != now:
                    if out is not None:
                        out.close()
                        source.close()
                        done.append((path, n))
                    now, n = r["path"], 0
                    source = shared_files.open_old(now)
                    out, path = shared_files.open_new(folder, ".warc.gz")
                if r["original_path"] is None:
                    source.seek(r["at"])
                    out.write(source.read(r["size"]))
                else:
                    original = record_id(r["original_path"], r["original_at"]), r["original_id"]
                    out.write(member(r["page_id"], record_id(now, r["at"]), r["url"], r["payload_digest"], r["payload_bytes"], None, original, settings))
                n += 1
        if out is not None:
            out.close()
            source.close()
            done.append((path, n))
        if done:
            yield _table(done, "path string, records long")

    manifest = materialise(sorted_heads.mapInArrow(run, "path string, records long"), "manifest")
    remove(pages.sparkSession, staged)
    return manifest


def records(path: str) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and the block of each record of an archive, as a stream."""
    with shared_files.open_old(path) as raw, gzip.GzipFile(fileobj=raw) as file:
        while line := file.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            head: dict[str, str] = {}
            while (line := file.readline()).strip():
                name, _, value = line.decode().partition(":")
                head[name.strip().lower()] = value.strip()
            yield head, file.read(int(head["content-length"]))


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _row(head: dict[str, str], block: bytes) -> tuple:
    http, _, payload = block.partition(b"\r\n\r\n")
    digest, page_id = head["warc-payload-digest"].removeprefix("sha1:"), head.get("page-id")
    if head["warc-type"] == "response":
        if digest_of(payload) != digest:
            raise ValueError("a payload differs from its digest")
        size, refers_to = len(payload), None
    else:
        size, refers_to = int(http.lower().partition(b"content-length:")[2].split(b"\r\n")[0]), head.get("refers-to-page-id")
    return (None if page_id is None else int(page_id), head["warc-target-uri"], size, digest, head["warc-type"], None if refers_to is None else int(refers_to))


def read(manifest: DataFrame) -> DataFrame:
    """One row per record of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows = []
                for head, block in records(path):
                    rows.append(_row(head, block))
                    if len(rows) == 4096:
                        yield _table(rows, READ)
                        rows = []
                if rows:
                    yield _table(rows, READ)

    # As many tasks as archives: rows of the manifest are tiny, and would else be taken together into one task.
    archives = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return archives.mapInArrow(run, READ)


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    columns = [c.split() for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), columns, strict=True)], [name for name, _ in columns])


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", settings: Settings = Settings()) -> DataFrame:
    """Writes the archives and returns what they hold."""
    return read(write(pages, new_folder(pages.sparkSession, "warc"), id_col, url_col, payload_col, settings))
