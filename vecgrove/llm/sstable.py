"""Sorted-string tables: prefix-compressed blocks, a sparse block index, a Bloom filter and a footer.

Layout, in order: data blocks, the index block, the filter, the footer (fixed size).  An entry of a block is
the length of the prefix shared with the key before, the length of the rest, the length of the value (all as
LEB128 numbers), the rest of the key, the value.  Blocks are compressed with Zstandard and end with the CRC-32
of the compressed bytes.  Keys are byte strings in ascending order and may repeat.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import xxhash
import zstandard

MAGIC = b"VGSSTAB1"
FOOTER = struct.Struct("<QQQQQQ8s")
"""Index offset and size, filter offset and size, entries, hash functions of the filter, magic."""


def key_of(doc_id: int | None) -> bytes:
    """Sorts as the number does; null sorts first."""
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + 2**63) % 2**64)


def id_of(key: bytes) -> int | None:
    return None if not key else struct.unpack(">Q", key)[0] - 2**63


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_number(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int, functions: int) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 0), xxhash.xxh64_intdigest(key, 1) | 1
    return [(a + k * b) % 2**64 % bits for k in range(functions)]


class Writer:
    def __init__(self, out: BinaryIO, block_bytes: int = 1 << 16, bits_per_key: int = 10):
        self.out, self.block_bytes, self.bits_per_key = out, block_bytes, bits_per_key
        self.at = self.entries = 0
        self.block, self.last, self.first_in_block = bytearray(), b"", b""
        self.index = bytearray()
        self.hashes: list[int] = []
        self.packer = zstandard.ZstdCompressor(level=1)
        self.seen: bytes | None = None

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first_in_block = key
        self.block += _number(shared) + _number(len(key) - shared) + _number(len(value)) + key[shared:] + value
        if key != self.seen:
            self.hashes += (xxhash.xxh64_intdigest(key, 0), xxhash.xxh64_intdigest(key, 1) | 1)
            self.seen = key
        self.last = key
        self.entries += 1
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.block:
            packed = self.packer.compress(bytes(self.block))
            offset, size = self._put(packed + struct.pack("<I", zlib.crc32(packed)))
            self.index += _number(len(self.first_in_block)) + self.first_in_block + _number(offset) + _number(size)
            self.block, self.last = bytearray(), b""

    def close(self) -> None:
        self._flush()
        index = self._put(bytes(self.index))
        pairs = np.array(self.hashes, np.uint64).reshape(-1, 2)
        bits = max(64, len(pairs) * self.bits_per_key)
        functions = max(1, round(self.bits_per_key * 0.69))
        flags = np.zeros(bits, bool)
        with np.errstate(over="ignore"):
            for k in range(functions):
                flags[(pairs[:, 0] + np.uint64(k) * pairs[:, 1]) % np.uint64(bits)] = True
        bloom = self._put(struct.pack("<Q", bits) + np.packbits(flags, bitorder="little").tobytes())
        self._put(FOOTER.pack(*index, *bloom, self.entries, functions, MAGIC))
        self.out.close()


class Reader:
    """Reads the footer, the index and the filter; blocks only as they are needed."""

    def __init__(self, file: BinaryIO):
        self.file = file
        size = file.seek(0, 2)
        size = file.tell() if size is None else size
        at, n, bloom_at, bloom_n, self.entries, self.functions, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a table of this format")
        index, bloom = self._at(at, n), self._at(bloom_at, bloom_n)
        self.bits, self.bloom = struct.unpack_from("<Q", bloom)[0], bloom[8:]
        self.keys: list[bytes] = []
        self.places: list[tuple[int, int]] = []
        i = 0
        while i < len(index):
            k, i = _read_number(index, i)
            self.keys.append(index[i : i + k])
            offset, i = _read_number(index, i + k)
            length, i = _read_number(index, i)
            self.places.append((offset, length))
        self.unpacker = zstandard.ZstdDecompressor()

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        stored = self._at(*self.places[block])
        if zlib.crc32(stored[:-4]) != struct.unpack("<I", stored[-4:])[0]:
            raise ValueError("a block is damaged")
        data, i, key = self.unpacker.decompress(stored[:-4]), 0, b""
        while i < len(data):
            shared, i = _read_number(data, i)
            rest, i = _read_number(data, i)
            size, i = _read_number(data, i)
            key = key[:shared] + data[i : i + rest]
            yield key, data[i + rest : i + rest + size]
            i += rest + size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self.places)):
            yield from self._entries(block)

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key: the filter, a binary search of the index, then the blocks that may hold it."""
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits, self.functions)):
            return []
        out = []
        for block in range(max(0, bisect.bisect_left(self.keys, key) - 1), len(self.keys)):
            if self.keys[block] > key:
                break
            out += [v for k, v in self._entries(block) if k == key]
        return out
