"""Readers of vector files (fvecs, ivecs, IDX) and seeded generators of test vectors."""

from __future__ import annotations

import math
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from vecgrove.errors import require


def _decoded(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Whole files are split into rows on the executors; (file, pos) is a row's place."""

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = decode(content, kind)
                for i in range(0, len(rows), 4096):
                    part = rows[i : i + 4096]
                    yield pd.DataFrame({"file": name, "pos": np.arange(i, i + len(part)), "vector": list(part)})

    element = "int" if kind == "ivecs" else "float"
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"file string, pos long, vector array<{element}>")


def decode(content: bytes, kind: str) -> np.ndarray:
    if kind in ("fvecs", "ivecs"):
        if not content:
            return np.zeros((0, 0), np.float32)
        (d,) = struct.unpack_from("<i", content)
        require(d > 0 and len(content) % (4 * d + 4) == 0, "vector file")
        rows = np.frombuffer(content, "<i4").reshape(-1, d + 1)
        require(bool((rows[:, 0] == d).all()), "vector file")
        body = np.ascontiguousarray(rows[:, 1:])
        return body if kind == "ivecs" else body.view("<f4")
    zero, code, dims = struct.unpack_from(">HBB", content)
    require(zero == 0 and code == 8 and dims >= 1, "IDX file")
    shape = struct.unpack_from(f">{dims}I", content, 4)
    data = np.frombuffer(content, np.uint8, offset=4 + 4 * dims)
    require(len(data) == math.prod(shape), "IDX file")
    return data.reshape(shape[0], -1).astype(np.float32)


def fvecs(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark, path, "fvecs")


def ivecs(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark, path, "ivecs")


def idx(spark: SparkSession, path: str) -> DataFrame:
    return _decoded(spark, path, "idx")


class Random:
    """xorshift64 with shifts 13, 7 and 17."""

    def __init__(self, seed: int):
        self.state = (seed * 0x9E3779B97F4A7C15) % 2**64 | 1

    def next(self) -> int:
        x = self.state
        x ^= x << 13 & 2**64 - 1
        x ^= x >> 7
        x ^= x << 17 & 2**64 - 1
        self.state = x
        return x

    def unit(self) -> float:
        return (self.next() >> 11) / 2**53

    def gauss(self) -> float:
        u = 1 - self.unit()
        return math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * self.unit())


def uniform(n: int, dimension: int, seed: int = 42) -> np.ndarray:
    r = Random(seed)
    return np.array([[2 * r.unit() - 1 for _ in range(dimension)] for _ in range(n)], np.float32)


def clustered(n: int, clusters: int, dimension: int, separation: float = 1.0, seed: int = 42) -> np.ndarray:
    """Points around uniform centres, each with a spread of 0.15."""
    r = Random(seed)
    centres = [[(2 * r.unit() - 1) * 2 * separation for _ in range(dimension)] for _ in range(clusters)]
    return np.array([[c + 0.15 * r.gauss() for c in centres[r.next() % clusters]] for _ in range(n)], np.float32)


def skewed(n: int, dimension: int, seed: int = 42) -> np.ndarray:
    """Eight hot spots on the diagonal, each half as likely as the one before, with a spread of 0.1."""
    r, out = Random(seed), []
    for _ in range(n):
        u, spot = r.unit(), 0
        while spot < 7 and u >= 1 - 0.5 ** (spot + 1):
            spot += 1
        out.append([spot + 0.1 * r.gauss() for _ in range(dimension)])
    return np.array(out, np.float32)


def duplicates(n: int, bases: int, dimension: int, seed: int = 42) -> np.ndarray:
    """Copies of a few vectors, half of them exact and half moved by a thousandth."""
    r = Random(seed)
    base = [[2 * r.unit() - 1 for _ in range(dimension)] for _ in range(bases)]
    out = []
    for i in range(n):
        own = base[i % bases]
        out.append([x + 1e-3 * r.gauss() for x in own] if r.unit() < 0.5 else own)
    return np.array(out, np.float32)


def generate(spec: str, dimension: int, seed: int = 42) -> np.ndarray:
    """uniform:N, clustered:N:C[:sep], skewed:N or dups:N:M."""
    kind, *rest = spec.split(":")
    if kind == "uniform":
        return uniform(int(rest[0]), dimension, seed)
    if kind == "clustered":
        return clustered(int(rest[0]), int(rest[1]), dimension, float(rest[2]) if len(rest) > 2 else 1.0, seed)
    if kind == "skewed":
        return skewed(int(rest[0]), dimension, seed)
    require(kind == "dups", "dataset")
    return duplicates(int(rest[0]), int(rest[1]), dimension, seed)


def frame(spark: SparkSession, vectors: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id long, vector array<float>")
