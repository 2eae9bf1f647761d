"""Toxicity by maximum-scoring segments.

A word's log-odds of coming from a toxic text, counted once per text, are smoothed with Dirichlet priors: the prior of a word is the
share of its 8-byte prefix, that of the prefix is the share of the 5-byte prefix, and so on up to even odds, so
inflected and unseen words lean on what their beginnings tell.  Scores less a drift are negative on average
in clean text; a linear-time scan (Ruzzo and Tompa) then finds all maximal segments of each whole text.  The best
segment of clean texts of n words follows an extreme-value law whose place grows with log n; it is fitted on
clean texts, and each segment's score is restated in its units.  A logistic curve of a text's evidence, fitted on
texts that the word scores have not seen, turns it into a probability.

Labels are learned from a bounded sample of labelled rows outside the held-out fold: at most about ``sample`` rows,
a third of them for the calibration; all their words and prefixes seen ``least_count`` times are kept.  Every text is scored
whole.

Defined results: null and empty texts have no evidence and get the curve's value for none; a null or unknown label
teaches nothing; of repeated labels of an id the largest counts; a null id is in no fold and is scored too; without
labels of both kinds every score is zero; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import spans
from vecgrove.llm.common import materialise


@dataclass(frozen=True)
class Settings:
    sample: int = 20000
    least_count: int = 4
    prior: float = 4.0
    prefixes: tuple[int, ...] = (3, 5, 8)
    drift: float = 1.0
    limit: float = 5.0
    threshold: float = 0.3


def _units(data: np.ndarray, offsets: np.ndarray, settings: Settings) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of each word's prefixes and of the word, shortest first, and each text's first word."""
    data = spans.lower(data)
    starts, ends, first = spans.words(data, offsets, spans.ALNUM)
    stops = [np.minimum(starts + k, ends) for k in settings.prefixes] + [ends]
    out = spans.prefix_hashes(data, starts, ends, stops)
    return [h ^ spans.mix(np.full(1, k + 1, np.uint64)) for k, h in enumerate(out)], first


def _counts(batches: Iterator[pa.RecordBatch], settings: Settings) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        for i, data, offsets in spans.pieces(batch.column("text")):
            levels, first = _units(data, offsets, settings)
            label = np.repeat(toxic[i : i + len(offsets) - 1], np.diff(first)).astype(np.int64)
            above = np.zeros(len(label), np.uint64)
            of = spans.mix(spans.owner(first).astype(np.uint64) + np.uint64(1))
            for level, h in enumerate(levels):
                once = np.unique(h ^ of, return_index=True)[1]  # a text counts a unit once
                order = once[np.argsort(h[once])]
                at, size = spans.runs(h[order])
                bad = np.add.reduceat(label[order], at) if len(at) else at
                pick = order[at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[pick].view(np.int64)), pa.array(above[pick].view(np.int64)), pa.array(np.full(len(at), level, np.int32)), pa.array(bad), pa.array(size - bad)],
                    ["unit", "parent", "level", "bad", "good"],
                )
                above = h


class Odds:
    """The smoothed log-odds of all kept units."""

    def __init__(self, unit: np.ndarray, parent: np.ndarray, level: np.ndarray, bad: np.ndarray, good: np.ndarray, settings: Settings):
        self.settings = settings
        total_bad, total_good = max(1, bad[level == 0].sum()), max(1, good[level == 0].sum())
        weight = total_good / total_bad
        units, logits = np.zeros(0, np.uint64), np.zeros(0)
        for k in range(len(settings.prefixes) + 1):
            own = level == k
            before = self._get(units, logits, parent[own], 0.0)
            share = 1 / (1 + np.exp(-before))
            # Shares count as if both kinds had the same number of words, at the information of the rarer kind.
            b, g = bad[own].astype(float), good[own] / weight
            p = (b + settings.prior * share) / (b + g + settings.prior)
            p = np.clip(p, 1e-4, 1 - 1e-4)
            units, logits = np.concatenate([units, unit[own]]), np.concatenate([logits, np.log(p / (1 - p))])
            order = np.argsort(units)
            units, logits = units[order], logits[order]
        self.units, self.logits = units, logits

    @staticmethod
    def _get(units: np.ndarray, logits: np.ndarray, wanted: np.ndarray, otherwise: float | np.ndarray) -> np.ndarray:
        if not len(units):
            return np.zeros(len(wanted)) + otherwise
        at = np.minimum(np.searchsorted(units, wanted), len(units) - 1)
        return np.where(units[at] == wanted, logits[at], otherwise)

    def scores(self, levels: list[np.ndarray]) -> np.ndarray:
        """Of each word: its own log-odds, or those of its longest known prefix."""
        words = levels[-1]
        if not len(words):
            return np.zeros(0)
        ordered = np.sort(words)
        distinct = ordered[spans.runs(ordered)[0]]
        which = np.searchsorted(distinct, words)
        seen = np.zeros(len(distinct), np.int64)
        seen[which] = np.arange(len(words))
        value: np.ndarray | float = 0.0
        for h in levels:
            value = self._get(self.units, self.logits, h[seen], value)
        return (np.clip(value, -self.settings.limit, self.settings.limit) - self.settings.drift)[which]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, stop, score), by the linear-time scan.

    Runs of like sign are taken together first; this changes no segment with a positive run at both ends.
    """
    if not len(scores) or scores.max() <= 0:
        return []
    positive = scores > 0
    at = np.flatnonzero(np.concatenate([[True], positive[1:] != positive[:-1]]))
    sums = np.add.reduceat(scores, at).tolist()
    begin, stop = at.tolist(), np.append(at[1:], len(scores)).tolist()
    total, kept = 0.0, []  # kept: first, stop, total before, total after
    for value, a, b in zip(sums, begin, stop, strict=True):
        before, total = total, total + value
        if value <= 0:
            continue
        first, left, right = a, before, total
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= right:
                kept.append((first, b, left, right, j))
                break
            first, left = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, right - left) for a, b, left, right, _ in kept]


@dataclass
class Law:
    """The extreme-value law of the best segment of clean texts: place a + scale * log(words)."""

    place: float
    scale: float

    @staticmethod
    def fit(best: np.ndarray, words: np.ndarray) -> Law:
        logs = np.log(np.maximum(words, 1))
        scale = 1.0
        for _ in range(20):
            scale = max(0.2, float(np.std(best - scale * logs)) * np.sqrt(6) / np.pi) if len(best) > 1 else 1.0
        place = float(np.mean(best - scale * logs)) - 0.5772156649 * scale if len(best) else 0.0
        return Law(place, scale)

    def units(self, score: float, words: int) -> float:
        return (score - self.place) / self.scale - np.log(max(words, 1))


def evidence(segments: list[tuple[int, int, float]], words: int, law: Law) -> float:
    """The sum, over segments, of log(1 + exp(z)): that of a segment far in the tail is -log of its p-value."""
    return float(sum(np.logaddexp(0.0, law.units(s, words)) for _, _, s in segments))


@dataclass
class Model:
    odds: Odds
    law: Law
    slope: float
    base: float

    def probability(self, found: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * np.log1p(found) + self.base, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base of a logistic curve, by Newton's method with a small ridge."""
    w, design = np.zeros(2), np.stack([x, np.ones(len(x))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 1e-2 * w
        step = np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2), gradient)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def _per_text(batch: pa.RecordBatch, odds: Odds, settings: Settings) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, each row's word scores) by pieces."""
    for i, data, offsets in spans.pieces(batch.column("text")):
        levels, first = _units(data, offsets, settings)
        scores = odds.scores(levels)
        yield i, [scores[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model | None:
    """docs has doc_id and text, labels doc_id and toxic."""
    spark = docs.sparkSession
    known = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = known.count()
    if n > settings.sample:
        known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < int(settings.sample / n * (1 << 20)))
    chosen = materialise(known, "labels")
    texts = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", F.coalesce("text", F.lit("")).alias("text"))
    learned = texts.withColumn("tune", F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(3)) == 0)
    learned = materialise(learned, "labelled")
    counted = learned.filter("not tune").mapInArrow(lambda b: _counts(b, settings), "unit long, parent long, level int, bad long, good long")
    kept = counted.groupBy("unit").agg(F.min("parent").alias("parent"), F.min("level").alias("level"), F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    # Bounded by the sample of rows: so many texts have so many words.
    rows = kept.filter(F.col("bad") + F.col("good") >= settings.least_count).toPandas()
    bad, good = rows["bad"].to_numpy(np.int64), rows["good"].to_numpy(np.int64)
    if not bad.sum() or not good.sum():
        return None
    odds = Odds(rows["unit"].to_numpy(np.int64).view(np.uint64), rows["parent"].to_numpy(np.int64).view(np.uint64), rows["level"].to_numpy(np.int64), bad, good, settings)
    shared = spark.sparkContext.broadcast(odds)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in _per_text(batch, shared.value, settings):
                found = [[s for _, _, s in maximal_segments(x)] for x in texts]
                yield pa.RecordBatch.from_arrays([batch.column("toxic").slice(i, len(texts)), pa.array([len(x) for x in texts]), pa.array(found, pa.list_(pa.float64()))], ["toxic", "words", "scores"])

    tuned = learned.filter("tune").mapInArrow(segments, "toxic int, words long, scores array<double>").collect()
    clean = [r for r in tuned if r["toxic"] == 0 and r["words"]]
    law = Law.fit(np.array([max(r["scores"], default=0.0) for r in clean]), np.array([r["words"] for r in clean]))
    found = np.array([evidence([(0, 0, s) for s in r["scores"]], r["words"], law) for r in tuned])
    kind = np.array([r["toxic"] for r in tuned], float)
    if not 0 < kind.sum() < len(kind):
        return None
    slope, base = _logistic(np.log1p(found), kind)
    return Model(odds, law, slope, base)


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """doc_id, score, the number of segments with evidence and the best segment's words [first, stop)."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    model = fit(narrow, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            if model is None:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.zeros(n)), pa.array(np.zeros(n, np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], _NAMES)
                continue
            for i, texts in _per_text(batch, model.odds, settings):
                found, count, first, stop = [], [], [], []
                for x in texts:
                    own = maximal_segments(x)
                    found.append(evidence(own, len(x), model.law))
                    count.append(sum(model.law.units(s, len(x)) > 3 for _, _, s in own))
                    best = max(own, key=lambda s: s[2], default=(None, None, 0.0))
                    first.append(best[0])
                    stop.append(best[1])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, len(texts)), pa.array(model.probability(np.array(found))), pa.array(count, pa.int64()), pa.array(first, pa.int64()), pa.array(stop, pa.int64())], _NAMES
                )

    return narrow.mapInArrow(run, "doc_id long, score double, segments long, first_word long, stop_word long")


_NAMES = ["doc_id", "score", "segments", "first_word", "stop_word"]


def predicted(scored: DataFrame, settings: Settings = Settings()) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= settings.threshold).cast("int").alias("predicted"), "segments", "first_word", "stop_word")
