"""Quality rules from tokeniser fertility.

Every whole text is split into words at ASCII white space and each word is encoded with two public vocabularies: one
with byte fallback and one of bytes for many languages.  Four measures judge a text: characters per token under either,
the share of byte-fallback tokens, and the entropy of its tokens.  Bands for them come from all the documents of a
language (a null language's by script) and, as entropy grows with length, of a power of two of tokens: the median, plus or
minus a multiple of the spread between the quartiles, never narrower than a share of the median.

A class's band leans on its language's over all sizes as ``prior`` documents would, and every band is the wider the
fewer documents it comes from, so no number of documents switches a rule on or off, and no language is ever held to
another's bands.  Where the language's band weighs, a text's entropy may be low in bits or as a share of the most that
so many tokens can have, not both, as the one grows and the other falls with length.  Besides, ``floor_bits`` holds for all.

Defined results: a null or empty text has no words and fails the base rules; texts of a null language make a class per
script; rows are judged one by one, so repeated rows and ids get the same answer each, as do ties; a very long text is
measured whole, by one task; other columns of the input, whatever their names, are not looked at; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgrove.llm import spans
from vecgrove.llm.common import materialise
from vecgrove.llm.wordtokens import WordTokens, forget, listed

VOCABULARY = "piece_bpe_32k.model"
SECOND = "byte_bpe_multi_50k.tiktoken"

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_tokens long, chars_per_token double, second_chars_per_token double, byte_share double, entropy double, script string"
)


@dataclass(frozen=True)
class Bands:
    """A measure outside ``median +- max(spread * sigma, least)`` is rejected; sigma is the quartile range / 1.349."""

    spread: float = 4.0
    least_ratio: float = 0.04
    """Of the median, for characters per token."""
    least_bits: float = 0.4
    """For the entropy, in bits."""
    most_bytes: float = 0.10
    """Byte-fallback share that any language may have above its median."""
    prior: float = 50.0
    """Documents that a language's band counts as in that of each of its sizes."""
    floor_bits: float = 3.0
    """The least entropy of any text that is kept."""
    window: int = 8
    few_words: int = 20
    most_repeat_percent: int = 30


_encoders: dict[str, tuple[WordTokens, np.ndarray]] = {}


def _encoder(vocabulary: str) -> tuple[WordTokens, np.ndarray]:
    """Ids of words, and which ids stand for a byte that the vocabulary has no piece for."""
    if vocabulary not in _encoders:
        import public_tokenizers

        path = public_tokenizers.path(vocabulary)
        if vocabulary.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            is_byte = np.array([model.is_byte(i) for i in range(model.vocab_size())])
            encode = lambda words: model.encode(words, num_threads=1)
        else:
            import base64

            import tiktoken

            with open(path) as file:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
            known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            is_byte = np.zeros(max(ranks.values()) + 1, bool)
            encode = lambda words: [known.encode_ordinary(w) for w in words]
        _encoders[vocabulary] = WordTokens(lambda words: listed(encode(words)), most=500_000), is_byte
    return _encoders[vocabulary]


# The first bytes of UTF-8 characters of some scripts.
SCRIPTS = {"latin": (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)), "greek": (0xCD, 0xCE, 0xCF), "cyrillic": (*range(0xD0, 0xD4),), "hebrew": (0xD6, 0xD7), "arabic": (*range(0xD8, 0xDC),), "indic": (0xE0,), "asian": (*range(0xE3, 0xEE),)}
_SCRIPT = np.zeros(256, np.int64)
for _k, _bytes in enumerate(SCRIPTS.values(), 1):
    _SCRIPT[list(_bytes)] = _k


def scripts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The script that most letters of each text are of; none: other."""
    n, names = len(offsets) - 1, np.array(["other", *SCRIPTS])
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * len(names) + _SCRIPT[data], minlength=n * len(names)).reshape(n, len(names))[:, 1:]
    return np.where(counts.sum(axis=1) > 0, names[1:][counts.argmax(axis=1)], "other")


def _sum_by(owner: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(owner, weights, n) if weights is not None else np.bincount(owner, minlength=n)


def _repeated(h: np.ndarray, first: np.ndarray, n: int, width: int) -> np.ndarray:
    """Words of each text inside a window of ``width`` words that it has twice or more."""
    owner = spans.owner(first)
    w = spans.windows(h, width)
    if not len(w):
        return np.zeros(n, np.int64)
    whole = owner[: len(w)] == owner[width - 1 :]
    w = w ^ spans.mix(owner[: len(w)].astype(np.uint64) + np.uint64(1))
    at = np.flatnonzero(whole)
    ordered = np.sort(w[at])
    start, length = spans.runs(ordered)
    twice = ordered[start[length > 1]]
    if not len(twice):
        return np.zeros(n, np.int64)
    found = np.minimum(np.searchsorted(twice, w[at]), len(twice) - 1)
    at = at[twice[found] == w[at]]
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return _sum_by(owner[np.cumsum(edge[:-1]) > 0], n)


_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _duplicate_lines(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    newline = np.ones(256, bool)
    newline[10] = False
    s, e, first = spans.words(data, offsets, newline)
    owner = spans.owner(first)
    has_word = np.searchsorted(starts, e) > np.searchsorted(starts, s)
    s, e, owner = s[has_word], e[has_word], owner[has_word]
    h = spans.hashes(data, s, e) ^ spans.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(h, kind="stable")
    again = np.zeros(len(h), bool)
    again[1:] = h[order][1:] == h[order][:-1]
    return _sum_by(owner[order][again], n)


def measure_piece(data: np.ndarray, offsets: np.ndarray, vocabulary: str, width: int) -> list[np.ndarray]:
    """The columns of MEASURES for one piece of whole texts."""
    n = len(offsets) - 1
    starts, ends, first = spans.words(data, offsets, spans.SPACE)
    n_words = np.diff(first)
    owner = spans.owner(first)
    lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    chars = _sum_by(owner, n, (lead[ends] - lead[starts]).astype(float)).astype(np.int64)
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    symbols = marks[offsets[1:]] - marks[offsets[:-1]]
    h = spans.hashes(data, starts, ends)
    words, is_byte = _encoder(vocabulary)
    ids, sizes = words(data, starts, ends, h)
    of = np.repeat(owner, sizes)
    n_tokens = _sum_by(of, n)
    n_bytes = _sum_by(of[is_byte[ids]], n)
    keys = np.sort((of.astype(np.int64) << 32) | ids)
    at, count = spans.runs(keys)
    spread = _sum_by((keys[at] >> 32).astype(np.int64), n, count * np.log2(count)) if len(at) else np.zeros(n)
    total = np.maximum(n_tokens, 1)
    second = np.maximum(_sum_by(owner, n, _encoder(SECOND)[0](data, starts, ends, h)[1].astype(float)), 1)
    return [
        n_words, chars, symbols, _duplicate_lines(data, offsets, starts), _repeated(h, first, n, width),
        n_tokens, chars / total, chars / second, n_bytes / total, np.log2(total) - spread / total, scripts(data, offsets),
    ]


def measures(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, vocabulary: str = VOCABULARY, bands: Bands = Bands()) -> DataFrame:
    """A struct ``row`` of the columns ``keep`` (default: all), and the measures."""
    keep = docs.columns if keep is None else keep
    whole = text_col in keep
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), *[] if whole else [F.col(f"`{text_col}`").alias("text")])
    width = bands.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, offsets in spans.pieces(spans.field(batch.column("row"), text_col) if whole else batch.column("text")):
                columns = measure_piece(data, offsets, vocabulary, width)
                arrays = [batch.column("row").slice(i, len(offsets) - 1)]
                kinds = {"long": np.int64, "double": np.float64, "string": object}
                arrays += [pa.array(c.astype(kinds[m.split()[1]])) for c, m in zip(columns, MEASURES.split(", "), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["row", *(x.split()[0] for x in MEASURES.split(", "))])
        forget()  # an idle worker holds no more than the models

    row = packed.schema["row"].dataType.simpleString()
    return packed.mapInArrow(run, f"row {row}, {MEASURES}")


BANDS = {"chars_per_token": "cpt", "second_chars_per_token": "two", "entropy": "ent", "byte_share": "byte", "evenness": "even", "n_tokens": "size"}


def judge(measured: DataFrame, lang: str, bands: Bands = Bands()) -> DataFrame:
    """Adds ``base_failed`` and ``kept``; ``lang`` is an expression over ``measured``, which is read twice."""
    class_of = F.coalesce(F.concat(F.lit("language "), F.expr(lang).cast("string")), F.concat(F.lit("script "), F.col("script")))
    has = measured.withColumn("band_lang", class_of).withColumn("size_class", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))).cast("int"))
    base = (F.col("n_words") < bands.few_words) | (100 * F.col("n_repeat_words") > bands.most_repeat_percent * F.col("n_words"))
    has = has.withColumn("base_failed", base).withColumn("evenness", F.col("entropy") / F.log2(F.greatest("n_tokens", F.lit(2))))
    sound = has.filter(~F.col("base_failed"))

    def centre(by: list[str], suffix: str) -> DataFrame:
        quartiles = [F.percentile_approx(c, [0.25, 0.5, 0.75], 10000).alias(c) for c in BANDS]
        found = sound.groupBy(*[F.col(c).alias(f"{c}{suffix}") for c in by]).agg(*quartiles, F.count("*").alias(f"n{suffix}"))
        middle = [F.col(c)[1].cast("double").alias(f"m_{short}{suffix}") for c, short in BANDS.items()]
        return found.select(*[f"{c}{suffix}" for c in by], f"n{suffix}", *middle, *[((F.col(c)[2] - F.col(c)[0]) / 1.349).alias(f"s_{short}{suffix}") for c, short in BANDS.items()])

    # Written first, so that Spark knows their size when it chooses how to join them: small ones leave the texts in place.
    own = materialise(centre(["band_lang", "size_class"], "_own"), "bands")
    whole = materialise(centre(["band_lang"], "_lang"), "bands")
    joined = has.join(own, (F.col("band_lang") == F.col("band_lang_own")) & (F.col("size_class") == F.col("size_class_own")), "left")
    joined = joined.join(whole, F.col("band_lang") == F.col("band_lang_lang"), "left")
    n_own = F.coalesce("n_own", F.lit(0))
    # The language's weight in a class's band, and how much wider a band is for the few documents that it comes from.
    lean = F.lit(bands.prior) / (n_own + F.lit(bands.prior))
    wide = 1 + F.sqrt(F.lit(bands.prior) / F.greatest(F.col("n_lang"), F.lit(1)))

    def pick(c: str) -> Column:
        return F.col(f"{c}_lang") * lean + F.coalesce(F.col(f"{c}_own"), F.lit(0.0)) * (1 - lean)

    size = F.greatest("n_tokens", F.lit(1))
    # The shorter a text, the more its mean strays from the language's; bits may fall by the same again for each doubling
    # between its size and the language's median size.
    stray = wide * (1 + lean * (F.greatest(F.lit(1.0), F.sqrt(F.col("m_size_lang") / size)) - 1))
    away = wide * (1 + lean * F.abs(F.log2(size / F.greatest("m_size_lang", F.lit(1.0)))))
    # The least share is to the median share as the least bits are to the median bits.
    least_even = F.col("m_even_lang") * bands.least_bits / F.greatest("m_ent_lang", F.lit(1e-9))
    even = F.col("m_even_lang") - F.col("evenness") <= lean * wide * F.greatest(bands.spread * F.col("s_even_lang"), least_even) - (1 - lean)

    def below(c: str, short: str) -> Column:
        """By how much a measure is under the middle, in half widths of its band."""
        return (pick(f"m_{short}") - F.col(c)) / (stray * F.greatest(bands.spread * pick(f"s_{short}"), bands.least_ratio * pick(f"m_{short}")))

    fits = (
        (F.abs(below("chars_per_token", "cpt")) <= 1)
        # A vocabulary of many languages that knows a text better than most says nothing against it.
        & (below("second_chars_per_token", "two") <= 1)
        & (even | (pick("m_ent") - F.col("entropy") <= away * F.greatest(bands.spread * pick("s_ent"), F.lit(bands.least_bits))))
        & (F.col("byte_share") <= pick("m_byte") + wide * bands.most_bytes)
        & (F.col("entropy") >= bands.floor_bits)
    )
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(fits, F.lit(False))).select(*measured.columns, "base_failed", "kept")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, bands: Bands = Bands()) -> DataFrame:
    """One row per document: id, measures, ``base_failed`` and ``kept``."""
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text"))
    measured = materialise(measures(narrow, "text", ["doc_id", "lang"], vocabulary, bands), "fertility")
    judged = judge(measured, "row.lang", bands)
    return judged.select("row.doc_id", *[x.split()[0] for x in MEASURES.split(", ")], "base_failed", "kept")


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with all their columns."""
    measured = materialise(measures(docs, text_col, None, vocabulary, bands), "fertility")
    return judge(measured, f"row.`{lang_col}`", bands).filter("kept").select("row.*")
