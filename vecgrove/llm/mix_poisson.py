"""Mixing sources to target weights by Poisson replication, as DataFrame functions only.

A source's mean repetition rate is its target share of the budget over what it has.  A uniform number hashed from
the seed, the id and the text goes through the inverse of the Poisson distribution with that mean: the number of
probabilities, summed up, that it exceeds; a large mean is the sum of several such.  A rate is as high as its target
takes.  Only with ``most_rate``, an option, is it cut; the source then misses its target and the mixture its budget,
and ``rates`` gives what was asked for and what is reached.  Each document is exploded by its count and all copies are shuffled
by a hash of document and copy, so that any partition, and any run of rows within one, is a fair mixture.

Per-source sums combine before the shuffle and come back by a join that Spark broadcasts if they are small; a hot
source is never one task's.  Defined results: a null source is a source of its own; a source without a target has
``default_weight``; a null or empty text counts as one character; repeated rows get the same count each; extra
columns are kept by ``replicate``; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecgrove.llm.common import materialise, unit_hash


@dataclass(frozen=True)
class Settings:
    weights: Mapping[str, float] = field(default_factory=dict)
    """Target shares, relative to each other."""
    default_weight: float = 1.0
    budget: float = 1.0
    """Characters of the mixture, as a multiple of the input's."""
    most_rate: float | None = None
    """None: a source is repeated as often as its target takes; else no more often than this in the mean."""
    seed: int = 17


def rates(docs: DataFrame, source_col: str = "source", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """mix_source, its characters, the mean repetition rate, and its shares of the budget: asked for and reached in the mean."""
    chars = F.greatest(F.coalesce(F.length(F.col(f"`{text_col}`")), F.lit(0)), F.lit(1))
    per = docs.groupBy(F.col(f"`{source_col}`").cast("string").alias("mix_source")).agg(F.sum(chars).cast("long").alias("chars"))
    weight = F.lit(float(settings.default_weight))
    for name, value in settings.weights.items():
        weight = F.when(F.col("mix_source") == name, F.lit(float(value))).otherwise(weight)
    per = per.withColumn("weight", weight)
    total = per.agg(F.sum("chars").alias("all_chars"), F.sum("weight").alias("all_weight"))
    # One row joined to the sources: a sum over them, not a product of tables.
    both = per.withColumn("one", F.lit(1)).join(total.withColumn("one", F.lit(1)), "one")
    rate = F.lit(settings.budget) * F.col("all_chars") * (F.col("weight") / F.col("all_weight")) / F.col("chars")
    if settings.most_rate is not None:
        rate = F.least(F.lit(settings.most_rate), rate)
    reached = rate * F.col("chars") / (F.lit(settings.budget) * F.col("all_chars"))
    return both.select("mix_source", "chars", rate.alias("rate"), (F.col("weight") / F.col("all_weight")).alias("asked"), reached.alias("reached"))


PART = 64.0
"""A larger mean is cut into parts of at most this, as exp(-rate) would vanish."""


def poisson(u: Column, rate: Column, most: int | Column) -> Column:
    """The least k with P(X <= k) > u; ``most`` bounds it far in the tail."""
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("cdf"), F.lit(0).alias("k"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * rate / i
        return F.struct(p.alias("p"), (acc["cdf"] + p).alias("cdf"), (acc["k"] + F.when(u >= acc["cdf"], 1).otherwise(0)).alias("k"))

    return F.aggregate(F.sequence(F.lit(1), most if isinstance(most, Column) else F.lit(most)), start, step, lambda acc: acc["k"])


def replicate(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """A struct ``row`` of the document, mix_copies, mix_copy (from 0) and mix_order (the shuffle's key), shuffled."""
    # Written first, so that Spark knows its size when it chooses how to join it to the texts.
    per = materialise(rates(docs, source_col, text_col, settings), "rates")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    seeded = unit_hash(F.lit(settings.seed), F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.lit("")), F.md5(F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))))
    rate = F.col("rate")

    def tail(of: Column) -> Column:
        return F.ceil(of + 12 * F.sqrt(F.greatest(F.lit(1.0), of)) + 12).cast("int")

    if settings.most_rate is None or settings.most_rate > PART:
        parts = F.ceil(rate / PART).cast("int")
        several = F.aggregate(F.sequence(F.lit(1), parts), F.lit(0), lambda n, i: n + poisson(unit_hash(F.format_string("%.17g", "u"), i), rate / parts, tail(rate / parts)))
        number = F.when(rate <= PART, poisson(F.col("u"), rate, tail(rate))).otherwise(several)
    else:
        number = poisson(F.col("u"), rate, int(settings.most_rate + 12 * max(1.0, settings.most_rate) ** 0.5 + 12))
    joined = packed.join(per, F.col(f"row.`{source_col}`").cast("string").eqNullSafe(F.col("mix_source")))
    counted = joined.select("row", "rate", seeded.alias("u")).select("row", "u", number.alias("mix_copies")).filter("mix_copies > 0")
    copies = counted.withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)))
    keyed = copies.select("row", "mix_copies", "mix_copy", F.md5(F.concat_ws(":", F.format_string("%.17g", "u"), F.col("mix_copy").cast("string"))).alias("mix_order"))
    return keyed.repartition("mix_order").sortWithinPartitions("mix_order")


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The copies with the documents' columns alone, in shuffled order."""
    return replicate(docs, id_col, source_col, text_col, settings).select("row.*")


ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, source, text, greatest(coalesce(length(text), 0), 1) AS chars,
         ('0x' || substr(md5('17:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))), 1, 13))::bigint / 4503599627370496.0::double AS u
  FROM documents
), s AS (
  SELECT source, sum(chars)::bigint AS chars FROM d GROUP BY source
), t AS (
  SELECT sum(chars)::double AS all_chars, count(*)::double AS all_weight FROM s
), r AS (
  SELECT source, all_chars * (1.0::double / all_weight) / chars AS rate FROM s, t
), k AS (
  SELECT source, i, sum(exp(-rate + j * ln(rate) - lgamma(j + 1))) AS cdf
  FROM r, range(0, 120) a(i), range(0, 120) b(j) WHERE j <= i GROUP BY source, i
), p AS (
  SELECT d.doc_id, d.source, d.text, count(k.i) AS copies
  FROM d LEFT JOIN k ON d.source IS NOT DISTINCT FROM k.source AND d.u >= k.cdf GROUP BY ALL
)
SELECT doc_id, source, copies::int AS copies, copy::int AS copy, md5(coalesce(text, '')) AS text_md5
FROM p, LATERAL (SELECT unnest(range(0, copies)) AS copy)
"""
