"""A training-corpus pipeline of five stages; each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of their input, extra ones and clashing names included.  Defined results: null and empty
texts go in the first stage (too few words), and so in run(); each stage by itself takes them, null ids and sources and
repeated rows as its operator says; an empty table, or an empty benchmark, goes through; ties are settled by the
operators (the least id stays of a group of copies).  ``run`` removes what a stage has written once the next one is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecgrove.llm import decontaminate_fm, mix_poisson, near_copies, quality_fertility, token_output
from vecgrove.llm.common import new_folder, remove, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_fertility.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, one stays."""
    return near_copies.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out."""
    return decontaminate_fm.remove_spans(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in equal shares, by repetition as often as that takes."""
    return mix_poisson.mixture(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of token ids, read back; each shard is a run of the mixture, which sorting all by id would undo."""
    return token_output.token_output(docs, settings=token_output.Settings(ordered=False))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = new_folder(spark, f"pipeline-{name}")
        made = stage(spark, docs, sf_dir)
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before is not None:
            remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None
"""Sentence-piece fertility, fingerprints and tokenisers aren't SQL: tests hold the stages against brute force."""


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
