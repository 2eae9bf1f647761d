"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests) gets a temporary folder; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="vecgrove-")
        sc.setCheckpointDir(path)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, kind: str = "stage") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what was written to the shared folder, once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


HOT = 10_000


def spread_join(rows: DataFrame, lookup: DataFrame, key: str, how: str = "inner", total: int | None = None) -> DataFrame:
    """``rows`` joined to ``lookup``, which has one row per key at most, so that no hot key lands in one task.

    A key is hot if it holds more than one in HOT of the rows (``total``, counted if not given).  There are fewer than HOT
    of them, which bounds what is broadcast at any size; the rows of all other keys are shuffled.  Both frames should
    be cheap to read again.
    """
    total = rows.count() if total is None else total
    hot = F.broadcast(rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") * HOT > total).select(key))
    few = F.broadcast(lookup.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(few, key, how).unionByName(rows.join(hot, key, "left_anti").join(lookup, key, how))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def total_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return int(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0)


def unit_hash(*cols: Column | str) -> Column:
    """A uniform number in [0, 1) of 52 bits from the MD5 of the columns' text form (any engine has MD5)."""
    text = F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
