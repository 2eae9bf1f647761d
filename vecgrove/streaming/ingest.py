"""Structured Streaming into an index: each micro-batch is one atomic batch of upserts and deletes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vecgrove.errors import invalid


def latest(changes: DataFrame, key: str = "id", order: tuple[str, ...] = ("ts", "seq")) -> DataFrame:
    """The last change of each key; ties are for the caller's order columns to settle."""
    newest = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def ingest(stream: DataFrame, apply: Callable[[DataFrame], None], checkpoint: str, key: str = "id", order: tuple[str, ...] = ("ts", "seq")) -> StreamingQuery:
    """Starts a query that hands the last change of each key in a micro-batch to ``apply`` as (pos, op, ...).

    A micro-batch that runs again after a failure upserts and deletes the same, so the result is as if it ran once.  Inserts
    are refused: the second time they would fail for good.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        rows = latest(batch, key, order).drop(*order).withColumn("pos", F.monotonically_increasing_id())
        if not rows.filter("op = 'insert'").isEmpty():
            raise invalid("insert in a stream")
        if not rows.isEmpty():
            apply(rows)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
