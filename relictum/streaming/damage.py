"""Damage counts over a stream of alignments. Counts are sums, so each micro-batch adds its own to a table of totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def totals(parts: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """What the appended parts add up to. A repeated batch counts once: parts carry their batch number."""
    return parts.dropDuplicates(["batch", *keys]).groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def stream(rows: DataFrame, count: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Appends count(batch), with the batch's number, to a Parquet table; a batch that is run again replaces its own part."""

    def each(batch: DataFrame, number: int) -> None:
        count(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    return rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
