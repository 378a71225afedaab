"""Streams of several micro-batches over given rows, and sinks that take each batch once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.sources.sink import KeyedTable
from heronlake.sources.storage import new_path


def deal(rows: DataFrame, part: Column, parts: range, folder: str) -> None:
    """Write the rows of each of *parts* into *folder* as files of their own, in that order."""
    for i in parts:
        rows.where(part == i).coalesce(1).write.mode("append").parquet(folder)


def source(spark: SparkSession, like: DataFrame, folder: str) -> DataFrame:
    """One file a micro-batch, the oldest first."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> list[dict]:
    """Run *stream* over all there is, *each* on every micro-batch; returns the progress of each.

    Starting again with the same *checkpoint* goes on where the last run ended; a batch
    that failed comes again under the same number.
    """
    q = stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        progress = q.recentProgress
        q.stop()
    return progress


def once_into(table: KeyedTable, name: str, order: str) -> Callable[[DataFrame, int], None]:
    """Adds each micro-batch to *table* under its number."""

    def each(batch: DataFrame, number: int) -> None:
        table.insert(batch, f"{name}-{number:09d}", order)

    return each


class Latest:
    """A table of the newest row per key, from batches that write whole rows again and again."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, new_path(spark, name)

    def each(self, batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/batch={number:09d}")

    def read(self, keys: list[str], order: list[str]) -> DataFrame:
        rows = self.spark.read.parquet(self.path).drop("batch")
        rest = [c for c in rows.columns if c not in (*keys, "_batch")]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_batch", *order)).alias("r")).select(*keys, "r.*")
