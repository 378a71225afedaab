"""Structured Streaming over the event files: windows, sessions, deduplication.

Each function runs the stream over what is there (``availableNow``) with its checkpoint
and sink in the shared folder, and returns the sink's table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.sources.storage import new_path, table


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    # windows need an instant; the session's time zone is the files'
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def run(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """Drain *stream* into a Parquet table and read it."""
    spark = stream.sparkSession
    out, log = new_path(spark, name), new_path(spark, f"{name}-log")
    if mode == "append":
        writer = stream.writeStream.format("parquet").option("path", out)
    else:
        writer = stream.writeStream.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    q = writer.outputMode(mode).option("checkpointLocation", log).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def windowed(stream: DataFrame, size: str, slide: str | None, delay: str = "7 days") -> DataFrame:
    """Counts and sums by window and type; rows later than *delay* are left out."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = stream.withWatermark("ts", delay).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, gap: str, delay: str = "7 days") -> DataFrame:
    g = stream.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), "n")


def first_of_each(stream: DataFrame, keys: list[str], delay: str = "40 days") -> DataFrame:
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(keys)


Drain = Callable[[SparkSession, str], DataFrame]
