"""Feeds and pages from a landing zone: files that a fetcher outside Spark has written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEED = "title string, link string, description string, author string, category array<string>, pubDate string, updated string, guid string"


def read_feed(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Entries of RSS files under *path*, one row per entry; missing elements are null."""
    return spark.read.schema(FEED).option("rowTag", row_tag).option("ignoreNamespace", "true").xml(path)


def category(tags: Column, most: int = 120) -> Column:
    """The first category that isn't blank."""
    return F.substring(F.get(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != ""), F.lit(0)), 1, most)


def published(*candidates: Column) -> Column:
    """The first candidate that is an RFC 822 or ISO time."""
    forms = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd HH:mm:ss")
    plain = lambda c: F.regexp_replace(F.trim(c), "^[A-Za-z]{3}, *", "")
    return F.coalesce(*(F.try_to_timestamp(plain(c), F.lit(f)) for c in candidates for f in forms))


def new_entries(entries: DataFrame, stored: DataFrame, key: Column, stored_key: str) -> DataFrame:
    """Entries with a title whose key isn't stored; of equal keys one (the least title)."""
    rows = entries.where(F.col("title").isNotNull() & (F.trim("title") != "")).withColumn("_k", key).where(F.col("_k").isNotNull())
    fresh = rows.join(stored.select(F.col(stored_key).alias("_k")).distinct(), "_k", "left_anti")
    return fresh.groupBy("_k").agg(F.min_by(F.struct(*entries.columns), "title").alias("e")).select("e.*")
