"""Views that let the provided tables stand in for coverage data.

Each view exists twice: as a DataFrame here and as a common table expression for the
oracle (``ORACLE_VIEWS``).  All times derive from the fixed ``AS_OF``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heronlake.sources.storage import table

AS_OF = "2024-01-31 00:00:00"
def now() -> F.Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def hours_before(hours) -> F.Column:
    return now() - F.make_dt_interval(hours=hours)


class Tables:
    """The provided tables and the views over them, read lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getitem__(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def sources(self) -> DataFrame:
        """Outlets: the distinct sources of documents; attributes by their number."""
        n = F.substring("source", 4, 10).cast("int")
        return self["documents"].select("source").distinct().select(
            F.col("source").alias("source_id"), F.concat(F.lit("Outlet "), n).alias("name"),
            F.when(n % 2 == 0, "inside").otherwise("outside").alias("production_location"),
            F.when(n % 5 == 0, "hardline").when(n % 5 == 1, "opposition").when(n % 5 == 2, "reformist").when(n % 5 == 3, "monarchist").alias("factional_alignment"),
            F.when(n % 4 == 0, "state").when(n % 4 == 1, "diaspora").when(n % 4 == 2, "independent").otherwise("semi_state").alias("state_alignment"),
            hours_before(n * 72).alias("created_at"),
            F.when(n % 3 == 0, '{"allowed": ["news", "analysis"]}').when(n % 3 == 1, '{"allowed": ["news"]}').otherwise('{"allowed": ["news", "opinion", "sport"]}').alias("content_filters"),
        )

    @cached_property
    def articles(self) -> DataFrame:
        """Documents; those with a vector of the same number belong to the story of its label.

        ``cluster_no`` parts every sixty of them into ten clusters by length; two in forty of an outlet share an address: so both
        grow with the data.
        """
        # titles are cut before the join, so that queries without bodies don't shuffle whole texts
        d = self["documents"].select("doc_id", "text", "lang", "source", "n_chars", F.substring("text", 1, 80).alias("title"))
        e = self["embeddings"].select(F.col("vec_id").alias("doc_id"), "embedding", "label")
        i = F.col("doc_id")
        ingested = hours_before((i % 720).cast("int"))
        return d.join(e, "doc_id", "left").select(
            i.alias("article_id"), F.col("source").alias("source_id"), F.col("label").alias("story_id"),
            "title", F.col("text").alias("body"), F.col("lang").alias("language"), "n_chars",
            F.when(i % 5 == 0, "news").when(i % 5 == 1, "opinion").when(i % 5 == 2, "analysis").when(i % 5 == 3, "sport").alias("content_type"),
            ingested.alias("ingested_at"),
            F.when(i % 17 != 0, hours_before((i % 720 + i % 5).cast("int"))).alias("published_at"),
            F.concat(F.lit("https://"), "source", F.lit(".example/a/"), F.floor(i / 40) * 20 + i % 20).alias("url"), "embedding",
            (F.floor(i / 60) * 10 + F.col("n_chars") % 10).alias("cluster_no"),
        )

    @cached_property
    def stories(self) -> DataFrame:
        a = self.articles.where("story_id IS NOT NULL")
        s = F.col("story_id")
        return a.groupBy("story_id").agg(
            F.count("*").alias("article_count"), F.countDistinct("source_id").alias("source_count"),
            F.min("published_at").alias("first_published_at"), F.max("ingested_at").alias("last_updated_at"),
        ).withColumns({"priority": F.when(s % 5 == 0, 50).when(s % 5 == 1, -50).otherwise(0), "frozen_at": F.when(s % 4 == 0, hours_before((s * 30).cast("int")))})

    @cached_property
    def posts(self) -> DataFrame:
        """Channel posts: turns of conversations; the channel is the conversation."""
        c = self["conversations"]
        return c.select(
            F.col("conv_id").alias("channel_id"), F.col("turn").alias("message_id"), "text", "role",
            (F.col("conv_id") % 10).cast("int").alias("story_id"), hours_before(((F.col("conv_id") * 7 + F.col("turn")) % 720).cast("int")).alias("date"),
            F.when(F.col("turn") % 3 != 2, F.length("text") * 3).alias("views"),
            F.when(F.col("turn") % 4 != 3, (F.length("text") % 21 - 10) / 10).alias("sentiment"),
        )

    @cached_property
    def usage(self) -> DataFrame:
        """The usage ledger: events; their type is the purpose, their value the cost."""
        e = self["events"]
        model = F.when(F.col("user_id") % 3 == 0, "mini-2024-07-18").when(F.col("user_id") % 3 == 1, "mini-pro-1").otherwise("large")
        return e.select("event_id", "ts", F.col("event_type").alias("purpose"), model.alias("model"), F.col("value").alias("cost"), "user_id", (F.col("event_id") % 10).cast("int").alias("story_id"), "props")


ORACLE_VIEWS = """
v_sources AS (
  SELECT source AS source_id, 'Outlet ' || n AS name, CASE WHEN n % 2 = 0 THEN 'inside' ELSE 'outside' END AS production_location,
    CASE n % 5 WHEN 0 THEN 'hardline' WHEN 1 THEN 'opposition' WHEN 2 THEN 'reformist' WHEN 3 THEN 'monarchist' END AS factional_alignment,
    CASE n % 4 WHEN 0 THEN 'state' WHEN 1 THEN 'diaspora' WHEN 2 THEN 'independent' ELSE 'semi_state' END AS state_alignment,
    TIMESTAMP '2024-01-31' - to_hours(n * 72) AS created_at,
    CASE n % 3 WHEN 0 THEN ['news', 'analysis'] WHEN 1 THEN ['news'] ELSE ['news', 'opinion', 'sport'] END AS allowed
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS n FROM documents)),
v_articles AS (
  SELECT doc_id AS article_id, source AS source_id, label AS story_id, substr(text, 1, 80) AS title, text AS body, lang AS language, n_chars,
    CASE doc_id % 5 WHEN 0 THEN 'news' WHEN 1 THEN 'opinion' WHEN 2 THEN 'analysis' WHEN 3 THEN 'sport' END AS content_type,
    TIMESTAMP '2024-01-31' - to_hours(CAST(doc_id % 720 AS INTEGER)) AS ingested_at,
    CASE WHEN doc_id % 17 <> 0 THEN TIMESTAMP '2024-01-31' - to_hours(CAST(doc_id % 720 + doc_id % 5 AS INTEGER)) END AS published_at,
    'https://' || source || '.example/a/' || (doc_id // 40 * 20 + doc_id % 20) AS url, embedding,
    doc_id // 60 * 10 + n_chars % 10 AS cluster_no
  FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
v_stories AS (
  SELECT story_id, count(*) AS article_count, count(DISTINCT source_id) AS source_count, min(published_at) AS first_published_at, max(ingested_at) AS last_updated_at,
    CASE story_id % 5 WHEN 0 THEN 50 WHEN 1 THEN -50 ELSE 0 END AS priority,
    CASE WHEN story_id % 4 = 0 THEN TIMESTAMP '2024-01-31' - to_hours(CAST(story_id * 30 AS INTEGER)) END AS frozen_at
  FROM v_articles WHERE story_id IS NOT NULL GROUP BY story_id),
v_posts AS (
  SELECT conv_id AS channel_id, turn AS message_id, text, role, CAST(conv_id % 10 AS INTEGER) AS story_id,
    TIMESTAMP '2024-01-31' - to_hours(CAST((conv_id * 7 + turn) % 720 AS INTEGER)) AS date,
    CASE WHEN turn % 3 <> 2 THEN length(text) * 3 END AS views,
    CASE WHEN turn % 4 <> 3 THEN (length(text) % 21 - 10) / 10 END AS sentiment
  FROM conversations),
v_usage AS (
  SELECT event_id, ts, event_type AS purpose, CASE user_id % 3 WHEN 0 THEN 'mini-2024-07-18' WHEN 1 THEN 'mini-pro-1' ELSE 'large' END AS model,
    value AS cost, user_id, CAST(event_id % 10 AS INTEGER) AS story_id, props
  FROM events)
"""
