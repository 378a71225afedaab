"""Reader feedback: consensus, trust, negative pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.functions import scores
from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables

#: Feedback: clicks and errors stand for readers' reports; ten event numbers in a row share a target.
REPORT_SQL = ", reports AS (SELECT event_id // 10 AS target, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'c' || user_id % 9 END AS cookie, 'f' || user_id % 5 AS fingerprint, ts, event_type FROM events WHERE event_type IN ('click', 'error'))\n"


def reports(t: Tables) -> DataFrame:
    return t["events"].where("event_type IN ('click', 'error')").select(
        F.floor(F.col("event_id") / 10).alias("target"), F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("c"), F.col("user_id") % 9)).alias("cookie"), F.concat(F.lit("f"), F.col("user_id") % 5).alias("fingerprint"), "ts", "event_type")


@query("A27", REPORT_SQL + "SELECT target, count(DISTINCT coalesce(cookie, fingerprint)) AS identities FROM reports GROUP BY target HAVING count(DISTINCT coalesce(cookie, fingerprint)) >= 3")
def consensus(t: Tables) -> DataFrame:
    """Targets that three or more identities report."""
    return reports(t).groupBy("target").agg(F.countDistinct(F.coalesce("cookie", "fingerprint")).alias("identities")).where("identities >= 3")


@query("A28", REPORT_SQL + "SELECT target FROM reports WHERE ts < TIMESTAMP '2024-01-17' GROUP BY target HAVING count(DISTINCT coalesce(cookie, fingerprint)) < 3")
def aged_out_feedback(t: Tables) -> DataFrame:
    """Targets whose reports over 14 days old never found three identities."""
    old = reports(t).where("ts < TIMESTAMP_NTZ '2024-01-17 00:00:00'").groupBy("target").agg(F.countDistinct(F.coalesce("cookie", "fingerprint")).alias("n"))
    return old.where("n < 3").select("target")


@query("A34 A25", REPORT_SQL + "SELECT event_type, count(*) AS total, count(*) FILTER (ts >= TIMESTAMP '2024-01-24') AS fresh, count(DISTINCT fingerprint) AS identities, min(ts) AS oldest FROM reports GROUP BY event_type")
def feedback_health(t: Tables) -> DataFrame:
    return reports(t).groupBy("event_type").agg(F.count("*").alias("total"), F.count_if(F.expr("ts >= TIMESTAMP_NTZ '2024-01-24 00:00:00'")).alias("fresh"), F.countDistinct("fingerprint").alias("identities"), F.min("ts").alias("oldest"))


TRUST_SQL = """
, r AS (SELECT source_id, count(*) AS total, count(*) FILTER (toxic = 1) AS flagged FROM v_articles JOIN labels ON doc_id = article_id GROUP BY source_id HAVING count(*) >= 10)
, m AS (SELECT list_sort(list(flagged / total))[len(list(flagged / total)) // 2 + 1] AS median FROM r JOIN v_sources USING (source_id) WHERE created_at < TIMESTAMP '2024-01-01')
"""


@query("A31 F65", TRUST_SQL + """SELECT source_id, total, flagged, round_even(least(1.0::DOUBLE, CASE WHEN flagged = 0 THEN 0.9::DOUBLE + 0.05::DOUBLE WHEN flagged / total > 3 * greatest(median, 0.01::DOUBLE) THEN greatest(0.5::DOUBLE, 1 - 2 * (flagged / total - median)) ELSE 0.9::DOUBLE + 0.05::DOUBLE END), 3) AS trust FROM r CROSS JOIN m""")
def source_trust(t: Tables) -> DataFrame:
    """Trust after a review: rate of flagged articles against the upper median of established outlets."""
    j = t["labels"].join(t.articles.select(F.col("article_id").alias("doc_id"), "source_id"), "doc_id")
    r = j.groupBy("source_id").agg(F.count("*").alias("total"), F.count_if(F.col("toxic") == 1).alias("flagged")).where("total >= 10")
    old = r.join(t.sources.where("created_at < TIMESTAMP_NTZ '2024-01-01 00:00:00'").select("source_id"), "source_id")
    # one rate per outlet
    rates = F.array_sort(F.collect_list(F.col("flagged") / F.col("total")))
    median = old.agg(F.get(rates, F.floor(F.size(rates) / 2).cast("int")).alias("median"))
    return r.join(F.broadcast(median)).select("source_id", "total", "flagged", scores.trust(F.lit(0.9), F.col("flagged"), F.col("total"), F.col("median")).alias("trust"))


@query("A32", """SELECT source_id, count(*) FILTER (article_id % 720 < 48) AS recent, count(*) FILTER (article_id % 720 < 48 AND toxic = 1) AS recent_flagged, count(*) FILTER (toxic = 1) / count(*) AS rate FROM v_articles JOIN labels ON doc_id = article_id GROUP BY source_id""")
def source_trust_fast(t: Tables) -> DataFrame:
    """Recent and long-run rates per outlet in one pass (two days at test scale)."""
    j = t["labels"].join(t.articles.select(F.col("article_id").alias("doc_id"), "source_id"), "doc_id")
    new = F.col("doc_id") % 720 < 48
    return j.groupBy("source_id").agg(F.count_if(new).alias("recent"), F.count_if(new & (F.col("toxic") == 1)).alias("recent_flagged"), (F.count_if(F.col("toxic") == 1) / F.count("*")).alias("rate"))


@query("J10", "SELECT article_id FROM v_articles a WHERE NOT EXISTS (SELECT 1 FROM v_articles b JOIN labels ON doc_id = b.article_id WHERE b.source_id = a.source_id AND b.story_id = a.story_id) AND a.story_id IS NOT NULL")
def unscored_pairs(t: Tables) -> DataFrame:
    """Articles whose outlet and story have no scored article yet."""
    a = t.articles.where("story_id IS NOT NULL").select("article_id", "source_id", "story_id")
    done = a.join(t["labels"].select(F.col("doc_id").alias("article_id")), "article_id", "left_semi").select("source_id", "story_id").distinct()
    return a.join(done, ["source_id", "story_id"], "left_anti").select("article_id")


@query("J11 J12", """
, neg AS (SELECT CAST(event_id % 500 AS BIGINT) AS article_id, event_id % 10 AS story_id FROM events WHERE event_type = 'error' UNION SELECT doc_id, CAST(doc_id % 10 AS BIGINT) FROM labels WHERE toxic = 1 UNION SELECT TRY_CAST(substr(props, 7, 2) AS BIGINT), 3 FROM events WHERE event_type = 'signup')
SELECT story_id, count(*) AS n FROM v_articles a WHERE story_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM neg WHERE neg.article_id = a.article_id AND neg.story_id = a.story_id) GROUP BY story_id""")
def negative_pairs(t: Tables) -> DataFrame:
    """Pairs of article and story without a rejection; three signals, one of them text that may not be a number."""
    e, pair = t["events"], lambda df, a, s: df.select(a.cast("long").alias("article_id"), s.cast("long").alias("story_id"))
    neg = pair(e.where("event_type = 'error'"), F.col("event_id") % 500, F.col("event_id") % 10)
    neg = neg.unionByName(pair(t["labels"].where("toxic = 1"), F.col("doc_id"), F.col("doc_id") % 10))
    neg = neg.unionByName(e.where("event_type = 'signup'").select(F.expr("try_cast(substr(props, 7, 2) AS bigint)").alias("article_id"), F.lit(3).cast("long").alias("story_id"))).distinct()
    a = t.articles.where("story_id IS NOT NULL").select("article_id", F.col("story_id").cast("long").alias("story_id"))
    return a.join(neg, ["article_id", "story_id"], "left_anti").groupBy("story_id").agg(F.count("*").alias("n"))


@query("J8", "SELECT source_id, count(*) AS flagged FROM v_articles a WHERE EXISTS (SELECT 1 FROM labels WHERE doc_id = article_id AND toxic = 1) OR EXISTS (SELECT 1 FROM events WHERE event_id // 40 = article_id AND event_type = 'error') GROUP BY source_id")
def flagged_by_either(t: Tables) -> DataFrame:
    """Articles rejected by a rater or by readers: one semi join with the union of keys."""
    keys = t["labels"].where("toxic = 1").select(F.col("doc_id").alias("article_id")).union(t["events"].where("event_type = 'error'").select(F.floor(F.col("event_id") / 40).alias("article_id")))
    return t.articles.select("article_id", "source_id").join(keys.distinct(), "article_id", "left_semi").groupBy("source_id").agg(F.count("*").alias("flagged"))


@query("A40", REPORT_SQL + "SELECT event_type, count(*) AS incidents, count(DISTINCT fingerprint) AS slugs, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM reports GROUP BY event_type")
def intervention_rate(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    g = reports(t).groupBy("event_type").agg(F.count("*").alias("incidents"), F.countDistinct("fingerprint").alias("slugs"))
    return g.withColumn("share", F.round(F.col("incidents") / F.sum("incidents").over(Window.partitionBy()), 6))
