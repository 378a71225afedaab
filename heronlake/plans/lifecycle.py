"""Ageing of stories, retention, capacity, and the health overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions import scores
from heronlake.plans.ranking import CLUSTER_SQL, clusters, eligible, scored
from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables, hours_before, now

AGE = "date_diff('second', {}, TIMESTAMP '2024-01-31') / 86400.0::DOUBLE"


@query("P24 T10 M41", CLUSTER_SQL + f"""SELECT cluster_id, CASE WHEN {AGE.format('last_updated_at')} > 60 AND article_count < 3 THEN 'deleted' WHEN {AGE.format('last_updated_at')} > 30 THEN 'archived'
 WHEN frozen_at IS NOT NULL OR article_count > 100 OR ({AGE.format('last_updated_at')} > 7 AND {AGE.format('first_published_at')} > 1) THEN 'frozen' ELSE 'active' END AS state FROM clusters""")
def lifecycle_states(t: Tables) -> DataFrame:
    return clusters(t).select("cluster_id", scores.lifecycle(F.col("article_count"), F.col("last_updated_at"), F.col("first_published_at"), F.col("frozen_at"), now()).alias("state"))


@query("T11", CLUSTER_SQL + """, recent AS (SELECT cluster_no AS cluster_id, count(*) AS n FROM v_articles WHERE ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR GROUP BY 1)
SELECT cluster_id, priority AS old_priority, CASE WHEN frozen_at IS NULL THEN priority WHEN coalesce(n, 0) >= 2 THEN 0 ELSE -50 END AS new_priority FROM clusters LEFT JOIN recent USING (cluster_id)""")
def demote_quiet(t: Tables) -> DataFrame:
    """Frozen stories drop to -50 until enough articles come in two days (test value two)."""
    recent = t.articles.where(F.col("ingested_at") >= hours_before(F.lit(48))).groupBy(F.col("cluster_no").alias("cluster_id")).agg(F.count("*").alias("n"))
    new = F.when(F.col("frozen_at").isNull(), F.col("priority")).when(F.coalesce("n", F.lit(0)) >= 2, 0).otherwise(-50)
    return clusters(t).join(recent, "cluster_id", "left").select("cluster_id", F.col("priority").alias("old_priority"), new.alias("new_priority"))


@query("P25", CLUSTER_SQL + f"SELECT cluster_id FROM clusters WHERE (article_count <= 8 AND {AGE.format('last_updated_at')} > 2) OR (article_count BETWEEN 9 AND 11 AND {AGE.format('last_updated_at')} > 0.5::DOUBLE)")
def stagnant_stories(t: Tables) -> DataFrame:
    """Small stories that got nothing new (test sizes)."""
    age = scores.days_between(now(), F.col("last_updated_at"))
    return clusters(t).where(((F.col("article_count") <= 8) & (age > 2)) | (F.col("article_count").between(9, 11) & (age > 0.5))).select("cluster_id")


@query("P27", "SELECT event_type, count(*) FILTER (ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS kept, count(*) FILTER (ts < TIMESTAMP '2024-01-31' - INTERVAL 7 DAY) AS dropped FROM events GROUP BY event_type")
def retention_audit(t: Tables) -> DataFrame:
    old = F.expr("ts < TIMESTAMP_NTZ '2024-01-24 00:00:00'")
    return t["events"].groupBy("event_type").agg(F.count_if(~old).alias("kept"), F.count_if(old).alias("dropped"))


@query("T4", "SELECT source_id, count(*) AS n FROM v_articles WHERE story_id IS NULL AND ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR AND (published_at IS NULL OR published_at >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR) AND content_type IS NOT NULL GROUP BY source_id")
def candidate_pool(t: Tables) -> DataFrame:
    """Unclustered articles that are fresh on both clocks; no publication time passes."""
    week = hours_before(F.lit(168))
    a = t.articles.where(F.col("story_id").isNull() & (F.col("ingested_at") >= week) & (F.col("published_at").isNull() | (F.col("published_at") >= week)) & F.col("content_type").isNotNull())
    return a.groupBy("source_id").agg(F.count("*").alias("n"))


@query("P6", "SELECT CASE WHEN l.doc_id IS NOT NULL THEN 'rated' WHEN e.vec_id IS NOT NULL THEN 'vector' ELSE 'free' END AS blocked_by, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.n_chars < 900 GROUP BY 1")
def safe_delete(t: Tables) -> DataFrame:
    """Rows to delete, with what still refers to the blocked ones."""
    d = t["documents"].where("n_chars < 900").select("doc_id")
    rated, vector = t["labels"].select("doc_id").distinct().withColumn("r", F.lit(True)), t["embeddings"].select(F.col("vec_id").alias("doc_id")).distinct().withColumn("v", F.lit(True))
    j = d.join(rated, "doc_id", "left").join(vector, "doc_id", "left")
    return j.groupBy(F.when(F.col("r"), "rated").when(F.col("v"), "vector").otherwise("free").alias("blocked_by")).agg(F.count("*").alias("n"))


#: Aggregates behind the canaries, per table; their text is SQL of Spark and of the oracle alike.
CHECKS = {
    "s": {
        "total": "count(*)", "active": "count(*) FILTER (WHERE frozen_at IS NULL AND archived_at IS NULL)", "frozen": "count(*) FILTER (WHERE frozen_at IS NOT NULL)", "archived": "count(*) FILTER (WHERE archived_at IS NOT NULL)", "edited": "count(*) FILTER (WHERE is_edited)",
        "oversized": "count(*) FILTER (WHERE frozen_at IS NULL AND article_count >= 30)", "grabbag": "count(*) FILTER (WHERE archived_at IS NULL AND priority > -100 AND article_count >= 120)", "joined_titles": "count(*) FILTER (WHERE title LIKE '%, %' AND NOT is_edited AND article_count BETWEEN 12 AND 119)",
        "fresh_pool": "count(*) FILTER (WHERE archived_at IS NULL AND priority > -100 AND article_count >= 5 AND last_updated_at >= TIMESTAMP '2024-01-24 00:00:00')", "state_pool": "count(*) FILTER (WHERE state_count > 0 AND diaspora_count * 100 <= 30 * (state_count + diaspora_count))", "diaspora_pool": "count(*) FILTER (WHERE diaspora_count > 0 AND state_count * 100 <= 30 * (state_count + diaspora_count))",
        "visible": "count(*) FILTER (WHERE archived_at IS NULL AND priority > -100)", "visible_frozen": "count(*) FILTER (WHERE archived_at IS NULL AND priority > -100 AND frozen_at IS NOT NULL)", "live_hero": "count(*) FILTER (WHERE priority >= 40 AND frozen_at IS NULL AND archived_at IS NULL)",
        "bumped": "count(*) FILTER (WHERE frozen_at IS NOT NULL AND last_updated_at > frozen_at)", "undated": "count(*) FILTER (WHERE first_published_at IS NULL)", "new_stories": "count(*) FILTER (WHERE first_published_at >= TIMESTAMP '2024-01-30 00:00:00')",
    },
    "a": {
        "articles": "count(*)", "off_topic": "count(*) FILTER (WHERE visible AND content_type IS NOT NULL AND NOT allowed)", "day": "count(*) FILTER (WHERE ingested_at >= TIMESTAMP '2024-01-30 00:00:00')", "day_eligible": "count(*) FILTER (WHERE ingested_at >= TIMESTAMP '2024-01-30 00:00:00' AND allowed)", "day_missing": "count(*) FILTER (WHERE ingested_at >= TIMESTAMP '2024-01-30 00:00:00' AND allowed AND embedding IS NULL)",
        "day_zero": "count(*) FILTER (WHERE ingested_at >= TIMESTAMP '2024-01-30 00:00:00' AND zero)", "stuck": "count(*) FILTER (WHERE ingested_at >= TIMESTAMP '2024-01-17 00:00:00' AND embedding IS NULL)", "waiting": "count(*) FILTER (WHERE allowed AND story_id IS NULL AND ingested_at >= TIMESTAMP '2024-01-27 00:00:00' AND ingested_at < TIMESTAMP '2024-01-29 18:00:00')",
        "passed": "count(*) FILTER (WHERE allowed AND ingested_at >= TIMESTAMP '2024-01-27 00:00:00' AND ingested_at < TIMESTAMP '2024-01-29 18:00:00')", "untranslated": "count(*) FILTER (WHERE language <> 'en' AND (content_type IS NULL OR allowed) AND n_chars < 300)", "newest": "max(ingested_at)", "reporting": "count(DISTINCT CASE WHEN ingested_at >= TIMESTAMP '2024-01-24 00:00:00' THEN source_id END)", "outlets": "count(DISTINCT source_id)",
    },
    "u": {
        "today": "coalesce(sum(cost) FILTER (WHERE ts >= TIMESTAMP '2024-01-30 00:00:00'), 0.0)", "usual": "coalesce(sum(cost) FILTER (WHERE ts < TIMESTAMP '2024-01-30 00:00:00' AND ts >= TIMESTAMP '2024-01-23 00:00:00'), 0.0) / 7", "month": "coalesce(sum(cost), 0.0)", "unpriced": "count(*) FILTER (WHERE model = 'large' AND ts >= TIMESTAMP '2024-01-24 00:00:00')",
        "failures": "count(*) FILTER (WHERE purpose = 'error' AND ts >= TIMESTAMP '2024-01-30 18:00:00')", "failures_before": "count(*) FILTER (WHERE purpose = 'error' AND ts >= TIMESTAMP '2024-01-30 12:00:00' AND ts < TIMESTAMP '2024-01-30 18:00:00')", "last_call": "max(ts)",
    },
}
#: Canary: its value, when it is an error, when it warns.
CANARIES = {
    "oversized_active_stories": ("oversized", "oversized > 0", "false"),
    "homepage_grabbag": ("grabbag", "false", "grabbag > 0"),
    "midsize_grabbag_risk": ("joined_titles", "false", "joined_titles > 0"),
    "homepage_offtopic_leak": ("off_topic", "off_topic > 50", "off_topic > 10"),
    "homepage_fresh_pool": ("fresh_pool", "false", "fresh_pool < 8"),
    "stale_frozen_homepage": ("visible_frozen / greatest(visible, 1)", "false", "visible_frozen >= 0.8 * visible AND waiting >= 15 AND live_hero = 0"),
    "blindspot_fresh_pool": ("least(state_pool, diaspora_pool)", "false", "least(state_pool, diaspora_pool) < 1"),
    "frozen_recently_bumped": ("bumped", "bumped > 0", "false"),
    "embedding_zero_rate_24h": ("100.0 * day_zero / greatest(day, 1)", "100.0 * day_zero / greatest(day, 1) >= 10", "100.0 * day_zero / greatest(day, 1) >= 1"),
    "embedding_null_rate_24h": ("100.0 * day_missing / greatest(day_eligible, 1)", "100.0 * day_missing / greatest(day_eligible, 1) >= 10", "100.0 * day_missing / greatest(day_eligible, 1) >= 5"),
    "embedding_stuck_null_14d": ("stuck", "stuck >= 200", "stuck >= 50"),
    "clustering_halt": ("new_stories", "day >= 50 AND new_stories = 0", "false"),
    "breaking_news_unclustered": ("waiting", "false", "waiting >= 25 AND waiting >= 0.3 * passed"),
    "cost_anomaly_today": ("today / greatest(usual, 0.000001)", "false", "today > 1.5 * usual"),
    "monthly_budget": ("month * 31 / 30", "month * 31 / 30 > 300000", "month * 31 / 30 > 240000"),
    "budget_guard": ("month", "month >= 0.8 * 300000", "month >= 0.6 * 300000"),
    "unpriced_calls_7d": ("unpriced", "false", "unpriced > 0"),
    "ingest_silence": ("hours_silent", "hours_silent > 48", "hours_silent > 28"),
    "ghost_lock": ("minutes_idle", "minutes_idle > 30", "minutes_idle > 5"),
    "rss_silent_7d": ("outlets - reporting", "false", "outlets > reporting"),
    "null_first_published": ("undated", "false", "undated > 50"),
    "maintenance_fails_last_run": ("failures", "false", "failures > failures_before"),
    "translation_stuck": ("untranslated", "false", "untranslated > 200"),
}
CHECK_SQL = """
, base_a AS (SELECT a.*, list_contains(allowed, content_type) IS TRUE AS allowed, coalesce(len(list_filter(embedding, lambda x: x <> 0)) = 0, false) AS zero, e.cluster_id IS NOT NULL AS visible FROM v_articles a JOIN v_sources USING (source_id) LEFT JOIN eligible e ON e.cluster_id = cluster_no)
""" + "".join(f", agg_{k} AS (SELECT {', '.join(f'{e} AS {n}' for n, e in c.items())} FROM {base})" for (k, c), base in zip(CHECKS.items(), ("scored", "base_a", "v_usage"), strict=True)) + """
, checked AS (SELECT *, date_sub('second', newest, TIMESTAMP '2024-01-31') / 3600.0::DOUBLE AS hours_silent, date_sub('second', last_call, TIMESTAMP '2024-01-31') / 60.0::DOUBLE AS minutes_idle FROM agg_s, agg_a, agg_u)
"""


def checked(t: Tables) -> DataFrame:
    """One row: every aggregate of CHECKS, each table read once."""
    allowed = t.sources.select("source_id", F.from_json("content_filters", "allowed array<string>")["allowed"].alias("list"))
    a = t.articles.join(allowed, "source_id").join(eligible(t).select("cluster_id", F.lit(True).alias("visible")), F.col("cluster_no") == F.col("cluster_id"), "left")
    a = a.select("article_id", "source_id", "language", "content_type", "n_chars", "ingested_at", "story_id", "embedding", F.coalesce("visible", F.lit(False)).alias("visible"), F.coalesce(F.array_contains("list", F.col("content_type")), F.lit(False)).alias("allowed"), F.coalesce(~F.exists("embedding", lambda x: x != 0), F.lit(False)).alias("zero"))
    spark_sql = lambda e: F.expr(e.replace("TIMESTAMP '", "TIMESTAMP_NTZ '"))
    rows = [df.agg(*(spark_sql(e).alias(n) for n, e in CHECKS[k].items())) for k, df in (("s", scored(t)), ("a", a), ("u", t.usage))]
    one = rows[0].join(rows[1]).join(rows[2])  # three single rows
    since = lambda c: F.timestamp_diff("SECOND", F.col(c), now())
    return one.withColumns({"hours_silent": since("newest") / 3600.0, "minutes_idle": since("last_call") / 60.0})


@query("M30", CLUSTER_SQL + CHECK_SQL + " UNION ALL ".join(f"SELECT '{n}' AS canary, round(({v})::DOUBLE, 4) AS value, CASE WHEN {bad} THEN 'error' WHEN {warn} THEN 'warn' ELSE 'ok' END AS status FROM checked" for n, (v, bad, warn) in CANARIES.items()))
def health_overview(t: Tables) -> DataFrame:
    """Named canaries with value and status, one row each."""
    rows = F.array(*(F.struct(F.lit(n).alias("canary"), F.round(F.expr(v).cast("double"), 4).alias("value"), F.when(F.expr(bad), "error").when(F.expr(warn), "warn").otherwise("ok").alias("status")) for n, (v, bad, warn) in CANARIES.items()))
    return checked(t).select(F.explode(rows).alias("r")).select("r.*")


COUNTERS = ("total", "active", "frozen", "archived", "edited", "oversized", "undated", "visible", "articles", "day", "stuck", "waiting", "off_topic", "untranslated", "outlets", "reporting", "unpriced", "failures", "new_stories", "fresh_pool")


@query("A36 A39", CLUSTER_SQL + CHECK_SQL + " UNION ALL ".join(f"SELECT '{c}' AS counter, {c}::BIGINT AS n FROM checked" for c in COUNTERS))
def dashboard_counters(t: Tables) -> DataFrame:
    """The dashboard's counts, states of stories among them."""
    rows = F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).cast("long").alias("n")) for c in COUNTERS))
    return checked(t).select(F.explode(rows).alias("r")).select("r.*")


@query("F68", CLUSTER_SQL + CHECK_SQL + "SELECT visible_frozen::BIGINT AS frozen, visible::BIGINT AS visible, CASE WHEN visible_frozen >= 0.8 * visible AND waiting >= 15 AND live_hero = 0 THEN 'warn' ELSE 'ok' END AS status FROM checked")
def stale_homepage(t: Tables) -> DataFrame:
    """Whether the homepage is frozen while fresh articles wait and no pinned story lives."""
    status = F.when((F.col("visible_frozen") >= 0.8 * F.col("visible")) & (F.col("waiting") >= 15) & (F.col("live_hero") == 0), "warn").otherwise("ok")
    return checked(t).select(F.col("visible_frozen").alias("frozen"), "visible", status.alias("status"))


@query("M31 T17", """
, cur AS (SELECT user_id % 40 AS slug, bool_or(event_type = 'error') AS bad FROM events WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY 1), old AS (SELECT user_id % 45 AS slug, max_by(event_type = 'error', (ts, event_id)) AS open FROM events WHERE ts < TIMESTAMP '2024-01-30' GROUP BY 1)
SELECT slug, CASE WHEN coalesce(bad, false) AND NOT coalesce(open, false) THEN 'log' WHEN coalesce(open, false) AND NOT coalesce(bad, false) THEN 'close' ELSE 'keep' END AS action FROM cur FULL OUTER JOIN old USING (slug)""")
def canary_incident_sync(t: Tables) -> DataFrame:
    """New alerts to log and recovered ones to close: current state against the latest status row (full outer join)."""
    e, day = t["events"], F.expr("ts >= TIMESTAMP_NTZ '2024-01-30 00:00:00'")
    error = F.col("event_type") == "error"
    cur = e.where(day).groupBy((F.col("user_id") % 40).alias("slug")).agg(F.bool_or(error).alias("bad"))
    old = e.where(~day).groupBy((F.col("user_id") % 45).alias("slug")).agg(F.max_by(error, F.struct("ts", "event_id")).alias("open"))
    bad, was = F.coalesce("bad", F.lit(False)), F.coalesce("open", F.lit(False))
    return cur.join(old, "slug", "full").select("slug", F.when(bad & ~was, "log").when(was & ~bad, "close").otherwise("keep").alias("action"))


@query("A30", "SELECT doc_id, keeper FROM (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS keeper, count(*) OVER (PARTITION BY text) AS n FROM documents WHERE length(trim(text)) >= 10) WHERE n > 1")
def duplicate_keepers(t: Tables) -> DataFrame:
    """Equal texts with the earliest as keeper; grouped by a hash, so long texts aren't shuffled."""
    d = t["documents"].where(F.length(F.trim("text")) >= 10).select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    k = d.groupBy("h").agg(F.min("doc_id").alias("keeper"), F.count("*").alias("n")).where("n > 1")
    return d.join(k, "h").select("doc_id", "keeper")


@query("F42", """
, s AS (SELECT doc_id, sha1(lower(substr(text, 1, 80)) || '|' || substr(text, 1, 400)) AS sig FROM documents) SELECT sig, min(doc_id) AS representative, count(*) AS members FROM s GROUP BY sig HAVING count(*) >= 2""")
def content_signature_groups(t: Tables) -> DataFrame:
    from heronlake.functions import text

    s = t["documents"].select("doc_id", text.content_signature(F.substring("text", 1, 80), F.col("text")).alias("sig"))
    return s.groupBy("sig").agg(F.min("doc_id").alias("representative"), F.count("*").alias("members")).where("members >= 2")


@query("T8", """
, e AS (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events WHERE event_type = 'purchase')
, s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before > INTERVAL 2 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS part FROM e)
SELECT user_id, CAST(part AS BIGINT) AS part, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at FROM s GROUP BY ALL""")
def gap_split(t: Tables) -> DataFrame:
    """A user's purchases cut where two days pass without one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = t["events"].where("event_type = 'purchase'").select("user_id", "ts", "event_id", F.lag("ts").over(w).alias("before"))
    cut = F.when(F.col("before").isNull() | (F.timestamp_diff("MICROSECOND", F.col("before"), F.col("ts")) > 2 * 86_400_000_000), 1).otherwise(0)
    s = e.withColumn("cut", cut).withColumn("part", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy("user_id", "part").agg(F.count("*").alias("n"), F.min("ts").alias("first_at"), F.max("ts").alias("last_at"))


@query("F66", CLUSTER_SQL + f"""SELECT cluster_id, round(least(0.95::DOUBLE, CASE WHEN article_count < 10 THEN 0.45::DOUBLE WHEN {AGE.format('last_updated_at')} >= 5 THEN 0.65::DOUBLE WHEN {AGE.format('last_updated_at')} > 2 THEN 0.55::DOUBLE ELSE 0.40::DOUBLE END / greatest((cluster_id % 10) / 10.0::DOUBLE, 0.5::DOUBLE)), 6) AS threshold FROM clusters""")
def match_thresholds(t: Tables) -> DataFrame:
    return clusters(t).select("cluster_id", F.round(scores.match_threshold(F.col("article_count"), scores.days_between(now(), F.col("last_updated_at")), (F.col("cluster_id") % 10) / 10.0), 6).alias("threshold"))
