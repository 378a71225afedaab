"""Ordered lists, top-k per group, set operations and order-dependent re-ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions import scores
from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables, hours_before, now

#: Clusters stand for stories where ten are too few.
CLUSTER_SQL = """
, clusters AS (SELECT cluster_no AS cluster_id, count(*) AS article_count, count(DISTINCT source_id) AS source_count, min(published_at) AS first_published_at, max(ingested_at) AS last_updated_at,
   CASE WHEN cluster_no % 12 = 0 THEN 50 WHEN cluster_no % 17 = 3 THEN -150 ELSE 0 END AS priority, CASE WHEN cluster_no % 13 = 5 THEN TIMESTAMP '2024-01-20' END AS archived_at, cluster_no % 19 = 4 AS is_edited, CASE WHEN cluster_no % 9 = 0 THEN TIMESTAMP '2024-01-31' - to_hours(CAST(cluster_no * 5 AS INTEGER)) END AS frozen_at,
   count(*) FILTER (CAST(substr(source_id, 4) AS INT) % 4 = 0) AS state_count, count(*) FILTER (CAST(substr(source_id, 4) AS INT) % 4 = 1) AS diaspora_count, min(title) AS title FROM v_articles GROUP BY cluster_no)
, scored AS (SELECT *, CASE WHEN source_count <= 1 AND article_count >= 5 THEN 0.0::DOUBLE ELSE article_count * greatest(0.005::DOUBLE, pow(0.85::DOUBLE, greatest(0.0::DOUBLE, date_diff('second', coalesce(frozen_at, last_updated_at, first_published_at), TIMESTAMP '2024-01-31') / 86400.0::DOUBLE))) END AS trending, state_count + diaspora_count > 0 AND (least(state_count, diaspora_count) * 100 < 20 * (state_count + diaspora_count) OR (state_count + diaspora_count < 6 AND least(state_count, diaspora_count) = 1 AND greatest(state_count, diaspora_count) >= 2)) AS blindspot FROM clusters)
, eligible AS (SELECT * FROM scored WHERE archived_at IS NULL AND priority > -100)
"""


def clusters(t: Tables) -> DataFrame:
    a = t.articles
    n, c = F.substring("source_id", 4, 10).cast("int") % 4, F.col("cluster_no")
    return a.groupBy(c.alias("cluster_id")).agg(
        F.count("*").alias("article_count"), F.countDistinct("source_id").alias("source_count"), F.min("published_at").alias("first_published_at"), F.max("ingested_at").alias("last_updated_at"),
        F.count_if(n == 0).alias("state_count"), F.count_if(n == 1).alias("diaspora_count"), F.min("title").alias("title"),
    ).withColumns({"priority": F.when(F.col("cluster_id") % 12 == 0, 50).when(F.col("cluster_id") % 17 == 3, -150).otherwise(0), "archived_at": F.when(F.col("cluster_id") % 13 == 5, F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")), "is_edited": F.col("cluster_id") % 19 == 4, "frozen_at": F.when(F.col("cluster_id") % 9 == 0, hours_before((F.col("cluster_id") * 5).cast("int")))})


def scored(t: Tables) -> DataFrame:
    one_sided = scores.blindspot_by_articles(F.col("state_count"), F.col("diaspora_count")).isNotNull()
    return clusters(t).withColumn("blindspot", one_sided).withColumn("trending", scores.trending(F.col("article_count"), F.col("source_count"), F.col("frozen_at"), F.col("last_updated_at"), F.col("first_published_at"), now()))


def eligible(t: Tables) -> DataFrame:
    """Stories that may stand on the homepage: not archived, not buried."""
    return scored(t).where("archived_at IS NULL AND priority > -100")


TREND_ORDER = "priority DESC, coalesce(frozen_at, first_published_at) DESC NULLS LAST, trending DESC, cluster_id"


def trend_order() -> list:
    return [F.desc("priority"), F.coalesce("frozen_at", "first_published_at").desc_nulls_last(), F.desc("trending"), F.col("cluster_id")]


TRENDING_SQL = f"SELECT cluster_id, priority, article_count, round(trending, 6) AS trending FROM eligible WHERE article_count >= 3 AND trending > 0.5 AND NOT blindspot ORDER BY {TREND_ORDER} LIMIT 60"


@query("L1 F55 P7", CLUSTER_SQL + TRENDING_SQL)
def trending_topk(t: Tables) -> DataFrame:
    """Three times the twenty stories that the page shows (a re-ranking follows)."""
    top = eligible(t).where("article_count >= 3 AND trending > 0.5 AND NOT blindspot").orderBy(*trend_order()).limit(min(3 * 20, 100))
    return top.select("cluster_id", "priority", "article_count", F.round("trending", 6).alias("trending"))


BLINDSPOT_SQL = """
, week AS (SELECT * FROM eligible WHERE blindspot AND article_count >= 3 AND last_updated_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)
, blind AS (SELECT cluster_id, trending FROM week UNION ALL SELECT cluster_id, trending FROM eligible WHERE blindspot AND article_count >= 3 AND last_updated_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY AND NOT EXISTS (SELECT 1 FROM week))
, blind_top AS (SELECT cluster_id FROM blind ORDER BY trending DESC, cluster_id LIMIT 20)
"""


def blindspots(t: Tables) -> DataFrame:
    s = eligible(t).where("blindspot AND article_count >= 3")
    days = lambda n: s.where(F.col("last_updated_at") >= hours_before(F.lit(24 * n)))
    # the wider window counts only where the week has none: one row that says so
    none = days(7).agg((F.count("*") == 0).alias("none"))
    wider = days(14).join(F.broadcast(none)).where("none").drop("none")
    return days(7).unionByName(wider).orderBy(F.desc("trending"), "cluster_id").limit(20).select("cluster_id")


@query("L3", CLUSTER_SQL + BLINDSPOT_SQL + "SELECT cluster_id FROM blind_top")
def blindspot_list(t: Tables) -> DataFrame:
    """One-sided stories of seven days, or of fourteen if there is none."""
    return blindspots(t)


@query("L2 U1", CLUSTER_SQL + BLINDSPOT_SQL + f"SELECT cluster_id FROM ({TRENDING_SQL}) UNION SELECT cluster_id FROM blind_top")
def homepage_ids(t: Tables) -> DataFrame:
    """Trending and one-sided stories together."""
    return trending_topk(t).select("cluster_id").union(blindspots(t)).distinct()


@query("W9", CLUSTER_SQL + f"""
, top AS (SELECT cluster_id, priority, trending, list_distinct(string_split(lower(title), ' ')) AS words, row_number() OVER (ORDER BY {TREND_ORDER}) AS k FROM scored WHERE article_count >= 3 ORDER BY k LIMIT 40)
, o AS (SELECT a.cluster_id, a.priority, a.trending, a.k, len(list_filter(a.words, lambda w: list_contains(flatten(list(b.words)), w))) / len(a.words)::DOUBLE AS ov FROM top a LEFT JOIN top b ON b.k < a.k GROUP BY a.cluster_id, a.priority, a.trending, a.k, a.words)
SELECT cluster_id, k, round(priority * 1000 + trending * greatest(0.3::DOUBLE, 1 - 0.7::DOUBLE * coalesce(ov, 0)), 5) AS score FROM o""")
def trending_diversity(t: Tables) -> DataFrame:
    """The top 40, each marked down by the share of its title words that earlier rows used."""
    words = F.array_distinct(F.split(F.lower("title"), " "))
    top = scored(t).where("article_count >= 3").orderBy(*trend_order()).limit(40).select("*", words.alias("words"))
    top = top.withColumn("k", F.row_number().over(Window.orderBy(*trend_order())))
    # a window over forty rows: the words of all rows before this one
    before = F.flatten(F.collect_list("words").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)))
    share = F.size(F.array_intersect("words", before)) / F.size("words")
    return top.select("cluster_id", "k", F.round(F.col("priority") * 1000 + F.col("trending") * F.greatest(F.lit(0.3), 1 - 0.7 * share), 5).alias("score"))


@query("J19 W2", "SELECT story_id, article_id, k FROM (SELECT story_id, article_id, row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC NULLS LAST, article_id) AS k FROM v_articles WHERE story_id IS NOT NULL) WHERE k <= 3")
def topk_titles_per_story(t: Tables) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("story_id").orderBy(F.col("published_at").desc_nulls_last(), "article_id"))
    return t.articles.where("story_id IS NOT NULL").select("story_id", "article_id", k.alias("k")).where("k <= 3")


@query("W1 J18 A19 T17", "SELECT user_id, max_by(event_type, (ts, event_id)) AS latest_type, max(ts) AS latest_at FROM events GROUP BY user_id")
def latest_per_key(t: Tables) -> DataFrame:
    """Latest event per user, as an aggregate (no sort of a user's whole history)."""
    return t["events"].groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("latest_type"), F.max("ts").alias("latest_at"))


@query("W8 X3", """
, r AS (SELECT language, article_id, row_number() OVER (PARTITION BY language, source_id ORDER BY md5(CAST(article_id AS VARCHAR))) AS pass FROM v_articles)
SELECT language, article_id FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY pass, md5(CAST(article_id AS VARCHAR))) AS k FROM r) WHERE k <= 10""")
def stratified_sample(t: Tables) -> DataFrame:
    """Ten articles per language: one per outlet and pass, in a hashed order."""
    h = F.md5(F.col("article_id").cast("string").cast("binary"))
    r = t.articles.select("language", "article_id", F.row_number().over(Window.partitionBy("language", "source_id").orderBy(h)).alias("pass"))
    return r.where("pass <= 10").withColumn("k", F.row_number().over(Window.partitionBy("language").orderBy("pass", h))).where("k <= 10").select("language", "article_id")


@query("W15 L17", """
, one AS (SELECT * FROM (SELECT a.*, state_alignment, row_number() OVER (PARTITION BY story_id, source_id ORDER BY n_chars DESC, article_id) AS k FROM v_articles a JOIN v_sources USING (source_id) WHERE story_id IS NOT NULL) WHERE k = 1)
SELECT story_id, article_id FROM (SELECT story_id, article_id, row_number() OVER (PARTITION BY story_id, state_alignment ORDER BY n_chars DESC, article_id) AS k FROM one) WHERE k <= 2""")
def alignment_sample(t: Tables) -> DataFrame:
    """Longest article per outlet, then two per alignment and story."""
    a = t.articles.where("story_id IS NOT NULL").select("story_id", "source_id", "article_id", "n_chars")
    one = a.groupBy("story_id", "source_id").agg(F.max_by(F.struct("article_id", "n_chars"), F.struct("n_chars", -F.col("article_id"))).alias("x")).select("story_id", "source_id", "x.*")
    one = one.join(t.sources.select("source_id", "state_alignment"), "source_id")
    k = F.row_number().over(Window.partitionBy("story_id", "state_alignment").orderBy(F.desc("n_chars"), "article_id"))
    return one.withColumn("k", k).where("k <= 2").select("story_id", "article_id")


@query("W11", """SELECT article_id, row_number() OVER (ORDER BY CASE WHEN old THEN 0 ELSE 1 END, CASE WHEN old THEN article_id % 720 ELSE 0 END DESC, CASE WHEN old THEN 0 ELSE article_id % 720 END, article_id) AS k FROM (SELECT article_id, article_id % 720 > 24 AS old FROM v_articles) QUALIFY k <= 100""")
def two_direction_order(t: Tables) -> DataFrame:
    """The queue's next hundred: older than a day oldest first, then newest first."""
    age = F.col("article_id") % 720
    old = age > 24
    order = [F.when(old, 0).otherwise(1), F.when(old, age).otherwise(0).desc(), F.when(old, 0).otherwise(age), F.col("article_id")]
    top = t.articles.select("article_id").orderBy(*order).limit(100)
    return top.withColumn("k", F.row_number().over(Window.orderBy(*order)))


@query("L18 P22", "SELECT article_id, title FROM v_articles WHERE language = 'fr' AND story_id = 2 ORDER BY published_at DESC NULLS LAST, ingested_at DESC, article_id LIMIT 10 OFFSET 5")
def article_page(t: Tables) -> DataFrame:
    return t.articles.where("language = 'fr' AND story_id = 2").orderBy(F.col("published_at").desc_nulls_last(), F.desc("ingested_at"), "article_id").offset(5).limit(10).select("article_id", "title")


@query("L19", CLUSTER_SQL + """
, u AS (SELECT cluster_id, 0 AS tier, row_number() OVER (ORDER BY priority DESC, trending DESC, cluster_id) AS k FROM scored QUALIFY k <= 12
  UNION ALL SELECT cluster_id, 1, row_number() OVER (ORDER BY last_updated_at DESC, cluster_id) AS k FROM scored WHERE last_updated_at >= TIMESTAMP '2024-01-31' - INTERVAL 4 DAY QUALIFY k <= 40)
SELECT cluster_id, min(tier * 1000 + k) AS rank FROM u GROUP BY cluster_id""")
def prominent_and_fresh(t: Tables) -> DataFrame:
    """Top twelve by priority, then the fresh ones; each once, at its better place."""
    s = scored(t)
    a = s.orderBy(F.desc("priority"), F.desc("trending"), "cluster_id").limit(12).withColumn("k", F.row_number().over(Window.orderBy(F.desc("priority"), F.desc("trending"), "cluster_id")))
    b = s.where(F.col("last_updated_at") >= hours_before(F.lit(96))).orderBy(F.desc("last_updated_at"), "cluster_id").limit(40).withColumn("k", 1000 + F.row_number().over(Window.orderBy(F.desc("last_updated_at"), "cluster_id")))
    return a.select("cluster_id", "k").union(b.select("cluster_id", "k")).groupBy("cluster_id").agg(F.min("k").alias("rank"))


@query("L13", CLUSTER_SQL + """SELECT cluster_id, round(2 * state_count + trending + 10 * greatest(0.0::DOUBLE, 1 - date_diff('second', last_updated_at, TIMESTAMP '2024-01-31') / 3600.0::DOUBLE / 72) + 0.5::DOUBLE * article_count, 5) AS popularity FROM scored ORDER BY popularity DESC, cluster_id LIMIT 3""")
def popularity_top(t: Tables) -> DataFrame:
    age = F.timestamp_diff("SECOND", F.col("last_updated_at"), now()) / 3600.0
    p = F.round(2 * F.col("state_count") + F.col("trending") + 10 * F.greatest(F.lit(0.0), 1 - age / 72) + 0.5 * F.col("article_count"), 5)
    return scored(t).select("cluster_id", p.alias("popularity")).orderBy(F.desc("popularity"), "cluster_id").limit(3)


@query("U4 U5", CLUSTER_SQL + """
, keep AS (SELECT cluster_id FROM scored ORDER BY trending DESC, cluster_id LIMIT 50)
(SELECT cluster_id, 'delete' AS what FROM scored WHERE trending <= 0.5 EXCEPT SELECT cluster_id, 'delete' FROM keep)
UNION ALL (SELECT cluster_id, 'spared' AS what FROM scored WHERE trending <= 2 INTERSECT SELECT cluster_id, 'spared' FROM keep)""")
def retention_keep_set(t: Tables) -> DataFrame:
    """Low clusters to delete except those kept, and the low ones that the keep set spares."""
    s = scored(t)
    keep = s.orderBy(F.desc("trending"), "cluster_id").limit(50).select("cluster_id")
    gone = s.where("trending <= 0.5").select("cluster_id").subtract(keep).withColumn("what", F.lit("delete"))
    return gone.unionAll(s.where("trending <= 2").select("cluster_id").intersect(keep).withColumn("what", F.lit("spared")))


@query("U3", "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def verification_counts(t: Tables) -> DataFrame:
    parts = [t[n].agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("documents", "events", "pages", "lineitem")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("L7 L10", "SELECT event_type, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def event_timeline(t: Tables) -> DataFrame:
    """The five latest events of each type."""
    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")))
    return t["events"].select("event_type", "event_id", "ts", k.alias("k")).where("k <= 5").drop("k")


@query("L4 J9", "SELECT d.doc_id FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY md5(CAST(doc_id AS VARCHAR)) LIMIT 1")
def next_to_rate(t: Tables) -> DataFrame:
    """One document without a rating, in a fixed random order."""
    return t["documents"].select("doc_id").join(t["labels"].select("doc_id"), "doc_id", "left_anti").orderBy(F.md5(F.col("doc_id").cast("string").cast("binary"))).limit(1)
