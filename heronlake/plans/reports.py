"""Listings, contradictions, neighbours and cards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions import text, vector
from heronlake.operators import similarity
from heronlake.plans.coverage import GROUP_SQL, grouped_sources
from heronlake.plans.feedback import REPORT_SQL, reports
from heronlake.plans.ranking import CLUSTER_SQL, scored
from heronlake.plans.registry import query
from heronlake.plans.similarity import CENTROID_SQL, COSINE, VECTOR_SQL, story_centroids, vectors
from heronlake.sources.adapters import Tables, hours_before


@query("P36", "SELECT event_id, model, cost FROM v_usage WHERE model = 'large' AND purpose = 'click' ORDER BY ts DESC, event_id DESC LIMIT 25")
def usage_calls(t: Tables) -> DataFrame:
    """The newest calls of a model and purpose."""
    return t.usage.where("model = 'large' AND purpose = 'click'").orderBy(F.desc("ts"), F.desc("event_id")).limit(25).select("event_id", "model", "cost")


@query("P11", r"SELECT page_id, NOT regexp_matches(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), '(^|\.)example\.net$') AND regexp_extract(url, '^[a-z]+://[^/?#]*/?([^?#]*)', 1) <> '' AS is_news FROM pages")
def news_links(t: Tables) -> DataFrame:
    """Links to articles: the host isn't (under) a skipped one and the path isn't empty."""
    host, path = F.lower(text.url_part(F.col("url"), "host")), F.regexp_replace(text.url_part(F.col("url"), "path"), "^/", "")
    return t["pages"].select("page_id", (~((host == "example.net") | host.endswith(".example.net")) & (path != "")).alias("is_news"))


@query("P17", GROUP_SQL + """
, c AS (SELECT story_id, count(*) AS n, count(*) FILTER (side = 'inside') AS i, bool_or(side = 'inside' AND contains(body, '!!')) AS quiet_in, bool_or(side = 'outside' AND contains(body, '!!')) AS quiet_out FROM v_articles JOIN sided USING (source_id) WHERE story_id IS NOT NULL GROUP BY story_id)
SELECT story_id, CASE WHEN quiet_in AND i * 100 >= 15 * n THEN 'state' WHEN quiet_out AND (n - i) * 100 >= 15 * n THEN 'diaspora' END AS contradiction FROM c""")
def narrative_contradictions(t: Tables) -> DataFrame:
    """A side said to be silent (the marker) that covers 15 % or more."""
    a = t.articles.where("story_id IS NOT NULL").select("story_id", "source_id", F.col("body").contains("!!").alias("marker")).join(grouped_sources(t).select("source_id", "side"), "source_id")
    inside = F.col("side") == "inside"
    c = a.groupBy("story_id").agg(F.count("*").alias("n"), F.count_if(inside).alias("i"), F.bool_or(inside & F.col("marker")).alias("qi"), F.bool_or(~inside & F.col("marker")).alias("qo"))
    share = lambda x: x * 100 >= 15 * F.col("n")
    return c.select("story_id", F.when(F.col("qi") & share(F.col("i")), "state").when(F.col("qo") & share(F.col("n") - F.col("i")), "diaspora").alias("contradiction"))


@query("P35", """
, c AS (SELECT story_id, count(*) AS n, count(*) FILTER (ingested_at < TIMESTAMP '2024-01-31' - INTERVAL 100 HOUR) AS old_n, sum(('0x' || substr(md5(CAST(article_id AS VARCHAR)), 1, 12))::BIGINT) AS h, coalesce(sum(('0x' || substr(md5(CAST(article_id AS VARCHAR)), 1, 12))::BIGINT) FILTER (ingested_at < TIMESTAMP '2024-01-31' - INTERVAL 100 HOUR), 0) AS old_h FROM v_articles WHERE story_id IS NOT NULL GROUP BY story_id)
SELECT story_id, h <> old_h AND (n - old_n >= 5 OR n < old_n OR old_n = 0) AS evaluate FROM c""")
def reevaluation_trigger(t: Tables) -> DataFrame:
    """Stories whose set of members changed since the last evaluation, by five or more."""
    old, i = F.col("ingested_at") < hours_before(F.lit(100)), F.col("article_id")
    c = t.articles.where("story_id IS NOT NULL").groupBy("story_id").agg(F.count("*").alias("n"), F.count_if(old).alias("o"), text.set_sum(i).alias("h"), F.coalesce(text.set_sum(F.when(old, i)), F.lit(0)).alias("oh"))
    return c.select("story_id", ((F.col("h") != F.col("oh")) & ((F.col("n") - F.col("o") >= 5) | (F.col("n") < F.col("o")) | (F.col("o") == 0))).alias("evaluate"))


@query("J5 J13", """
, busy AS (SELECT story_id, count(*) AS posts FROM v_posts GROUP BY story_id HAVING count(*) >= 50)
SELECT s.story_id, s.article_count, posts, source_id FROM v_stories s JOIN busy USING (story_id) LEFT JOIN (SELECT story_id, min(source_id) AS source_id FROM v_articles WHERE source_id > 'src5' GROUP BY 1) e USING (story_id)""")
def busy_stories(t: Tables) -> DataFrame:
    """Stories with many posts, with an outlet if there is evidence."""
    busy = t.posts.groupBy("story_id").agg(F.count("*").alias("posts")).where("posts >= 50")
    e = t.articles.where("source_id > 'src5' AND story_id IS NOT NULL").groupBy("story_id").agg(F.min("source_id").alias("source_id"))
    return t.stories.select("story_id", "article_count").join(busy, "story_id").join(e, "story_id", "left").select("story_id", "article_count", "posts", "source_id")


@query("A29 A41", REPORT_SQL + "SELECT target % 4 AS tier, count(*) AS reports, count(DISTINCT target) AS targets, count(DISTINCT substr(sha256(fingerprint), 1, 8)) AS people FROM reports GROUP BY 1")
def review_tiers(t: Tables) -> DataFrame:
    r = reports(t).groupBy((F.col("target") % 4).alias("tier"))
    return r.agg(F.count("*").alias("reports"), F.countDistinct("target").alias("targets"), F.countDistinct(F.substring(F.sha2(F.col("fingerprint").cast("binary"), 256), 1, 8)).alias("people"))


@query("W13", CLUSTER_SQL + "SELECT cluster_id, cluster_id % 8 AS arc, coalesce(CASE WHEN cluster_id % 3 = 0 THEN cluster_id % 5 END, row_number() OVER (PARTITION BY cluster_id % 8 ORDER BY first_published_at, cluster_id) - 1) AS chapter FROM clusters")
def arc_chapters(t: Tables) -> DataFrame:
    """Chapters by their set place, else by time (undated ones last)."""
    arc = F.col("cluster_id") % 8
    place = F.row_number().over(Window.partitionBy("arc").orderBy(F.asc_nulls_last("first_published_at"), "cluster_id")) - 1
    return scored(t).withColumn("arc", arc).select("cluster_id", "arc", F.coalesce(F.when(F.col("cluster_id") % 3 == 0, F.col("cluster_id") % 5), place.cast("long")).alias("chapter"))


@query("U2", CLUSTER_SQL + """
, a AS (SELECT cluster_id FROM scored ORDER BY trending DESC, cluster_id LIMIT 15), b AS (SELECT cluster_id FROM scored ORDER BY priority DESC, cluster_id LIMIT 15), c AS (SELECT cluster_id FROM scored ORDER BY last_updated_at DESC, cluster_id LIMIT 15)
SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c""")
def keep_sets(t: Tables) -> DataFrame:
    s = scored(t)
    top = lambda c: s.orderBy(F.desc(c), "cluster_id").limit(15).select("cluster_id")
    return top("trending").union(top("priority")).union(top("last_updated_at")).distinct()


#: Phrases that outlets repeat, everywhere and by outlet.
BOILERPLATE, BY_SOURCE = (r"!!+", r"\*\*\*"), {"src1": r"%%%", "src2": r"&&&"}


@query("F6", r"SELECT source_id, sum(length(regexp_replace(CASE source_id WHEN 'src1' THEN regexp_replace(b, '%%%', '', 'g') WHEN 'src2' THEN regexp_replace(b, '&&&', '', 'g') ELSE b END, '[ ]+', ' ', 'g')))::BIGINT AS kept FROM (SELECT source_id, regexp_replace(regexp_replace(body, '!!+', '', 'g'), '\*\*\*', '', 'g') AS b FROM v_articles) GROUP BY source_id")
def boilerplate_stripped(t: Tables) -> DataFrame:
    """Text left per outlet without phrases that are boilerplate everywhere or there."""
    b = F.col("body")
    for p in BOILERPLATE:
        b = F.regexp_replace(b, p, "")
    for s, p in BY_SOURCE.items():
        b = F.when(F.col("source_id") == s, F.regexp_replace(b, p, "")).otherwise(b)
    return t.articles.select("source_id", F.length(F.regexp_replace(b, "[ ]+", " ")).alias("n")).groupBy("source_id").agg(F.sum("n").alias("kept"))


@query("M22", CENTROID_SQL + f"""
, n AS (SELECT a.story_id, b.story_id AS near FROM cent a JOIN cent b ON a.story_id <> b.story_id WHERE {COSINE.format('a.centroid', 'b.centroid')} >= 0)
, p AS (SELECT n.story_id, channel_id, message_id, row_number() OVER (PARTITION BY n.story_id ORDER BY date DESC, channel_id, message_id) AS k FROM n JOIN v_posts ON v_posts.story_id = near)
SELECT story_id, channel_id, message_id FROM p WHERE k <= 30""")
def borrowed_posts(t: Tables) -> DataFrame:
    """Thirty newest posts of the stories near each story."""
    c = story_centroids(t)
    near = similarity.scored_blocks(c.select("story_id", "centroid"), "centroid", c.select(F.col("story_id").alias("near"), F.col("centroid").alias("v")), "near", "v")
    pairs = near[0]
    for p in near[1:]:
        pairs = pairs.unionByName(p)
    pairs = pairs.where("story_id <> near AND score >= 0").select("story_id", "near")
    j = pairs.join(t.posts.select(F.col("story_id").alias("near"), "channel_id", "message_id", "date"), "near")
    k = F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("date"), "channel_id", "message_id"))
    return j.withColumn("k", k).where("k <= 30").select("story_id", "channel_id", "message_id")


@query("M18", VECTOR_SQL + f"""
, seen AS (SELECT article_id, embedding, ingested_at FROM vec WHERE NOT arrived AND ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 216 HOUR ORDER BY ingested_at DESC, article_id DESC LIMIT 200)
SELECT vec.article_id, bool_or({COSINE.format('vec.embedding', 'seen.embedding')} > 0.2) AS duplicate FROM vec CROSS JOIN seen WHERE arrived GROUP BY vec.article_id""")
def arrival_duplicates(t: Tables) -> DataFrame:
    """Arrivals against the two hundred newest stored rows of the 48 hours before them (test cosine .2)."""
    v = vectors(t)
    seen = v.where(~F.col("arrived") & (F.col("ingested_at") >= hours_before(F.lit(216)))).orderBy(F.desc("ingested_at"), F.desc("article_id")).limit(200).select(F.col("embedding").alias("e"))
    new = v.where("arrived").select("article_id", "embedding").join(F.broadcast(seen))
    return new.groupBy("article_id").agg(F.bool_or(vector.cosine(F.col("embedding"), F.col("e")) > 0.2).alias("duplicate"))


@query("F67", CLUSTER_SQL + """SELECT cluster_id, coalesce(CASE WHEN cluster_id % 7 = 0 THEN 'override' END, CASE WHEN cluster_id % 5 = 0 THEN 'stored' END, CASE WHEN article_count > 8 THEN 'picked' END, 'logo') AS image_from,
 round(greatest(0, article_count * 1000 - 3000) * 4096.0::DOUBLE / 1073741824, 9) AS egress_gb FROM clusters""")
def story_cards(t: Tables) -> DataFrame:
    """Where a card's image comes from, in fixed order, and the bytes that it costs."""
    c = F.col("cluster_id")
    source = F.coalesce(F.when(c % 7 == 0, "override"), F.when(c % 5 == 0, "stored"), F.when(F.col("article_count") > 8, "picked"), F.lit("logo"))
    return scored(t).select("cluster_id", source.alias("image_from"), F.round(F.greatest(F.lit(0), F.col("article_count") * 1000 - 3000) * 4096.0 / 1073741824, 9).alias("egress_gb"))
