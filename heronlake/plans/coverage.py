"""How coverage of a story splits across groups, sides and outlets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.functions import groups, scores
from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables, hours_before

GROUP_SQL = """
, grouped AS (SELECT *, CASE WHEN production_location = 'inside' THEN CASE WHEN coalesce(factional_alignment IN ('hardline', 'principlist'), false) OR state_alignment = 'state' THEN 'principlist' ELSE 'reformist' END
    WHEN factional_alignment IN ('opposition', 'monarchist', 'radical') THEN 'radical_diaspora' ELSE 'moderate_diaspora' END AS narrative_group FROM v_sources)
, sided AS (SELECT *, CASE WHEN narrative_group IN ('principlist', 'reformist') THEN 'inside' ELSE 'outside' END AS side FROM grouped)
"""
#: Per story and group: articles (n_articles) or outlets (n_outlets), for all four groups.
SPLIT_SQL = GROUP_SQL + """
, groups4 AS (SELECT * FROM (VALUES ('principlist', 1), ('reformist', 2), ('moderate_diaspora', 3), ('radical_diaspora', 4)) t(narrative_group, ord))
, cells AS (SELECT s.story_id, g.narrative_group, g.ord, count(a.article_id) AS n_articles, count(DISTINCT a.source_id) AS n_outlets
    FROM v_stories s CROSS JOIN groups4 g LEFT JOIN (SELECT a.*, narrative_group FROM v_articles a JOIN sided USING (source_id)) a ON a.story_id = s.story_id AND a.narrative_group = g.narrative_group GROUP BY ALL)
"""


def remainder_sql(n: str) -> str:
    return f"""
, flo AS (SELECT *, sum({n}) OVER (PARTITION BY story_id) AS t, {n} * 100 // sum({n}) OVER (PARTITION BY story_id) AS f, {n} * 100 % sum({n}) OVER (PARTITION BY story_id) AS r FROM cells)
, rnk AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY r DESC, ord) AS k, 100 - sum(f) OVER (PARTITION BY story_id) AS l FROM flo)
, pct AS (SELECT story_id, narrative_group, ord, CAST({n} AS BIGINT) AS n, CAST(f + CASE WHEN k <= l THEN 1 ELSE 0 END AS BIGINT) AS pct FROM rnk)
"""


def grouped_sources(t: Tables) -> DataFrame:
    s = t.sources.withColumn("narrative_group", groups.narrative_group())
    return s.withColumn("side", groups.side(F.col("narrative_group")))


def cells(t: Tables, outlets: bool) -> DataFrame:
    """Per story and group the articles (or outlets); all four groups for every story."""
    joined = t.articles.where("story_id IS NOT NULL").select("story_id", "source_id").join(grouped_sources(t).select("source_id", "narrative_group"), "source_id")
    per = joined.groupBy("story_id", "narrative_group").agg((F.countDistinct("source_id") if outlets else F.count("*")).alias("n"))
    wide = per.groupBy("story_id").pivot("narrative_group", list(groups.GROUPS)).agg(F.first("n"))
    rows = F.array(*(F.struct(F.lit(g).alias("narrative_group"), F.lit(i + 1).alias("ord"), F.coalesce(F.col(g), F.lit(0)).cast("long").alias("n")) for i, g in enumerate(groups.GROUPS)))
    return wide.select("story_id", F.explode(rows).alias("r")).select("story_id", "r.*")


@query("A2 A21 W4 F58 M42", SPLIT_SQL + remainder_sql("n_articles") + "SELECT story_id, narrative_group, n, pct FROM pct")
def story_coverage_split(t: Tables) -> DataFrame:
    """Article shares of the four groups per story, summing to 100."""
    return groups.largest_remainder(cells(t, False), "story_id", "narrative_group", "n", F.col("ord")).select("story_id", "narrative_group", "n", "pct")


@query("A21 F57", SPLIT_SQL + remainder_sql("n_outlets") + """
, sides AS (SELECT story_id, sum(CASE WHEN ord <= 2 THEN pct ELSE 0 END) AS inside_pct, sum(CASE WHEN ord > 2 THEN pct ELSE 0 END) AS outside_pct FROM pct GROUP BY story_id)
SELECT story_id, CAST(inside_pct AS BIGINT) AS inside_pct, CAST(outside_pct AS BIGINT) AS outside_pct, CASE WHEN inside_pct >= 55 AND outside_pct <= 45 THEN 'state_only' WHEN outside_pct >= 55 AND inside_pct <= 45 THEN 'diaspora_only' END AS blindspot_type FROM sides""")
def blindspot_outlets(t: Tables) -> DataFrame:
    """Side shares by outlet votes and the one-sided stories (test thresholds 55 and 45)."""
    pct = groups.largest_remainder(cells(t, True), "story_id", "narrative_group", "n", F.col("ord"))
    sides = pct.groupBy("story_id").agg(F.sum(F.when(F.col("ord") <= 2, F.col("pct")).otherwise(0)).alias("inside_pct"), F.sum(F.when(F.col("ord") > 2, F.col("pct")).otherwise(0)).alias("outside_pct"))
    return sides.withColumn("blindspot_type", scores.blindspot_by_shares(F.col("inside_pct"), F.col("outside_pct"), 55, 45))


@query("F56 A3 J1", """
, c AS (SELECT article_id % 900 AS cluster_id, count(*) FILTER (state_alignment = 'state') AS s, count(*) FILTER (state_alignment = 'diaspora') AS d FROM v_articles JOIN v_sources USING (source_id) GROUP BY 1)
SELECT cluster_id, s AS state_count, d AS diaspora_count, CASE WHEN s + d = 0 THEN NULL WHEN d > 0 AND s = 0 THEN 'diaspora_only' WHEN s > 0 AND d = 0 THEN 'state_only'
  WHEN s + d < 6 AND s = 1 AND d >= 2 THEN 'diaspora_only' WHEN s + d < 6 AND d = 1 AND s >= 2 THEN 'state_only'
  WHEN s * 100 < 20 * (s + d) THEN 'diaspora_only' WHEN d * 100 < 20 * (s + d) THEN 'state_only' END AS blindspot_type FROM c""")
def blindspot_articles(t: Tables) -> DataFrame:
    """The article-count rule over small clusters."""
    a = t.articles.select((F.col("article_id") % 900).alias("cluster_id"), "source_id").join(t.sources.select("source_id", "state_alignment"), "source_id")
    c = a.groupBy("cluster_id").agg(F.count_if(F.col("state_alignment") == "state").alias("state_count"), F.count_if(F.col("state_alignment") == "diaspora").alias("diaspora_count"))
    return c.withColumn("blindspot_type", scores.blindspot_by_articles(F.col("state_count"), F.col("diaspora_count")))


@query("A2 A3 A1", GROUP_SQL + """
SELECT story_id, count(*) AS article_count, count(DISTINCT source_id) AS source_count, count(*) FILTER (side = 'inside') AS inside_count, count(*) FILTER (side = 'outside') AS outside_count,
  bool_or(state_alignment = 'state') AS covered_by_state, bool_or(state_alignment = 'diaspora') AS covered_by_diaspora, count(DISTINCT narrative_group) / 4.0::DOUBLE AS diversity, min(published_at) AS first_published_at
FROM v_articles JOIN sided USING (source_id) WHERE story_id IS NOT NULL GROUP BY story_id""")
def story_metadata(t: Tables) -> DataFrame:
    a = t.articles.where("story_id IS NOT NULL").select("story_id", "source_id", "published_at").join(grouped_sources(t), "source_id")
    return a.groupBy("story_id").agg(
        F.count("*").alias("article_count"), F.countDistinct("source_id").alias("source_count"), F.count_if(F.col("side") == "inside").alias("inside_count"), F.count_if(F.col("side") == "outside").alias("outside_count"),
        F.bool_or(F.col("state_alignment") == "state").alias("covered_by_state"), F.bool_or(F.col("state_alignment") == "diaspora").alias("covered_by_diaspora"),
        (F.countDistinct("narrative_group") / 4.0).alias("diversity"), F.min("published_at").alias("first_published_at"),
    )


HOURLY_SQL = GROUP_SQL + """
, h AS (SELECT story_id, count(*) FILTER (ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 200 HOUR) AS new_count,
   count(*) FILTER (side = 'inside' AND ingested_at < TIMESTAMP '2024-01-31' - INTERVAL 200 HOUR) AS inside_before, count(*) FILTER (side = 'outside' AND ingested_at < TIMESTAMP '2024-01-31' - INTERVAL 200 HOUR) AS outside_before,
   count(*) FILTER (side = 'inside') AS inside_after, count(*) FILTER (side = 'outside') AS outside_after
   FROM v_articles JOIN sided USING (source_id) WHERE story_id IS NOT NULL GROUP BY story_id)
"""


def hourly_counts(t: Tables, hours: int = 200) -> DataFrame:
    """Counts before and after a boundary *hours* ago, for stories touched since."""
    a = t.articles.where("story_id IS NOT NULL").select("story_id", "source_id", "ingested_at").join(grouped_sources(t).select("source_id", "side"), "source_id")
    new, inside = F.col("ingested_at") >= hours_before(F.lit(hours)), F.col("side") == "inside"
    return a.groupBy("story_id").agg(
        F.count_if(new).alias("new_count"), F.count_if(inside & ~new).alias("inside_before"), F.count_if(~inside & ~new).alias("outside_before"),
        F.count_if(inside).alias("inside_after"), F.count_if(~inside).alias("outside_after"),
    ).where("new_count > 0")


@query("A8 J7 T5", HOURLY_SQL + "SELECT * FROM h WHERE new_count > 0")
def hourly_update_counts(t: Tables) -> DataFrame:
    return hourly_counts(t)


@query("F60 T13", HOURLY_SQL + """
SELECT story_id, CASE WHEN (inside_before = 0 AND inside_after > 0 AND outside_before > 0) OR (outside_before = 0 AND outside_after > 0 AND inside_before > 0) THEN 'side_flip'
  WHEN inside_before + outside_before > 0 AND abs(round_even(inside_after * 100.0::DOUBLE / (inside_after + outside_after), 0) - round_even(inside_before * 100.0::DOUBLE / (inside_before + outside_before), 0)) >= 15 THEN 'coverage_shift'
  WHEN new_count >= 2 THEN 'burst' END AS kind FROM h WHERE new_count > 0""")
def hourly_update_signal(t: Tables) -> DataFrame:
    c = [F.col(x) for x in ("new_count", "inside_before", "outside_before", "inside_after", "outside_after")]
    return hourly_counts(t).select("story_id", scores.hourly_kind(*c).alias("kind"))


@query("F59 W14 F61 T14", GROUP_SQL + """
, c AS (SELECT story_id, count(*) AS n, count(*) FILTER (ingested_at < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR) AS old_n, count(*) FILTER (side = 'inside') AS i, count(*) FILTER (side = 'inside' AND ingested_at < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR) AS old_i
  FROM v_articles JOIN sided USING (source_id) WHERE story_id IS NOT NULL GROUP BY story_id)
, p AS (SELECT *, CAST(CASE WHEN n > 0 THEN i * 100 // n ELSE 0 END AS BIGINT) AS ip, CAST(CASE WHEN old_n > 0 THEN old_i * 100 // old_n ELSE 0 END AS BIGINT) AS oip FROM c)
SELECT story_id, ip AS inside_pct, oip AS old_inside_pct, CASE WHEN abs(ip - oip) >= 15 THEN 'coverage_shift' WHEN n - old_n >= 3 THEN 'new_articles' END AS kind FROM p""")
def snapshot_update_signal(t: Tables) -> DataFrame:
    """Today's counts against a snapshot of a day ago; the text counts as rewritten when articles came."""
    a = t.articles.where("story_id IS NOT NULL").select("story_id", "source_id", "ingested_at").join(grouped_sources(t).select("source_id", "side"), "source_id")
    old, inside = F.col("ingested_at") < hours_before(F.lit(24)), F.col("side") == "inside"
    c = a.groupBy("story_id").agg(F.count("*").alias("n"), F.count_if(old).alias("old_n"), F.count_if(inside).alias("i"), F.count_if(inside & old).alias("old_i"))
    share = lambda x, n: F.when(F.col(n) > 0, F.floor(F.col(x) * 100 / F.col(n))).otherwise(0).cast("long")
    c = c.select("story_id", "n", "old_n", share("i", "n").alias("ip"), share("old_i", "old_n").alias("oip"))
    none, hashed = F.lit(None).cast("double"), lambda x: F.sha1(F.col(x).cast("string").cast("binary"))
    kind = scores.update_kind(F.col("n"), none, F.col("ip"), 100 - F.col("ip"), hashed("n"), F.col("old_n"), none, F.col("oip"), 100 - F.col("oip"), hashed("old_n"))
    return c.select("story_id", F.col("ip").alias("inside_pct"), F.col("oip").alias("old_inside_pct"), kind.alias("kind"))


@query("M23", GROUP_SQL + """
, c AS (SELECT cluster_no AS cluster_id, count(*) FILTER (side = 'inside') AS i, count(*) FILTER (side = 'outside') AS o FROM v_articles JOIN sided USING (source_id) GROUP BY 1)
SELECT cluster_id, CASE WHEN i >= 2 AND o = 0 THEN 'outside' ELSE 'inside' END AS silent_side, greatest(i, o) AS loud FROM c WHERE (i >= 2 AND o = 0) OR (o >= 2 AND i = 0)""")
def silence_detection(t: Tables) -> DataFrame:
    """Clusters that one side covers twice or more and the other not at all (product value: three)."""
    a = t.articles.select(F.col("cluster_no").alias("cluster_id"), "source_id").join(grouped_sources(t).select("source_id", "side"), "source_id")
    c = a.groupBy("cluster_id").agg(F.count_if(F.col("side") == "inside").alias("i"), F.count_if(F.col("side") == "outside").alias("o"))
    silent = F.when((F.col("i") >= 2) & (F.col("o") == 0), "outside").when((F.col("o") >= 2) & (F.col("i") == 0), "inside")
    return c.select("cluster_id", silent.alias("silent_side"), F.greatest("i", "o").alias("loud")).where("silent_side IS NOT NULL")


@query("M25 J25", GROUP_SQL + """
, n AS (SELECT narrative_group, lower(string_split(title, ' ')[1]) AS topic, count(*) AS c FROM v_articles JOIN sided USING (source_id) WHERE trim(title) <> '' GROUP BY ALL)
, l AS (SELECT topic, count(*) FILTER (c >= 5) AS bundles, sum(c) FILTER (c >= 5) AS support FROM n GROUP BY topic HAVING count(*) FILTER (c >= 5) >= 2)
, x AS (SELECT g.narrative_group, topic, CAST(support AS BIGINT) AS support FROM (SELECT DISTINCT narrative_group FROM sided) g CROSS JOIN l WHERE (g.narrative_group, topic) NOT IN (SELECT narrative_group, topic FROM n))
SELECT narrative_group, topic, support FROM x QUALIFY row_number() OVER (PARTITION BY narrative_group ORDER BY support DESC, topic) <= 8""")
def absence_detection(t: Tables) -> DataFrame:
    """What two or more other groups cover five times (the first word of a title stands for its topic) and this one never does: eight per group, the best supported first."""
    from pyspark.sql import Window

    topic = F.lower(F.get(F.split("title", " "), F.lit(0)))
    g = grouped_sources(t).select("source_id", "narrative_group")
    n = t.articles.where(F.trim("title") != "").select("source_id", topic.alias("topic")).join(g, "source_id").groupBy("narrative_group", "topic").agg(F.count("*").alias("c"))
    loud = n.groupBy("topic").agg(F.collect_set("narrative_group").alias("by"), F.count_if(F.col("c") >= 5).alias("bundles"), F.sum(F.when(F.col("c") >= 5, F.col("c"))).alias("support")).where("bundles >= 2")
    # one row with the few groups there are
    groups = g.agg(F.collect_set("narrative_group").alias("all"))
    silent = loud.join(F.broadcast(groups)).select("topic", "support", F.explode(F.array_except("all", "by")).alias("narrative_group"))
    w = Window.partitionBy("narrative_group").orderBy(F.desc("support"), "topic")
    return silent.withColumn("k", F.row_number().over(w)).where("k <= 8").select("narrative_group", "topic", "support")


@query("F53 M34", GROUP_SQL + """
, w AS (SELECT source_id, side, string_split(lower(title), ' ')[1] AS a, string_split(lower(title), ' ')[2] AS b, article_id // 5 AS cluster_id FROM v_articles JOIN sided USING (source_id))
, s AS (SELECT cluster_id, list_distinct(list(a) FILTER (side = 'inside' AND trim(a) <> '')) AS si, list_distinct(list(a) FILTER (side = 'outside' AND trim(a) <> '')) AS so FROM w GROUP BY 1)
, k AS (SELECT cluster_id, coalesce(len(si), 0) AS ni, coalesce(len(so), 0) AS no, coalesce(len(list_intersect(si, so)), 0) AS both_ FROM s)
SELECT cluster_id, CASE WHEN ni = 0 OR no = 0 THEN 0.15::DOUBLE ELSE round_even(least(1.0::DOUBLE, 0.35::DOUBLE + 0.55::DOUBLE * (1 - both_::DOUBLE / (ni + no - both_)) * (least(ni, no, 3) / 3.0::DOUBLE) + 0.10::DOUBLE * (least(ni, no, 3) / 3.0::DOUBLE)), 2) END AS dispute_score FROM k""")
def dispute_score(t: Tables) -> DataFrame:
    """Dispute between the sides' first title words per cluster."""
    a = t.articles.select("source_id", F.get(F.split(F.lower("title"), " "), F.lit(0)).alias("a"), F.expr("article_id div 5").alias("cluster_id")).join(grouped_sources(t).select("source_id", "side"), "source_id")
    s = a.groupBy("cluster_id").agg(F.collect_set(F.when(F.col("side") == "inside", F.col("a"))).alias("i"), F.collect_set(F.when(F.col("side") == "outside", F.col("a"))).alias("o"))
    return s.select("cluster_id", scores.dispute(F.col("i"), F.col("o")).alias("dispute_score"))


@query("A17", """
, f AS (SELECT story_id, count(*) AS total_posts, CAST(sum(coalesce(views, 0)) AS BIGINT) AS total_views, count(DISTINCT channel_id) AS unique_channels, round(avg(sentiment), 6) AS avg_sentiment,
  count(*) FILTER (sentiment > 0.2) AS positive_count, count(*) FILTER (sentiment < -0.2) AS negative_count FROM v_posts GROUP BY story_id)
SELECT *, total_posts - positive_count - negative_count AS neutral_count FROM f""")
def sentiment_snapshot(t: Tables) -> DataFrame:
    """Posts per story: views, channels, and sentiment bands; no sentiment counts as neutral."""
    f = t.posts.groupBy("story_id").agg(
        F.count("*").alias("total_posts"), F.sum(F.coalesce("views", F.lit(0))).alias("total_views"), F.countDistinct("channel_id").alias("unique_channels"), F.round(F.avg("sentiment"), 6).alias("avg_sentiment"),
        F.count_if(F.col("sentiment") > 0.2).alias("positive_count"), F.count_if(F.col("sentiment") < -0.2).alias("negative_count"),
    )
    return f.withColumn("neutral_count", F.col("total_posts") - F.col("positive_count") - F.col("negative_count"))


@query("W5 W6 A51", GROUP_SQL + """
, c AS (SELECT story_id, count(*) AS n, count(*) FILTER (side = 'inside') AS i FROM v_articles JOIN sided USING (source_id) WHERE story_id IS NOT NULL GROUP BY 1)
SELECT story_id, CAST(round(i * 100.0::DOUBLE / n) AS BIGINT) AS inside_pct, CAST(greatest(0, 100 - round(i * 100.0::DOUBLE / n)) AS BIGINT) AS outside_pct FROM c""")
def side_percentages(t: Tables) -> DataFrame:
    """Two shares for display: the first rounded half up, the second its complement."""
    a = t.articles.where("story_id IS NOT NULL").select("story_id", "source_id").join(grouped_sources(t).select("source_id", "side"), "source_id")
    c = a.groupBy("story_id").agg(F.round(F.count_if(F.col("side") == "inside") * 100.0 / F.count("*")).cast("long").alias("inside_pct"))
    return c.withColumn("outside_pct", F.greatest(F.lit(0), 100 - F.col("inside_pct")).cast("long"))
