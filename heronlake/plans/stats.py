"""Grouped statistics: outlets, content types, costs, ratings, data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions import scores
from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables, hours_before, now

DAY = "TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR"
WEEK = "TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR"


@query("A4 J2 T6", f"""SELECT s.source_id, count(a.article_id) AS total, count(*) FILTER (a.ingested_at >= {DAY}) AS last_24h, count(*) FILTER (a.ingested_at >= {WEEK}) AS last_7d, max(a.ingested_at) AS latest
FROM v_sources s LEFT JOIN (SELECT * FROM v_articles WHERE source_id <> 'src3') a USING (source_id) GROUP BY s.source_id""")
def source_stats(t: Tables) -> DataFrame:
    """Articles per outlet in three windows; an outlet without articles stays."""
    a = t.articles.where("source_id <> 'src3'").select("source_id", "article_id", "ingested_at")
    return t.sources.select("source_id").join(a, "source_id", "left").groupBy("source_id").agg(
        F.count("article_id").alias("total"), F.count_if(F.col("ingested_at") >= hours_before(F.lit(24))).alias("last_24h"),
        F.count_if(F.col("ingested_at") >= hours_before(F.lit(168))).alias("last_7d"), F.max("ingested_at").alias("latest"))


@query("A5 J3 A24 L9", f"SELECT channel_id, count(*) AS total, count(*) FILTER (date >= {WEEK}) AS last_7d, max(date) AS latest, max(message_id) AS high_water FROM v_posts GROUP BY channel_id")
def channel_stats(t: Tables) -> DataFrame:
    return t.posts.groupBy("channel_id").agg(F.count("*").alias("total"), F.count_if(F.col("date") >= hours_before(F.lit(168))).alias("last_7d"), F.max("date").alias("latest"), F.max("message_id").alias("high_water"))


@query("A6", "SELECT source_id, coalesce(content_type, 'none') AS content_type, count(*) AS n FROM v_articles GROUP BY GROUPING SETS ((coalesce(content_type, 'none')), (source_id, coalesce(content_type, 'none')))")
def content_type_rollup(t: Tables) -> DataFrame:
    """Label counts over all and per outlet in one pass (grouping sets)."""
    a = t.articles.select("source_id", F.coalesce("content_type", F.lit("none")).alias("content_type"))
    return a.groupingSets([[F.col("content_type")], [F.col("source_id"), F.col("content_type")]], "source_id", "content_type").agg(F.count("*").alias("n"))


@query("P2 J6", "SELECT a.source_id, count(*) AS n FROM v_articles a JOIN v_sources s USING (source_id) WHERE list_contains(allowed, content_type) GROUP BY a.source_id")
def content_type_gate(t: Tables) -> DataFrame:
    """Articles whose label is in their outlet's JSON whitelist; no label is outside."""
    allowed = t.sources.select("source_id", F.from_json("content_filters", "allowed array<string>")["allowed"].alias("allowed"))
    a = t.articles.where("content_type IS NOT NULL").select("source_id", "content_type").join(allowed, "source_id")
    return a.where(F.array_contains("allowed", F.col("content_type"))).groupBy("source_id").agg(F.count("*").alias("n"))


@query("A9", "SELECT model, purpose, date_trunc('day', ts) AS day, count(*) AS calls, round(sum(cost), 4) AS cost FROM v_usage GROUP BY GROUPING SETS ((), (model), (purpose), (date_trunc('day', ts), purpose))")
def cost_summary(t: Tables) -> DataFrame:
    """Calls and cost in total, by model, by purpose, and by day and purpose."""
    u = t.usage.select("model", "purpose", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"), "cost")
    sets = [[], [F.col("model")], [F.col("purpose")], [F.col("day"), F.col("purpose")]]
    return u.groupingSets(sets, "model", "purpose", "day").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost")).select("model", "purpose", "day", "calls", "cost")


@query("A10 J4", "SELECT u.story_id, count(*) AS calls, round(sum(cost), 4) AS cost, s.article_count FROM v_usage u LEFT JOIN v_stories s USING (story_id) GROUP BY u.story_id, s.article_count ORDER BY cost DESC, story_id LIMIT 5")
def cost_top_stories(t: Tables) -> DataFrame:
    per = t.usage.groupBy("story_id").agg(F.count("*").alias("calls"), F.round(F.sum("cost"), 4).alias("cost"))
    return per.join(t.stories.select("story_id", "article_count"), "story_id", "left").orderBy(F.desc("cost"), "story_id").limit(5)


@query("A11 T18", "SELECT round(coalesce(sum(cost) FILTER (ts >= TIMESTAMP '2024-01-01'), 0), 4) AS mtd, coalesce(sum(cost) FILTER (ts >= TIMESTAMP '2024-01-01'), 0) >= 0.85 * 1e6 AS halted FROM v_usage")
def cost_month_to_date(t: Tables) -> DataFrame:
    """Cost since the month began, and whether it passes 85 % of the budget."""
    cost = F.coalesce(F.sum(F.when(F.col("ts") >= F.date_trunc("month", now()).cast("timestamp_ntz"), F.col("cost"))), F.lit(0.0))
    return t.usage.agg(F.round(cost, 4).alias("mtd"), (cost >= 0.85 * 1e6).alias("halted"))


@query("A12 W3", """
, e AS (SELECT purpose || ':' || json_extract_string(props, '$.k')::INT % 10 AS step, cost FROM v_usage)
, g AS (SELECT step, count(*) AS n, round(avg(cost), 4) AS mean, round(max(cost), 4) AS most, round(sum(cost), 2) AS total FROM e GROUP BY step)
SELECT step, n, mean, most, total, round(100 * sum(total) OVER (ORDER BY total DESC, step ROWS UNBOUNDED PRECEDING) / sum(total) OVER (), 1) AS cumulative_pct FROM g""")
def egress_pareto(t: Tables) -> DataFrame:
    """Steps by total with their running share; the window orders one row per step."""
    k = F.from_json("props", "k int")["k"] % 10
    g = t.usage.groupBy(F.concat("purpose", F.lit(":"), k).alias("step")).agg(F.count("*").alias("n"), F.round(F.avg("cost"), 4).alias("mean"), F.round(F.max("cost"), 4).alias("most"), F.round(F.sum("cost"), 2).alias("total"))
    run = Window.orderBy(F.desc("total"), "step").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumn("cumulative_pct", F.round(100 * F.sum("total").over(run) / F.sum("total").over(Window.partitionBy()), 1))


@query("A13 J18 W1", """
, d AS (SELECT purpose, date_trunc('day', ts) AS day, sum(cost) AS cost FROM v_usage GROUP BY ALL)
, r AS (SELECT *, row_number() OVER (PARTITION BY purpose ORDER BY day DESC) AS k FROM d)
SELECT purpose, round(max(cost) FILTER (k = 1), 4) AS latest, round(quantile_cont(cost, 0.5) FILTER (k BETWEEN 2 AND 11), 4) AS median, max(cost) FILTER (k = 1) > 1.5 * quantile_cont(cost, 0.5) FILTER (k BETWEEN 2 AND 11) AS flagged FROM r GROUP BY purpose""")
def run_baseline(t: Tables) -> DataFrame:
    """Latest day per purpose against the median of the ten before."""
    d = t.usage.groupBy("purpose", F.date_trunc("day", "ts").alias("day")).agg(F.sum("cost").alias("cost"))
    r = d.withColumn("k", F.row_number().over(Window.partitionBy("purpose").orderBy(F.desc("day"))))
    latest, median = F.max(F.when(F.col("k") == 1, F.col("cost"))), F.percentile(F.when(F.col("k").between(2, 11), F.col("cost")), F.lit(0.5))
    return r.groupBy("purpose").agg(F.round(latest, 4).alias("latest"), F.round(median, 4).alias("median"), (latest > 1.5 * median).alias("flagged"))


@query("F63 A9", """
, rates AS (SELECT * FROM (VALUES ('mini', 0.15), ('mini-pro', 3.0)) r(prefix, rate))
, m AS (SELECT u.event_id, max_by(rate, length(prefix)) AS rate FROM v_usage u LEFT JOIN rates ON starts_with(u.model, prefix) GROUP BY u.event_id)
SELECT model, count(*) AS calls, count(*) FILTER (rate IS NULL) AS unpriced, round(sum(cost * coalesce(rate, 0)), 3) AS priced_cost FROM v_usage JOIN m USING (event_id) GROUP BY model""")
def llm_price_longest_prefix(t: Tables) -> DataFrame:
    """Price by the longest table key that begins the model's name: matched once per distinct model."""
    rates = t.spark.sql("SELECT * FROM VALUES ('mini', 0.15D), ('mini-pro', 3.0D) AS r(prefix, rate)")
    models = t.usage.select("model").distinct()
    found = models.join(F.broadcast(rates), F.col("model").startswith(F.col("prefix")), "left").groupBy("model").agg(F.max_by("rate", F.length("prefix")).alias("rate"))
    u = t.usage.join(found, "model")
    return u.groupBy("model").agg(F.count("*").alias("calls"), F.count_if(F.col("rate").isNull()).alias("unpriced"), F.round(F.sum(F.col("cost") * F.coalesce("rate", F.lit(0.0))), 3).alias("priced_cost"))


@query("A14 A15 A26", """SELECT a.story_id, count(*) AS ratings, count(DISTINCT l.doc_id) AS articles, round(avg(l.quality), 2) AS quality, round(nullif(avg(l.toxic), 0), 2) AS toxic FROM labels l JOIN v_articles a ON a.article_id = l.doc_id WHERE a.story_id IS NOT NULL GROUP BY a.story_id""")
def rating_aggregates(t: Tables) -> DataFrame:
    """Ratings per story; a mean of exactly 0 is reported as none."""
    r = t["labels"].join(t.articles.where("story_id IS NOT NULL").select(F.col("article_id").alias("doc_id"), "story_id"), "doc_id")
    return r.groupBy("story_id").agg(F.count("*").alias("ratings"), F.countDistinct("doc_id").alias("articles"), F.round(F.avg("quality"), 2).alias("quality"), F.round(F.nullif(F.avg("toxic"), F.lit(0.0)), 2).alias("toxic"))


@query("A16", """
, m AS (SELECT doc_id, (n_chars % 11) / 10.0::DOUBLE AS machine FROM documents WHERE n_chars >= 800), p AS (SELECT doc_id, 1 + 4 * quality::DOUBLE AS people FROM labels)
SELECT doc_id, round(CASE WHEN machine IS NOT NULL AND people IS NOT NULL THEN 0.4::DOUBLE * machine + 0.6::DOUBLE * (people - 1) / 4 ELSE coalesce(machine, (people - 1) / 4) END, 6) AS score,
 CASE WHEN machine IS NULL THEN 'human' WHEN people IS NULL THEN 'ai' ELSE 'combined' END AS basis FROM m FULL OUTER JOIN p USING (doc_id)""")
def combined_score(t: Tables) -> DataFrame:
    """Machine scores (texts long enough for one) and human scores, blended where both exist (full outer join)."""
    m = t["documents"].where("n_chars >= 800").select("doc_id", ((F.col("n_chars") % 11) / 10.0).alias("machine"))
    p = t["labels"].select("doc_id", (1 + 4 * F.col("quality").cast("double")).alias("people"))
    both = m.join(p, "doc_id", "full")
    basis = F.when(F.col("machine").isNull(), "human").when(F.col("people").isNull(), "ai").otherwise("combined")
    return both.select("doc_id", F.round(scores.combined(F.col("machine"), F.col("people")), 6).alias("score"), basis.alias("basis"))


@query("A46 A47 P32", """SELECT count(*) AS total, count(*) FILTER (published_at IS NULL) AS no_date, count(*) FILTER (content_type IS NULL) AS no_type, count(*) FILTER (embedding IS NULL) AS no_vector,
 round(100.0 * count(*) FILTER (embedding IS NULL) / count(*), 2) AS no_vector_pct, count(*) FILTER (length(regexp_replace(title, '[^A-Za-z]', '', 'g')) > 0.3 * length(title)) AS latin_titles FROM v_articles""")
def article_quality(t: Tables) -> DataFrame:
    none = lambda c: F.count_if(F.col(c).isNull())
    latin = F.length(F.regexp_replace("title", "[^A-Za-z]", "")) > 0.3 * F.length("title")
    return t.articles.agg(F.count("*").alias("total"), none("published_at").alias("no_date"), none("content_type").alias("no_type"), none("embedding").alias("no_vector"), F.round(100.0 * none("embedding") / F.count("*"), 2).alias("no_vector_pct"), F.count_if(latin).alias("latin_titles"))


@query("A7", "".join(f"""{' UNION ALL ' if i else ''}SELECT {h} AS window_hours, count(*) AS total, count(*) FILTER (embedding IS NULL) AS null_count, count(*) FILTER (len(list_filter(embedding, lambda x: x <> 0)) = 0) AS zero_count FROM v_articles WHERE ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL {h} HOUR""" for i, h in enumerate((1, 24, 168, 720))))
def embedding_health(t: Tables) -> DataFrame:
    """Missing and all-zero vectors in four windows: one scan, each row counted in the windows that hold it."""
    a = t.articles.select("ingested_at", F.col("embedding").isNull().alias("none"), (~F.exists("embedding", lambda x: x != 0)).alias("zero"))
    w = a.select("none", "zero", F.explode(F.array(*(F.when(F.col("ingested_at") >= hours_before(F.lit(h)), h) for h in (1, 24, 168, 720)))).alias("window_hours")).where("window_hours IS NOT NULL")
    return w.groupBy("window_hours").agg(F.count("*").alias("total"), F.count_if("none").alias("null_count"), F.count_if("zero").alias("zero_count"))


@query("A45", f"""
, d AS (SELECT count(*) FILTER (ingested_at >= {DAY}) AS today, count(*) FILTER (ingested_at < {DAY} AND ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 192 HOUR) / 7.0::DOUBLE AS usual FROM v_articles)
SELECT today, round(usual, 4) AS usual, CASE WHEN usual = 0 THEN 'unknown' WHEN today < 0.3 * usual THEN 'critical' WHEN today < 0.6 * usual THEN 'warning' ELSE 'ok' END AS severity FROM d""")
def ingestion_rate(t: Tables) -> DataFrame:
    new = F.col("ingested_at") >= hours_before(F.lit(24))
    d = t.articles.agg(F.count_if(new).alias("today"), (F.count_if(~new & (F.col("ingested_at") >= hours_before(F.lit(192)))) / 7.0).alias("usual"))
    severity = F.when(F.col("usual") == 0, "unknown").when(F.col("today") < 0.3 * F.col("usual"), "critical").when(F.col("today") < 0.6 * F.col("usual"), "warning").otherwise("ok")
    return d.select("today", F.round("usual", 4).alias("usual"), severity.alias("severity"))


@query("A23 W2", """
, w AS (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word, generate_subscripts(string_split(lower(text), ' '), 1) AS pos FROM documents)
, c AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM w WHERE length(word) >= 4 GROUP BY ALL)
SELECT doc_id, word, n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS k FROM c) WHERE k <= 5""")
def keyword_topk(t: Tables) -> DataFrame:
    """Five most frequent words of four letters or more per document, ties by first place."""
    # dealt by document once: counts and ranks need no further shuffle
    w = t["documents"].select("doc_id", "text").repartition("doc_id").select("doc_id", F.posexplode(F.split(F.lower("text"), " ")).alias("pos", "word")).where(F.length("word") >= 4)
    c = w.groupBy("doc_id", "word").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "first"))
    return c.withColumn("k", k).where("k <= 5").select("doc_id", "word", "n")


@query("A42", """
, s AS (SELECT DISTINCT article_id % 50 AS story, unnest(string_split(lower(title), ' ')) AS token FROM v_articles)
SELECT token, count(*) AS stories FROM s WHERE length(token) >= 3 GROUP BY token HAVING count(*) >= 0.15 * (SELECT count(DISTINCT article_id % 50) FROM v_articles)""")
def generic_tokens(t: Tables) -> DataFrame:
    """Title tokens that stand in 15 % or more of the stories."""
    s = t.articles.select((F.col("article_id") % 50).alias("story"), F.explode(F.split(F.lower("title"), " ")).alias("token")).where(F.length("token") >= 3)
    total = t.articles.agg(F.countDistinct(F.col("article_id") % 50).alias("total"))
    return s.groupBy("token").agg(F.countDistinct("story").alias("stories")).join(F.broadcast(total)).where("stories >= 0.15 * total").select("token", "stories")


@query("A50", "SELECT story_id, count(*) FILTER (content_type = 'news') AS news, count(*) FILTER (content_type = 'opinion') AS opinion, count(*) FILTER (content_type = 'analysis') AS analysis, count(*) FILTER (content_type = 'sport') AS sport FROM v_articles WHERE story_id IS NOT NULL GROUP BY story_id")
def framing_matrix(t: Tables) -> DataFrame:
    """Label counts per story as columns (pivot over the known labels)."""
    labels = ["news", "opinion", "analysis", "sport"]
    return t.articles.where("story_id IS NOT NULL").groupBy("story_id").pivot("content_type", labels).agg(F.count(F.lit(1))).na.fill(0, labels)


@query("A1 J14 A38 P29", """
, live AS (SELECT story_id, count(*) AS n, count(DISTINCT source_id) AS s FROM v_articles WHERE story_id IS NOT NULL AND story_id <> 3 GROUP BY 1)
SELECT story_id, article_count AS cached, coalesce(n, 0) AS live, coalesce(s, 0) AS live_sources, article_count IS DISTINCT FROM coalesce(n, 0) AS drift FROM v_stories LEFT JOIN live USING (story_id)""")
def recount_with_zero(t: Tables) -> DataFrame:
    """Cached counts beside live ones; a story that lost all its articles counts 0."""
    live = t.articles.where("story_id <> 3").groupBy("story_id").agg(F.count("*").alias("n"), F.countDistinct("source_id").alias("s"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = t.stories.select("story_id", F.col("article_count").alias("cached")).join(live, "story_id", "left")
    return j.select("story_id", "cached", zero("n").alias("live"), zero("s").alias("live_sources"), (~F.col("cached").eqNullSafe(zero("n"))).alias("drift"))


@query("A37", f"SELECT source_id, max(ingested_at) AS latest FROM v_sources LEFT JOIN (SELECT source_id, ingested_at FROM v_articles) USING (source_id) GROUP BY source_id HAVING max(ingested_at) IS NULL OR max(ingested_at) < {DAY}")
def source_silence(t: Tables) -> DataFrame:
    """Outlets without an article, or none in a day."""
    a = t.articles.select("source_id", "ingested_at")
    return t.sources.select("source_id").join(a, "source_id", "left").groupBy("source_id").agg(F.max("ingested_at").alias("latest")).where(F.col("latest").isNull() | (F.col("latest") < hours_before(F.lit(24))))


@query("A44", """
, p AS (SELECT DISTINCT story_id, source_id FROM v_articles WHERE story_id IS NOT NULL)
SELECT a.source_id, count(DISTINCT a.story_id) AS stories, count(*) AS pairs FROM p a JOIN p b ON a.story_id = b.story_id AND a.source_id <> b.source_id GROUP BY a.source_id""")
def comparison_sets(t: Tables) -> DataFrame:
    """Per outlet the stories that others cover too, and how many outlets it meets there: from counts, no pairs."""
    p = t.articles.where("story_id IS NOT NULL").select("story_id", "source_id").distinct()
    n = p.groupBy("story_id").agg((F.count("*") - 1).alias("others"))
    return p.join(n, "story_id").where("others > 0").groupBy("source_id").agg(F.count("*").alias("stories"), F.sum("others").alias("pairs"))
