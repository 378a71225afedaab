"""Work lists: what reviewers, editors and scheduled steps look at next."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions import text
from heronlake.plans.ranking import CLUSTER_SQL, eligible, scored
from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables, hours_before, now

DAYS = "date_diff('second', {}, TIMESTAMP '2024-01-31') // 86400"


def days_since(c: str) -> F.Column:
    return F.floor(F.timestamp_diff("SECOND", F.col(c), now()) / 86400)


@query("L5", CLUSTER_SQL + f"SELECT cluster_id, cluster_id % 4 AS tier, article_count, {DAYS.format('last_updated_at')} AS age_days FROM scored WHERE cluster_id % 4 >= 1 ORDER BY tier DESC, article_count DESC, cluster_id LIMIT 20")
def review_queue(t: Tables) -> DataFrame:
    """Stories of a review tier of one or more: highest tier, then largest."""
    s = scored(t).select("cluster_id", (F.col("cluster_id") % 4).alias("tier"), "article_count", days_since("last_updated_at").alias("age_days"))
    return s.where("tier >= 1").orderBy(F.desc("tier"), F.desc("article_count"), "cluster_id").limit(20)


@query("L6", CLUSTER_SQL + f"SELECT cluster_id, frozen_at, {DAYS.format('frozen_at')} AS frozen_days, article_count FROM scored WHERE frozen_at IS NOT NULL ORDER BY frozen_at DESC, cluster_id LIMIT 20")
def frozen_list(t: Tables) -> DataFrame:
    s = scored(t).where("frozen_at IS NOT NULL").orderBy(F.desc("frozen_at"), "cluster_id").limit(20)
    return s.select("cluster_id", "frozen_at", days_since("frozen_at").alias("frozen_days"), "article_count")


@query("L8", CLUSTER_SQL + """
, ok AS (SELECT DISTINCT cluster_no AS cluster_id FROM v_articles WHERE n_chars % 40 = 1)
SELECT cluster_id, round(trending, 6) AS trending FROM eligible WHERE article_count >= 3 AND cluster_id NOT IN (SELECT cluster_id FROM ok) ORDER BY eligible.trending DESC, cluster_id LIMIT 30""")
def image_gaps(t: Tables) -> DataFrame:
    """Visible stories without a usable image (few articles have one here), by trending."""
    ok = t.articles.where("n_chars % 40 = 1").select(F.col("cluster_no").alias("cluster_id")).distinct()
    gaps = eligible(t).where("article_count >= 3").join(ok, "cluster_id", "left_anti")
    return gaps.orderBy(F.desc("trending"), "cluster_id").limit(30).select("cluster_id", F.round("trending", 6).alias("trending"))


@query("L9", """
, ch AS (SELECT channel_id, count(*) > 2 AS active FROM v_posts GROUP BY channel_id)
SELECT channel_id, message_id, date FROM v_posts JOIN ch USING (channel_id) WHERE active AND trim(text) <> '' ORDER BY date DESC, channel_id, message_id LIMIT 50""")
def recent_posts(t: Tables) -> DataFrame:
    """The newest posts with text of active channels (those of more than two posts)."""
    active = t.posts.groupBy("channel_id").agg(F.count("*").alias("n")).where("n > 2").select("channel_id")
    p = t.posts.where(F.trim("text") != "").join(active, "channel_id", "left_semi")
    return p.orderBy(F.desc("date"), "channel_id", "message_id").limit(50).select("channel_id", "message_id", "date")


@query("L20", CLUSTER_SQL + """
, tried AS (SELECT user_id AS cluster_id, max(ts) AS tried_at, count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY 1)
SELECT s.cluster_id, priority FROM eligible s LEFT JOIN tried USING (cluster_id) WHERE NOT is_edited AND article_count >= 5 AND (tried_at IS NULL OR attempts < 3 OR tried_at < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR)
ORDER BY priority DESC, coalesce(frozen_at, first_published_at) DESC NULLS LAST, trending DESC, s.cluster_id LIMIT 25""")
def summary_pool(t: Tables) -> DataFrame:
    """Stories to summarise in homepage order: not edited by hand, and a day of rest after three failures."""
    tried = t["events"].groupBy(F.col("user_id").alias("cluster_id")).agg(F.max("ts").alias("tried_at"), F.count_if(F.col("event_type") == "error").alias("attempts"))
    s = eligible(t).where("NOT is_edited AND article_count >= 5").join(tried, "cluster_id", "left")
    s = s.where(F.col("tried_at").isNull() | (F.col("attempts") < 3) | (F.col("tried_at") < hours_before(F.lit(24))))
    return s.orderBy(F.desc("priority"), F.coalesce("frozen_at", "first_published_at").desc_nulls_last(), F.desc("trending"), "cluster_id").limit(25).select("cluster_id", "priority")


@query("L21", "SELECT story_id, channel_id, message_id, k FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY length(text) % 101 DESC, length(text) DESC, channel_id, message_id) AS k FROM v_posts WHERE role = 'assistant') WHERE k <= 5")
def prediction_ranking(t: Tables) -> DataFrame:
    """Per story the predictions of the highest share, longer ones first (the share is made from the length)."""
    n = F.length("text")
    k = F.row_number().over(Window.partitionBy("story_id").orderBy((n % 101).desc(), n.desc(), "channel_id", "message_id"))
    return t.posts.where("role = 'assistant'").select("story_id", "channel_id", "message_id", k.alias("k")).where("k <= 5")


@query("L22", """
, d AS (SELECT language, date_trunc('week', ingested_at) AS week, count(*) AS articles, count(DISTINCT source_id) AS outlets FROM v_articles GROUP BY ALL)
SELECT language, max(week) AS week, max_by(articles, week) AS articles FROM d WHERE articles >= 20 AND outlets >= 2 GROUP BY language""")
def latest_digest(t: Tables) -> DataFrame:
    """The newest weekly digest that passed its gate, per language."""
    d = t.articles.groupBy("language", F.date_trunc("week", "ingested_at").cast("timestamp_ntz").alias("week")).agg(F.count("*").alias("articles"), F.countDistinct("source_id").alias("outlets"))
    return d.where("articles >= 20 AND outlets >= 2").groupBy("language").agg(F.max("week").alias("week"), F.max_by("articles", "week").alias("articles"))


@query("L23", "SELECT channel_id, message_id, date FROM v_posts WHERE role = 'assistant' AND sentiment IS NULL AND date < TIMESTAMP '2024-01-31' - INTERVAL 3 DAY ORDER BY date, channel_id, message_id LIMIT 5")
def verification_queue(t: Tables) -> DataFrame:
    """Predictions without a verdict after three days, the oldest five."""
    p = t.posts.where("role = 'assistant' AND sentiment IS NULL").where(F.col("date") < hours_before(F.lit(72)))
    return p.orderBy("date", "channel_id", "message_id").limit(5).select("channel_id", "message_id", "date")


@query("W16", """
, top AS (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY date DESC, channel_id, message_id) AS k, list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: length(w) >= 3)) AS w FROM v_posts)
, near AS (SELECT a.story_id, a.k AS lo, b.k AS hi FROM top a JOIN top b ON a.story_id = b.story_id AND a.k < b.k AND b.k <= 40 WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))::DOUBLE >= 0.1)
, close AS (SELECT story_id, hi AS k, list(lo) AS before FROM near GROUP BY ALL)
, go(story_id, k, kept) AS (SELECT DISTINCT story_id, 0::BIGINT, []::BIGINT[] FROM top UNION ALL
  SELECT g.story_id, t.k, CASE WHEN list_has_any(g.kept, coalesce(c.before, []::BIGINT[])) THEN g.kept ELSE list_append(g.kept, t.k) END FROM go g JOIN top t ON t.story_id = g.story_id AND t.k = g.k + 1 AND t.k <= 40 LEFT JOIN close c ON c.story_id = t.story_id AND c.k = t.k)
SELECT t.story_id, t.channel_id, t.message_id FROM (SELECT story_id, unnest(arg_max(kept, k)) AS k FROM go GROUP BY story_id) f JOIN top t USING (story_id, k)""")
def distinct_in_rank_order(t: Tables) -> DataFrame:
    """The forty newest posts of a story, each kept if it isn't like one kept before (test Jaccard .1).

    The order decides, so this is a fold over a list; the list has forty items at most.
    """
    k = F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("date"), "channel_id", "message_id"))
    top = t.posts.select("story_id", "channel_id", "message_id", k.alias("k"), text.tokens(F.col("text")).alias("w")).where("k <= 40")
    item = F.struct("k", "channel_id", "message_id", "w")
    lists = top.groupBy("story_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    none = F.slice("items", F.lit(1), F.lit(0))
    like = lambda kept, x: F.exists(kept, lambda y: text.jaccard(y["w"], x["w"]) >= 0.1)
    kept = F.aggregate("items", none, lambda acc, x: F.when(like(acc, x), acc).otherwise(F.array_append(acc, x)))
    return lists.select("story_id", F.explode(kept).alias("p")).select("story_id", "p.channel_id", "p.message_id")


@query("P26", CLUSTER_SQL + """
, keep AS (SELECT cluster_id FROM scored ORDER BY trending DESC, cluster_id LIMIT 30)
SELECT cluster_id, CASE WHEN archived_at < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY THEN 'archived' ELSE 'never_shown' END AS reason FROM scored
WHERE archived_at < TIMESTAMP '2024-01-31' - INTERVAL 10 DAY OR (last_updated_at < TIMESTAMP '2024-01-31' - INTERVAL 1 DAY AND cluster_id % 3 <> 0 AND trending <= 8 AND NOT blindspot AND cluster_id NOT IN (SELECT cluster_id FROM keep))""")
def deletable_stories(t: Tables) -> DataFrame:
    """Stories archived for long, or old, never shown, low, two-sided and not in the keep set (test ages and score)."""
    s = scored(t)
    keep = s.orderBy(F.desc("trending"), "cluster_id").limit(30).select("cluster_id", F.lit(True).alias("kept"))
    old = F.coalesce(F.col("archived_at") < hours_before(F.lit(240)), F.lit(False))
    never = (F.col("last_updated_at") < hours_before(F.lit(24))) & (F.col("cluster_id") % 3 != 0) & (F.col("trending") <= 8) & ~F.col("blindspot") & F.col("kept").isNull()
    return s.join(keep, "cluster_id", "left").where(old | never).select("cluster_id", F.when(old, "archived").otherwise("never_shown").alias("reason"))


@query("P30", """
SELECT source_id, count(*) AS orphans FROM v_articles WHERE embedding IS NOT NULL AND ingested_at < TIMESTAMP '2024-01-31' - INTERVAL 6 HOUR AND ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR
 AND (published_at IS NULL OR published_at >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR) GROUP BY source_id""")
def recluster_orphans(t: Tables) -> DataFrame:
    """Embedded articles from six hours to seven days old on both clocks (a missing publication time passes)."""
    week = hours_before(F.lit(168))
    a = t.articles.where(F.col("embedding").isNotNull() & (F.col("ingested_at") < hours_before(F.lit(6))) & (F.col("ingested_at") >= week) & (F.col("published_at").isNull() | (F.col("published_at") >= week)))
    return a.groupBy("source_id").agg(F.count("*").alias("orphans"))


@query("P31", CLUSTER_SQL + """
SELECT cluster_id, priority, article_count FROM scored WHERE article_count >= 3 AND (priority >= 40 OR article_count < 30) AND last_updated_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY AND frozen_at IS NULL AND archived_at IS NULL
 AND (priority >= 40 OR coalesce(first_published_at, last_updated_at) >= TIMESTAMP '2024-01-31' - INTERVAL 29 DAY)""")
def match_targets(t: Tables) -> DataFrame:
    """Stories that may still take articles: size, freshness, not frozen, not archived; pinned ones pass size and age
    (test age 29 days)."""
    pinned = F.col("priority") >= 40
    s = scored(t).where((F.col("article_count") >= 3) & (pinned | (F.col("article_count") < 30)) & (F.col("last_updated_at") >= hours_before(F.lit(168))) & F.col("frozen_at").isNull() & F.col("archived_at").isNull())
    return s.where(pinned | (F.coalesce("first_published_at", "last_updated_at") >= hours_before(F.lit(29 * 24)))).select("cluster_id", "priority", "article_count")


@query("P20 P23", CLUSTER_SQL + "SELECT cluster_id, title FROM eligible WHERE contains(lower(title), 'a') AND article_count >= 2 ORDER BY trending DESC, cluster_id LIMIT 20")
def story_search(t: Tables) -> DataFrame:
    """Stories of two articles or more whose title holds a word, the most visible first."""
    return eligible(t).where(F.col("title").ilike("%a%") & (F.col("article_count") >= 2)).orderBy(F.desc("trending"), "cluster_id").limit(20).select("cluster_id", "title")


@query("P37", CLUSTER_SQL + """
, asked AS (SELECT DISTINCT TRY_CAST(trim(x) AS BIGINT) AS cluster_id FROM (SELECT unnest(string_split('3, 14,x,14, 500,7, 20,33', ',')) AS x))
SELECT cluster_id, article_count FROM eligible WHERE cluster_id IN (SELECT cluster_id FROM asked)""")
def batch_lookup(t: Tables) -> DataFrame:
    """Stories by a list of ids as a client sends it: what isn't a number is dropped, sixty are looked up at most."""
    ids = F.array_compact(F.transform(F.split(F.lit("3, 14,x,14, 500,7, 20,33"), ","), lambda x: F.trim(x).try_cast("bigint")))
    asked = t.spark.range(1).select(F.explode(F.slice(F.array_distinct(ids), 1, 60)).alias("cluster_id"))
    return eligible(t).join(asked, "cluster_id", "left_semi").select("cluster_id", "article_count")


@query("P8", "SELECT page_id FROM pages WHERE NOT (contains(url, '/tag/') OR (contains(url, '.example.net') AND contains(url, '/2')) OR (contains(url, '.example.org') AND contains(url, '/1')))")
def url_exclusion(t: Tables) -> DataFrame:
    """Pages whose address holds nothing that its site excludes."""
    rules = {"": ("/tag/",), ".example.net": ("/2",), ".example.org": ("/1",)}
    hit = F.lit(False)
    for site, parts in rules.items():
        hit = hit | (F.col("url").contains(site) & F.exists(F.array(*map(F.lit, parts)), lambda p: F.col("url").contains(p)))
    return t["pages"].where(~hit).select("page_id")


@query("P27 P28", """
SELECT 'events' AS name, count(*) FILTER (ts < TIMESTAMP '2024-01-10') AS gone, count(*) FILTER (ts >= TIMESTAMP '2024-01-10') AS kept, 0::BIGINT AS nulled FROM events
UNION ALL SELECT 'articles', count(*) FILTER (ingested_at < TIMESTAMP '2024-01-08'), count(*) FILTER (ingested_at >= TIMESTAMP '2024-01-08'), 0 FROM v_articles
UNION ALL SELECT 'posts', count(*) FILTER (p.date < TIMESTAMP '2024-01-15'), count(*) FILTER (p.date >= TIMESTAMP '2024-01-15'), count(*) FILTER (p.date >= TIMESTAMP '2024-01-15' AND r.date < TIMESTAMP '2024-01-15') FROM v_posts p LEFT JOIN v_posts r ON r.channel_id = p.channel_id + 1 AND r.message_id = p.message_id""")
def table_retention(t: Tables) -> DataFrame:
    """Rows past each table's age, and references to deleted posts that are nulled first (posts refer to the next channel's here)."""
    def split(df: DataFrame, name: str, at: str, day: str) -> DataFrame:
        old = F.col(at) < F.expr(f"TIMESTAMP_NTZ '{day} 00:00:00'")
        return df.agg(F.count_if(old).alias("gone"), F.count_if(~old).alias("kept"), F.count_if(~old & F.col("lost")).alias("nulled")).withColumn("name", F.lit(name))

    p = t.posts
    refers = p.select((F.col("channel_id") - 1).alias("channel_id"), "message_id", (F.col("date") < F.expr("TIMESTAMP_NTZ '2024-01-15 00:00:00'")).alias("lost"))
    posts = p.select("channel_id", "message_id", "date").join(refers, ["channel_id", "message_id"], "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
    plain = lambda df: df.withColumn("lost", F.lit(False))
    return split(plain(t["events"]), "events", "ts", "2024-01-10").unionByName(split(plain(t.articles), "articles", "ingested_at", "2024-01-08")).unionByName(split(posts, "posts", "date", "2024-01-15"))


@query("T13 F74", CLUSTER_SQL + """
, h AS (SELECT cluster_id, CASE WHEN cluster_id % 3 <> 0 THEN TIMESTAMP '2024-01-31' - to_hours(CAST(cluster_id % 9 AS INTEGER)) END AS hourly_at, CASE WHEN cluster_id % 2 = 0 THEN 'snapshot' END AS snapshot, last_updated_at, article_count FROM scored)
SELECT cluster_id, CASE WHEN date_diff('second', hourly_at, TIMESTAMP '2024-01-31') BETWEEN 0 AND 4 * 3600 THEN 'hourly' ELSE snapshot END AS signal,
 coalesce(date_diff('second', last_updated_at, TIMESTAMP '2024-01-31') <= 86400 AND article_count > 2 AND (snapshot IS NOT NULL OR hourly_at IS NOT NULL), false) AS badge FROM h""")
def update_signals(t: Tables) -> DataFrame:
    """The hourly signal counts for four hours, then that of the snapshot; the badge lasts a day and needs coverage over two."""
    c = F.col("cluster_id")
    hourly = F.when(c % 3 != 0, hours_before((c % 9).cast("int")))
    snapshot = F.when(c % 2 == 0, "snapshot")
    age = lambda at: F.timestamp_diff("SECOND", at, now())
    fresh = (age(F.col("last_updated_at")) <= 86400) & (F.col("article_count") > 2) & (snapshot.isNotNull() | hourly.isNotNull())
    return scored(t).select("cluster_id", F.when(age(hourly).between(0, 4 * 3600), "hourly").otherwise(snapshot).alias("signal"), F.coalesce(fresh, F.lit(False)).alias("badge"))


@query("T18 A11", """
, m AS (SELECT coalesce(sum(cost), 0) AS month, coalesce(sum(cost) FILTER (ts >= TIMESTAMP '2024-01-30'), 0) AS today FROM v_usage WHERE ts >= TIMESTAMP '2024-01-01')
, c AS (SELECT * FROM m, (VALUES ('locked', true, false, 1e9), ('cleared', true, true, 1e9), ('hard', false, false, 1.1), ('soft', false, false, 1.2), ('free', false, false, 1e9)) v(name, lock, clear, share))
SELECT name, CASE WHEN clear THEN false WHEN lock THEN true ELSE month >= 0.80 * (month * share) END AS halt, CASE WHEN clear THEN 'override' WHEN lock THEN 'manual_lock' WHEN month >= 0.85 * (month * share) THEN 'hard_cap' WHEN month >= 0.80 * (month * share) THEN 'soft_cap' END AS reason FROM c""")
def budget_breaker(t: Tables) -> DataFrame:
    """Whether paid steps stop: a one-shot clearance, a manual lock, then 85 and 80 % of the month's budget (cases made from the month's cost)."""
    month = t.usage.where("ts >= TIMESTAMP_NTZ '2024-01-01 00:00:00'").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("month"))
    cases = t.spark.createDataFrame([("locked", True, False, 1e9), ("cleared", True, True, 1e9), ("hard", False, False, 1.1), ("soft", False, False, 1.2), ("free", False, False, 1e9)], "name string, lock boolean, clear boolean, share double")
    over = lambda p: F.col("month") >= p * (F.col("month") * F.col("share"))
    reason = F.when(F.col("clear"), "override").when(F.col("lock"), "manual_lock").when(over(0.85), "hard_cap").when(over(0.80), "soft_cap")
    return cases.join(F.broadcast(month)).select("name", F.when(F.col("clear"), False).when(F.col("lock"), True).otherwise(over(0.80)).alias("halt"), reason.alias("reason"))


@query("T12", """
SELECT user_id AS item, count(*) FILTER (event_type = 'error') AS attempts, max(ts) FILTER (event_type = 'error') AS last_try,
 coalesce(count(*) FILTER (event_type = 'error') < 130 AND (max(ts) FILTER (event_type = 'error') IS NULL OR max(ts) FILTER (event_type = 'error') < TIMESTAMP '2024-01-30'), false) AS due FROM events GROUP BY user_id""")
def retry_state(t: Tables) -> DataFrame:
    """Failures so far and whether another try is due: too few failures and a day since the last (test limit 130)."""
    bad = F.col("event_type") == "error"
    e = t["events"].groupBy(F.col("user_id").alias("item")).agg(F.count_if(bad).alias("attempts"), F.max(F.when(bad, F.col("ts"))).alias("last_try"))
    return e.withColumn("due", (F.col("attempts") < 130) & (F.col("last_try").isNull() | (F.col("last_try") < hours_before(F.lit(24)))))


@query("A10", """
, g AS (SELECT story_id, purpose, count(*) AS calls, sum(cost) AS cost FROM v_usage GROUP BY ALL), s AS (SELECT story_id, sum(cost) AS total FROM g GROUP BY 1 ORDER BY total DESC, story_id LIMIT 5)
SELECT story_id, round(total, 3) AS total, array_to_string(list(purpose || ':' || calls ORDER BY purpose), ',') AS purposes FROM s JOIN g USING (story_id) GROUP BY ALL""")
def cost_breakdown(t: Tables) -> DataFrame:
    """The five dearest stories with their calls by purpose."""
    g = t.usage.groupBy("story_id", "purpose").agg(F.count("*").alias("calls"), F.sum("cost").alias("cost"))
    s = g.groupBy("story_id").agg(F.sum("cost").alias("total"), F.array_sort(F.collect_list(F.struct("purpose", "calls"))).alias("p")).orderBy(F.desc("total"), "story_id").limit(5)
    return s.select("story_id", F.round("total", 3).alias("total"), F.array_join(F.transform("p", lambda x: F.concat(x["purpose"], F.lit(":"), x["calls"])), ",").alias("purposes"))


@query("A12 W3", """
, r AS (SELECT event_id // 50 AS run, event_type AS step, value FROM events), n AS (SELECT run, step, sum(value) AS mb FROM r GROUP BY ALL)
, a AS (SELECT step, count(*) AS runs, sum(mb) AS total, max(mb) AS peak, avg(mb) AS mean FROM n GROUP BY step)
SELECT step, runs, round(total, 3) AS total, round(peak, 3) AS peak, round(mean, 4) AS mean, round(100 * sum(total) OVER (ORDER BY total DESC, step) / sum(total) OVER (), 3) AS cumulative FROM a""")
def step_egress(t: Tables) -> DataFrame:
    """Cost of steps over runs, whose results are stored as a JSON map per run, with the running share."""
    per = t["events"].groupBy(F.floor(F.col("event_id") / 50).alias("run"), F.col("event_type").alias("step")).agg(F.sum("value").alias("mb"))
    runs = per.groupBy("run").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("step", "mb")))).alias("doc"))
    n = runs.select("run", F.explode(F.from_json("doc", "map<string, double>")).alias("step", "mb"))
    a = n.groupBy("step").agg(F.count("*").alias("runs"), F.sum("mb").alias("total"), F.max("mb").alias("peak"), F.avg("mb").alias("mean"))
    # one row per step
    upto = F.sum("total").over(Window.orderBy(F.desc("total"), "step")) / F.sum("total").over(Window.partitionBy())
    return a.select("step", "runs", F.round("total", 3).alias("total"), F.round("peak", 3).alias("peak"), F.round("mean", 4).alias("mean"), F.round(100 * upto, 3).alias("cumulative"))


@query("L11", """
, img AS (SELECT cluster_no AS cluster_id, article_id, title, CASE n_chars % 4 WHEN 0 THEN 'https://i.example/logo.png' WHEN 1 THEN 'https://i.example/p/' || article_id || '-1200x800.jpg' WHEN 2 THEN 'https://cdn.example/' || article_id || '.webp' END AS u FROM v_articles)
, w AS (SELECT cluster_id, list_distinct(list_filter(string_split_regex(lower(min(title)), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) AS w FROM img GROUP BY 1)
, s AS (SELECT img.*, len(list_intersect(w.w, list_distinct(list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)))) AS overlap, contains(u, 'cdn.') AS stable, contains(u, 'logo') AS logo FROM img JOIN w USING (cluster_id) WHERE u IS NOT NULL)
, best AS (SELECT cluster_id, max_by(u, (CASE WHEN contains(u, '1200') THEN 12 ELSE 6 END + 2 * overlap + 2 * CASE WHEN stable THEN 1 ELSE 0 END, overlap, length(u), article_id)) FILTER (NOT logo) AS u, count(*) FILTER (logo) AS logos FROM s GROUP BY 1)
SELECT cluster_id, coalesce(u, CASE WHEN logos > 0 THEN 'https://i.example/logo.png' END) AS image FROM best""")
def image_picks(t: Tables) -> DataFrame:
    """A story's picture: quality, words its article shares with the story's title, and a stable host; a logo if there is nothing else."""
    i, n = F.col("article_id"), F.col("n_chars") % 4
    u = F.when(n == 0, "https://i.example/logo.png").when(n == 1, F.concat(F.lit("https://i.example/p/"), i, F.lit("-1200x800.jpg"))).when(n == 2, F.concat(F.lit("https://cdn.example/"), i, F.lit(".webp")))
    a = t.articles.select(F.col("cluster_no").alias("cluster_id"), "article_id", "title", u.alias("u"))
    w = a.groupBy("cluster_id").agg(text.tokens(F.min("title")).alias("w"))
    s = a.where("u IS NOT NULL").join(w, "cluster_id").withColumn("overlap", F.size(F.array_intersect("w", text.tokens(F.col("title"))))).withColumn("logo", F.col("u").contains("logo"))
    score = F.when(F.col("u").contains("1200"), 12).otherwise(6) + 2 * F.col("overlap") + 2 * F.col("u").contains("cdn.").cast("int")
    rank = F.when(~F.col("logo"), F.struct(score.alias("s"), "overlap", F.length("u").alias("n"), "article_id"))
    best = s.groupBy("cluster_id").agg(F.max_by("u", rank).alias("u"), F.count_if("logo").alias("logos"))
    return best.select("cluster_id", F.coalesce("u", F.when(F.col("logos") > 0, "https://i.example/logo.png")).alias("image"))


@query("P3 T4", """
, tried AS (SELECT event_id // 40 AS article_id, count(*) AS attempts FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT a.article_id, coalesce(attempts, 0) AS attempts FROM v_articles a LEFT JOIN tried USING (article_id) WHERE story_id IS NULL AND coalesce(attempts, 0) < 8 AND ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR AND (published_at IS NULL OR published_at >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR) AND content_type IS NOT NULL ORDER BY ingested_at DESC, a.article_id LIMIT 200""")
def cluster_queue(t: Tables) -> DataFrame:
    """Unclustered articles, fresh on both clocks, typed and not tried too often (test limit eight), newest first."""
    tried = t["events"].where("event_type = 'error'").groupBy(F.floor(F.col("event_id") / 40).alias("article_id")).agg(F.count("*").alias("attempts"))
    week = hours_before(F.lit(168))
    a = t.articles.where(F.col("story_id").isNull() & (F.col("ingested_at") >= week) & (F.col("published_at").isNull() | (F.col("published_at") >= week)) & F.col("content_type").isNotNull())
    a = a.join(tried, "article_id", "left").withColumn("attempts", F.coalesce("attempts", F.lit(0))).where("attempts < 8")
    return a.orderBy(F.desc("ingested_at"), "article_id").limit(200).select("article_id", "attempts")


@query("P19", CLUSTER_SQL + """
SELECT article_id FROM v_articles JOIN clusters ON cluster_id = cluster_no WHERE (contains(lower(a_title), 'ion') OR contains(lower(body), 'ion') OR contains(lower(language || ' ' || url), 'ion')) AND (story_id IS NULL OR article_count < 5) AND ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY ORDER BY ingested_at DESC, article_id LIMIT 50""".replace("a_title", "v_articles.title"))
def seeding_search(t: Tables) -> DataFrame:
    """Articles of the last days that hold a word in one of three text columns and have no story, or a weak one."""
    a = t.articles.join(scored(t).select("cluster_id", "article_count"), F.col("cluster_no") == F.col("cluster_id"))
    hit = F.col("title").ilike("%ion%") | F.col("body").ilike("%ion%") | F.concat("language", F.lit(" "), "url").ilike("%ion%")
    weak = F.col("story_id").isNull() | (F.col("article_count") < 5)
    return a.where(hit & weak & (F.col("ingested_at") >= hours_before(F.lit(240)))).orderBy(F.desc("ingested_at"), "article_id").limit(50).select("article_id")


@query("A19", """
, bias AS (SELECT doc_id AS article_id, quality, toxic, CASE WHEN doc_id % 4 <> 0 THEN 'because' END AS reasoning FROM labels UNION ALL SELECT doc_id, 1 - quality, toxic, NULL FROM labels WHERE toxic = 0)
SELECT article_id, quality, reasoning IS NOT NULL AS reasoned FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY reasoning IS NULL, quality DESC) AS k FROM bias) WHERE k = 1""")
def best_score_rows(t: Tables) -> DataFrame:
    """One score row per article: one with a reason if there is one."""
    rows = t["labels"].select(F.col("doc_id").alias("article_id"), "quality", F.when(F.col("doc_id") % 4 != 0, "because").alias("reasoning")).unionByName(t["labels"].where("toxic = 0").select(F.col("doc_id").alias("article_id"), (1 - F.col("quality")).alias("quality"), F.lit(None).cast("string").alias("reasoning")))
    best = rows.groupBy("article_id").agg(F.max(F.struct(F.col("reasoning").isNotNull().alias("reasoned"), "quality")).alias("b"))
    return best.select("article_id", "b.quality", "b.reasoned")


@query("A52", "SELECT event_id, event_type, ts FROM events WHERE event_type IN ('error', 'purchase') ORDER BY ts DESC, event_id DESC LIMIT 40")
def log_listing(t: Tables) -> DataFrame:
    """The newest log rows."""
    return t["events"].where("event_type IN ('error', 'purchase')").orderBy(F.desc("ts"), F.desc("event_id")).limit(40).select("event_id", "event_type", "ts")
