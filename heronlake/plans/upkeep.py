"""Upkeep of stories: posts and pictures, neighbours, detaching, relabelling, cards, arcs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions import text, vector
from heronlake.operators import blocks, similarity
from heronlake.operators.graph import components
from heronlake.plans.coverage import GROUP_SQL, grouped_sources
from heronlake.plans.merging import SAME_EVENT, SMALL_SQL, event_rows, largest_gap_parts, small_stories
from heronlake.plans.ranking import CLUSTER_SQL, eligible, scored
from heronlake.plans.registry import query
from heronlake.plans.similarity import CENTROID_SQL, COSINE, STORED_SQL, against, story_centroids
from heronlake.plans.wording import RAW_SQL, STRIP, raw_posts
from heronlake.sources.adapters import Tables, hours_before
from heronlake.sources.storage import store


@query("P5", RAW_SQL + rf"""
, b AS (SELECT *, {STRIP.format("regexp_replace(x, 'https?://[^\\s]+', '', 'g')")} AS bare FROM (SELECT channel_id, message_id, x FROM raw))
SELECT channel_id, message_id, regexp_matches(x, 'https?://') OR (len(list_filter(string_split_regex(bare, '\s+'), lambda w: w <> '')) >= 5 AND length(bare) >= 30) AS kept FROM b""")
def post_noise(t: Tables) -> DataFrame:
    """Posts that stay: with a link, or five words and thirty characters beside links."""
    b = raw_posts(t).select("channel_id", "message_id", "x").withColumn("bare", text.strip(F.regexp_replace("x", r"https?://\S+", "")))
    words = F.size(F.filter(F.split("bare", r"\s+"), lambda w: w != ""))
    return b.select("channel_id", "message_id", (F.col("x").rlike("https?://") | ((words >= 5) & (F.length("bare") >= 30))).alias("kept"))


@query("P6", """
, d AS (SELECT doc_id FROM documents WHERE n_chars < 900)
, r AS (SELECT d.doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS rated, EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = d.doc_id) AS vector, EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = d.doc_id) AS posted, EXISTS (SELECT 1 FROM events v WHERE v.event_type = 'purchase' AND v.event_id // 40 = d.doc_id) AS bought FROM d)
SELECT count(*) AS asked, count(*) FILTER (rated) AS rated, count(*) FILTER (vector) AS vector, count(*) FILTER (posted) AS posted, count(*) FILTER (bought) AS bought, count(*) FILTER (NOT (rated OR vector OR posted OR bought)) AS deleted FROM r""")
def guarded_delete(t: Tables) -> DataFrame:
    """Rows that nothing in four child tables refers to, and how many each table holds back."""
    d = t["documents"].where("n_chars < 900").select("doc_id")
    children = {"rated": t["labels"].select("doc_id"), "vector": t["embeddings"].select(F.col("vec_id").alias("doc_id")), "posted": t["conversations"].select(F.col("conv_id").alias("doc_id")), "bought": t["events"].where("event_type = 'purchase'").select(F.floor(F.col("event_id") / 40).alias("doc_id"))}
    free = F.lit(True)
    for name, keys in children.items():
        d = d.join(keys.distinct().withColumn(name, F.lit(True)), "doc_id", "left")
        free = free & F.col(name).isNull()
    return d.agg(F.count("*").alias("asked"), *(F.count(name).alias(name) for name in children), F.count_if(free).alias("deleted"))


@query("J21", """
, art AS (SELECT url, regexp_replace(url, '^https?://', '') AS hostpath, min(story_id) AS story_id FROM v_articles WHERE story_id IS NOT NULL GROUP BY ALL)
, said AS (SELECT channel_id, message_id, CASE WHEN message_id % 2 = 0 THEN 'https://src' || channel_id % 20 || '.example/a/' || channel_id % 300 ELSE 'http://src' || channel_id % 20 || '.example/a/' || channel_id % 300 || '?x=1' END AS url FROM v_posts)
, hp AS (SELECT hostpath, min(story_id) AS story_id FROM art GROUP BY 1)
SELECT channel_id, message_id, coalesce(a.story_id, h.story_id) AS story_id FROM said s LEFT JOIN art a ON a.url = s.url LEFT JOIN hp h ON h.hostpath = regexp_replace(regexp_replace(s.url, '^https?://', ''), '\\?.*$', '') WHERE coalesce(a.story_id, h.story_id) IS NOT NULL""")
def url_story_links(t: Tables) -> DataFrame:
    """The story a post's link leads to: the exact address first, then host and path."""
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^https?://", ""), r"(?d)\?.*\z", "")
    art = t.articles.where("story_id IS NOT NULL").groupBy("url").agg(F.min("story_id").alias("exact"))
    hp = art.groupBy(bare(F.col("url")).alias("key")).agg(F.min("exact").alias("near"))
    c = F.col("channel_id")
    at = F.concat(F.lit("src"), c % 20, F.lit(".example/a/"), c % 300)
    said = t.posts.select("channel_id", "message_id", F.when(F.col("message_id") % 2 == 0, F.concat(F.lit("https://"), at)).otherwise(F.concat(F.lit("http://"), at, F.lit("?x=1"))).alias("url")).withColumn("key", bare(F.col("url")))
    j = said.join(art, "url", "left").join(hp, "key", "left")
    return j.select("channel_id", "message_id", F.coalesce("exact", "near").alias("story_id")).where("story_id IS NOT NULL")


@query("M21", STORED_SQL + f"""
, s AS (SELECT article_id, max({COSINE.format('embedding', 'centroid')}) AS best FROM vec CROSS JOIN cent WHERE arrived GROUP BY article_id), b AS (SELECT *, floor(best * 10)::BIGINT AS band FROM s)
SELECT band, article_id, round(best, 6) AS best, n FROM (SELECT *, count(*) OVER (PARTITION BY band) AS n, row_number() OVER (PARTITION BY band ORDER BY best DESC, article_id) AS k FROM b) WHERE k <= 3""")
def triage_top(t: Tables) -> DataFrame:
    """Arrivals by the band of their best score: how many, and the best three."""
    s = against(t, -1.0).groupBy("article_id").agg(F.max("score").alias("s")).withColumn("band", F.floor(F.col("s") * 10))
    k = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("s"), "article_id"))
    n = s.groupBy("band").agg(F.count("*").alias("n"))
    return s.withColumn("k", k).where("k <= 3").join(n, "band").select("band", "article_id", F.round("s", 6).alias("best"), "n")


NEAR_SQL = CENTROID_SQL + f", near AS (SELECT a.story_id, b.story_id AS other, {COSINE.format('a.centroid', 'b.centroid')} AS c FROM cent a JOIN cent b ON a.story_id <> b.story_id)\n"


def near_stories(t: Tables) -> DataFrame:
    c = story_centroids(t)
    parts = similarity.scored_blocks(c.select("story_id", "centroid"), "centroid", c.select(F.col("story_id").alias("other"), F.col("centroid").alias("v")), "other", "v")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("story_id <> other").select("story_id", "other", F.col("score").alias("c"))


@query("M35 F52", NEAR_SQL + "SELECT story_id, other, round(c, 6) AS c FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY c DESC, other) AS k FROM near WHERE c > -0.02) WHERE k <= 3")
def cross_story_context(t: Tables) -> DataFrame:
    """The three nearest stories above a cosine (test value -.02), from the matrix of all centroids."""
    n = near_stories(t).where("c > -0.02").withColumn("k", F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("c"), "other")))
    return n.where("k <= 3").select("story_id", "other", F.round("c", 6).alias("c"))


@query("M22", NEAR_SQL + """
, own AS (SELECT story_id, count(*) AS n FROM v_posts WHERE date >= TIMESTAMP '2024-01-20' GROUP BY 1), poor AS (SELECT story_id FROM cent LEFT JOIN own USING (story_id) WHERE coalesce(n, 0) < 20)
SELECT story_id, channel_id, message_id FROM (SELECT near.story_id, channel_id, message_id, row_number() OVER (PARTITION BY near.story_id ORDER BY date DESC, channel_id, message_id) AS k FROM near JOIN poor USING (story_id) JOIN v_posts p ON p.story_id = near.other WHERE c >= -0.02 AND date >= TIMESTAMP '2024-01-20') WHERE k <= 30""")
def borrowed_pool(t: Tables) -> DataFrame:
    """Thirty newest posts of near stories (test cosine -.02) for stories with fewer than twenty of their own."""
    posts = t.posts.where("date >= TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    rich = posts.groupBy("story_id").agg(F.count("*").alias("n")).where("n >= 20").select("story_id")
    j = near_stories(t).where("c >= -0.02").join(rich, "story_id", "left_anti").join(posts.select(F.col("story_id").alias("other"), "channel_id", "message_id", "date"), "other")
    k = F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("date"), "channel_id", "message_id"))
    return j.withColumn("k", k).where("k <= 30").select("story_id", "channel_id", "message_id")


@query("M23", CLUSTER_SQL + GROUP_SQL + """
, c AS (SELECT cluster_no AS cluster_id, count(*) FILTER (side = 'inside') AS i, count(*) FILTER (side = 'outside') AS o FROM v_articles JOIN sided USING (source_id) GROUP BY 1)
SELECT cluster_id, CASE WHEN o = 0 THEN 'outside' ELSE 'inside' END AS silent_side, round(greatest(i, o) * trending, 5) AS significance FROM c JOIN scored USING (cluster_id) WHERE (i >= 3 AND o = 0) OR (o >= 3 AND i = 0) ORDER BY greatest(i, o) * trending DESC, cluster_id LIMIT 5""")
def silences(t: Tables) -> DataFrame:
    """Stories that one side covers three times and the other not at all, the five most significant."""
    a = t.articles.select(F.col("cluster_no").alias("cluster_id"), "source_id").join(grouped_sources(t).select("source_id", "side"), "source_id")
    c = a.groupBy("cluster_id").agg(F.count_if(F.col("side") == "inside").alias("i"), F.count_if(F.col("side") == "outside").alias("o")).where("(i >= 3 AND o = 0) OR (o >= 3 AND i = 0)")
    s = c.join(scored(t).select("cluster_id", "trending"), "cluster_id").withColumn("s", F.greatest("i", "o") * F.col("trending"))
    return s.orderBy(F.desc("s"), "cluster_id").limit(5).select("cluster_id", F.when(F.col("o") == 0, "outside").otherwise("inside").alias("silent_side"), F.round("s", 5).alias("significance"))


@query("M28", CLUSTER_SQL + """
, o AS (SELECT cluster_no AS cluster_id, count(DISTINCT source_id) FILTER (state_alignment = 'state') AS s, count(DISTINCT source_id) FILTER (state_alignment = 'diaspora') AS d FROM v_articles JOIN v_sources USING (source_id) GROUP BY 1)
SELECT cluster_id, blindspot AS was, CASE WHEN s + d = 0 THEN NULL WHEN s * 100 >= 70 * (s + d) THEN 'state_only' WHEN d * 100 >= 70 * (s + d) THEN 'diaspora_only' END AS label, (CASE WHEN s + d = 0 THEN NULL WHEN s * 100 >= 70 * (s + d) OR d * 100 >= 70 * (s + d) THEN true END IS TRUE) <> blindspot AS changed FROM eligible JOIN o USING (cluster_id)""")
def relabelled_blindspots(t: Tables) -> DataFrame:
    """Homepage stories with their one-sidedness by outlets, and whether that changes their label."""
    al = F.col("state_alignment")
    a = t.articles.select(F.col("cluster_no").alias("cluster_id"), "source_id").join(t.sources.select("source_id", "state_alignment"), "source_id")
    o = a.groupBy("cluster_id").agg(F.countDistinct(F.when(al == "state", F.col("source_id"))).alias("s"), F.countDistinct(F.when(al == "diaspora", F.col("source_id"))).alias("d"))
    both = F.coalesce("s", F.lit(0)) + F.coalesce("d", F.lit(0))
    label = F.when(both == 0, None).when(F.col("s") * 100 >= 70 * both, "state_only").when(F.col("d") * 100 >= 70 * both, "diaspora_only")
    e = eligible(t).join(o, "cluster_id", "left")
    return e.select("cluster_id", F.col("blindspot").alias("was"), label.alias("label"), (label.isNotNull() != F.col("blindspot")).alias("changed"))


@query("M40 P2", CLUSTER_SQL + """
, off AS (SELECT article_id, cluster_no AS cluster_id FROM v_articles JOIN v_sources USING (source_id) WHERE content_type IS NOT NULL AND NOT list_contains(allowed, content_type) AND cluster_no IN (SELECT cluster_id FROM eligible) ORDER BY ingested_at DESC, article_id LIMIT 500)
SELECT cluster_id, count(*) AS detached, any_value(article_count) - count(*) AS left_over FROM off JOIN clusters USING (cluster_id) GROUP BY cluster_id""")
def offtopic_drain(t: Tables) -> DataFrame:
    """Articles of a kind their outlet isn't read for, out of visible stories, five hundred a run, and the counts after."""
    allowed = t.sources.select("source_id", F.from_json("content_filters", "allowed array<string>")["allowed"].alias("list"))
    a = t.articles.where("content_type IS NOT NULL").select("article_id", "source_id", "content_type", "ingested_at", F.col("cluster_no").alias("cluster_id")).join(allowed, "source_id").where(~F.array_contains("list", F.col("content_type")))
    off = a.join(eligible(t).select("cluster_id", "article_count"), "cluster_id").orderBy(F.desc("ingested_at"), "article_id").limit(500)
    return off.groupBy("cluster_id").agg(F.count("*").alias("detached"), (F.first("article_count") - F.count("*")).alias("left_over"))


@query("M37", CLUSTER_SQL + """
, act AS (SELECT event_id, event_type AS action, event_id // 40 AS article_id, user_id AS target, ts FROM events WHERE event_type IN ('signup', 'error'))
, last AS (SELECT article_id, arg_max(action, (ts, event_id)) AS action, arg_max(target, (ts, event_id)) AS target FROM act GROUP BY article_id)
, now_ AS (SELECT a.article_id, a.cluster_no AS old_id, CASE WHEN action = 'error' THEN NULL WHEN action = 'signup' AND c.frozen_at IS NULL THEN target ELSE a.cluster_no END AS new_id FROM v_articles a LEFT JOIN last USING (article_id) LEFT JOIN clusters c ON c.cluster_id = target)
SELECT coalesce(new_id, -1) AS cluster_id, count(*) AS articles, count(*) FILTER (new_id IS DISTINCT FROM old_id) AS moved FROM now_ GROUP BY 1""")
def assignment_events(t: Tables) -> DataFrame:
    """Attach and detach lists as people left them (the last word counts), refused by frozen stories; counts and moves after."""
    act = t["events"].where("event_type IN ('signup', 'error')").groupBy(F.floor(F.col("event_id") / 40).alias("article_id")).agg(F.max_by(F.struct("event_type", F.col("user_id").alias("target")), F.struct("ts", "event_id")).alias("l")).select("article_id", F.col("l.event_type").alias("action"), "l.target")
    frozen = scored(t).select(F.col("cluster_id").alias("target"), F.col("frozen_at").isNotNull().alias("frozen"))
    old = F.col("cluster_no")
    a = t.articles.select("article_id", "cluster_no").join(act, "article_id", "left").join(frozen, "target", "left")
    new = F.when(F.col("action") == "error", None).when((F.col("action") == "signup") & ~F.coalesce("frozen", F.lit(False)), F.col("target")).otherwise(old)
    return a.select(new.alias("n"), old.alias("o")).groupBy(F.coalesce("n", F.lit(-1)).alias("cluster_id")).agg(F.count("*").alias("articles"), F.count_if(~F.col("n").eqNullSafe(F.col("o"))).alias("moved"))


@query("M36 M39", CLUSTER_SQL + """
, img AS (SELECT cluster_no AS cluster_id, article_id, title, CASE WHEN n_chars % 9 = 0 THEN 'https://cdn.example/' || article_id || '.jpg' WHEN n_chars % 9 = 1 THEN 'https://i.example/p/' || article_id || '.jpg' END AS u FROM v_articles)
, t0 AS (SELECT cluster_id, list_distinct(list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) AS w FROM eligible)
, s AS (SELECT cluster_id, u, contains(u, 'cdn.') AS stable, len(list_intersect(t0.w, list_distinct(list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)))) AS o, article_id FROM img JOIN t0 USING (cluster_id) WHERE u IS NOT NULL)
, b AS (SELECT cluster_id, max_by(u, (CASE WHEN stable THEN 1 ELSE 0 END, o, length(u), article_id)) AS image, max_by(o, (CASE WHEN stable THEN 1 ELSE 0 END, o, length(u), article_id)) AS overlap, max(o) AS best FROM s GROUP BY 1)
SELECT cluster_id, image, CASE WHEN image IS NULL THEN 1 ELSE 0 END AS review_tier, coalesce(best > overlap, false) AS better_exists FROM eligible LEFT JOIN b USING (cluster_id)""")
def image_rescue(t: Tables) -> DataFrame:
    """Each visible story's picture by host, shared words and length; without one it goes to review; whether another fits the title better."""
    n = F.col("n_chars") % 9
    u = F.when(n == 0, F.concat(F.lit("https://cdn.example/"), "article_id", F.lit(".jpg"))).when(n == 1, F.concat(F.lit("https://i.example/p/"), "article_id", F.lit(".jpg")))
    e = eligible(t).select("cluster_id", text.tokens(F.col("title")).alias("w"))
    a = t.articles.select(F.col("cluster_no").alias("cluster_id"), "article_id", text.tokens(F.col("title")).alias("aw"), u.alias("u")).where("u IS NOT NULL").join(e, "cluster_id")
    a = a.withColumn("o", F.size(F.array_intersect("w", "aw")))
    rank = F.struct(F.col("u").contains("cdn.").alias("stable"), "o", F.length("u").alias("n"), "article_id")
    b = a.groupBy("cluster_id").agg(F.max_by(F.struct("u", "o"), rank).alias("b"), F.max("o").alias("best"))
    return e.join(b, "cluster_id", "left").select("cluster_id", F.col("b.u").alias("image"), F.when(F.col("b.u").isNull(), 1).otherwise(0).alias("review_tier"), F.coalesce(F.col("best") > F.col("b.o"), F.lit(False)).alias("better_exists"))


@query("M43 F79", CLUSTER_SQL + """
SELECT cluster_id, coalesce(CASE WHEN cluster_id % 7 = 0 THEN 'override' END, CASE WHEN cluster_id % 5 = 0 THEN 'stored' END, CASE WHEN article_count > 8 THEN 'picked' END, 'logo') AS image_from,
 coalesce(CASE WHEN cluster_id % 4 = 0 THEN 40 END, CASE WHEN state_count + diaspora_count > 0 THEN state_count * 100 // (state_count + diaspora_count) END, 0)::BIGINT AS inside, coalesce(CASE WHEN cluster_id % 4 = 0 THEN 60 END, CASE WHEN state_count + diaspora_count > 0 THEN 100 - state_count * 100 // (state_count + diaspora_count) END, 0)::BIGINT AS outside,
 CASE WHEN cluster_id % 3 <> 0 AND cluster_id % 9 <= 4 THEN 'hourly' WHEN cluster_id % 2 = 0 THEN 'snapshot' END AS signal, coalesce(CASE WHEN cluster_id % 3 = 0 THEN 'FR ' || cluster_id END, nullif(title, ''), 'EN ' || cluster_id) AS title FROM eligible""")
def assembled_cards(t: Tables) -> DataFrame:
    """A card's picture source, side shares (stored, else live), signal, and title in the reader's language or the next that exists."""
    c, s, d = F.col("cluster_id"), F.col("state_count"), F.col("diaspora_count")
    image = F.coalesce(F.when(c % 7 == 0, "override"), F.when(c % 5 == 0, "stored"), F.when(F.col("article_count") > 8, "picked"), F.lit("logo"))
    live = F.when(s + d > 0, F.floor(s * 100 / (s + d)))
    inside, outside = F.coalesce(F.when(c % 4 == 0, 40), live, F.lit(0)), F.coalesce(F.when(c % 4 == 0, 60), 100 - live, F.lit(0))
    title = F.coalesce(F.when(c % 3 == 0, F.concat(F.lit("FR "), c)), F.nullif(F.col("title"), F.lit("")), F.concat(F.lit("EN "), c))
    signal = F.when((c % 3 != 0) & (c % 9 <= 4), "hourly").when(c % 2 == 0, "snapshot")
    return eligible(t).select("cluster_id", image.alias("image_from"), inside.cast("long").alias("inside"), outside.cast("long").alias("outside"), signal.alias("signal"), title.alias("title"))


@query("M8", SMALL_SQL + """
, st AS (SELECT small_id, small_id % 6 = 0 AS pin, n, row_number() OVER (ORDER BY n DESC, small_id) AS r FROM small)
, e AS (SELECT a, b FROM pass UNION ALL SELECT b, a FROM pass)
SELECT e.b AS hidden, min_by(e.a, p.r) AS pin FROM e JOIN st p ON p.small_id = e.a AND p.pin JOIN st h ON h.small_id = e.b AND NOT h.pin GROUP BY e.b""")
def pinned_dedup(t: Tables) -> DataFrame:
    """Unpinned stories hidden behind a pinned one of the same event; the pin that ranks first claims each (every sixth is a pin here)."""
    small = store(small_stories(t), "small")
    told = event_rows(small, "small_id", "w", "centroid").join(small.select(F.col("small_id").alias("k"), (-F.col("n")).alias("rank")), "k")
    found = blocks.firsts(told.where("k % 6 = 0"), told.where("k % 6 <> 0"), SAME_EVENT)
    return found.select(F.col("k").alias("hidden"), F.col("first").alias("pin"))


@query("M3", """
, s AS (SELECT doc_id, sha1(lower(substr(text, 1, 80)) || '|' || substr(text, 1, 400)) AS sig, lower(string_split(substr(text, 1, 80), ' ')[1]) AS topic FROM documents)
, r AS (SELECT sig, min(doc_id) AS rep FROM s GROUP BY sig), g AS (SELECT topic, list(rep) AS reps FROM s JOIN r ON rep = doc_id WHERE topic <> '' GROUP BY topic)
, m AS (SELECT topic, s.doc_id FROM (SELECT topic, unnest(reps) AS rep FROM g) x JOIN r ON r.rep = x.rep JOIN s ON s.sig = r.sig)
SELECT topic, min(doc_id) AS first, count(*) AS members FROM (SELECT x.topic, x.doc_id FROM (SELECT topic AS topic, doc_id FROM m) x) GROUP BY topic HAVING count(*) >= 2""".replace("SELECT topic, s.doc_id FROM", "SELECT x.topic, s.doc_id FROM"))
def new_clusters(t: Tables) -> DataFrame:
    """New stories from unclustered texts: one representative per signature is grouped (by its first word here), its siblings follow, two at least."""
    d = t["documents"].select("doc_id", text.content_signature(F.substring("text", 1, 80), F.col("text")).alias("sig"), F.lower(F.get(F.split(F.substring("text", 1, 80), " "), F.lit(0))).alias("topic"))
    rep = d.groupBy("sig").agg(F.min_by("topic", "doc_id").alias("topic")).where("topic <> ''")
    return d.drop("topic").join(rep, "sig").groupBy("topic").agg(F.min("doc_id").alias("first"), F.count("*").alias("members")).where("members >= 2")


@query("M12", CLUSTER_SQL + f"""
, vec AS (SELECT cluster_no AS cluster_id, embedding FROM v_articles WHERE embedding IS NOT NULL), cell AS (SELECT cluster_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM vec), cent AS (SELECT cluster_id, list(x ORDER BY p) AS v FROM (SELECT cluster_id, p, avg(x) AS x FROM cell GROUP BY ALL) GROUP BY cluster_id)
, top AS (SELECT cluster_id, v FROM (SELECT * FROM eligible WHERE article_count >= 8 AND source_count >= 4 ORDER BY first_published_at DESC, cluster_id LIMIT 120) JOIN cent USING (cluster_id))
, e AS (SELECT a.cluster_id AS a, b.cluster_id AS b FROM top a JOIN top b ON a.cluster_id <> b.cluster_id WHERE {COSINE.format('a.v', 'b.v')} >= 0.3), reach(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b)
, c AS (SELECT a AS cluster_id, min(b) AS arc FROM reach GROUP BY a), n AS (SELECT *, count(*) OVER (PARTITION BY arc) AS n, row_number() OVER (PARTITION BY arc ORDER BY first_published_at DESC, cluster_id DESC) AS k FROM c JOIN eligible USING (cluster_id))
SELECT arc, count(*) AS chapters, min(cluster_id) AS first FROM n WHERE k <= 8 GROUP BY arc HAVING count(*) >= 3""")
def arc_suggestions(t: Tables) -> DataFrame:
    """Arcs of three to eight of the newest larger stories, linked by direction (test cosine .3), cut at gaps over four days
    while they have more than eight (the provided stories lie within hours of each other)."""
    v = vector.centroids(t.articles.where("embedding IS NOT NULL").withColumn("cluster_id", F.col("cluster_no")), "cluster_id", "embedding")
    top = store(eligible(t).where("article_count >= 8 AND source_count >= 4").orderBy(F.desc("first_published_at"), "cluster_id").limit(120).select("cluster_id", "first_published_at").join(v, "cluster_id"), "top")
    x, y = top.alias("x"), top.alias("y")
    # 120 rows by 120
    pairs = x.join(F.broadcast(y), (F.col("x.cluster_id") < F.col("y.cluster_id")) & (vector.cosine(F.col("x.centroid"), F.col("y.centroid")) >= 0.3)).select(F.col("x.cluster_id").alias("a"), F.col("y.cluster_id").alias("b"))
    c = components(pairs).select(F.col("node").alias("cluster_id"), F.col("root").alias("arc")).join(top.select("cluster_id", "first_published_at"), "cluster_id")
    parts = largest_gap_parts(c, "arc", "cluster_id", "first_published_at").join(c.select("cluster_id", "arc"), "cluster_id")
    return parts.groupBy("arc", "part").agg(F.count("*").alias("chapters"), F.min("cluster_id").alias("first")).where("chapters >= 3").select("arc", "chapters", "first")


@query("S22 S23", CLUSTER_SQL + """
, posted AS (SELECT DISTINCT user_id AS cluster_id FROM events WHERE event_type = 'purchase' AND ts >= TIMESTAMP '2024-01-30 20:00:00')
, top AS (SELECT * FROM eligible WHERE cluster_id NOT IN (SELECT cluster_id FROM posted) ORDER BY trending DESC, cluster_id LIMIT 5), p AS (SELECT * FROM (VALUES ('short', 280), ('long', 300)) v(platform, lim))
SELECT cluster_id, platform, substr(title || chr(10) || 'Coverage: ' || state_count || ' inside, ' || diaspora_count || ' outside' || CASE WHEN blindspot THEN chr(10) || 'One side is silent' ELSE '' END, 1, lim) AS post FROM top CROSS JOIN p""")
def post_previews(t: Tables) -> DataFrame:
    """The five most visible stories not posted yet, as each platform would show them: title, coverage, blindspot."""
    posted = t["events"].where("event_type = 'purchase' AND ts >= TIMESTAMP_NTZ '2024-01-30 20:00:00'").select(F.col("user_id").alias("cluster_id")).distinct()
    top = eligible(t).join(posted, "cluster_id", "left_anti").orderBy(F.desc("trending"), "cluster_id").limit(5)
    limits = F.explode(F.array(F.struct(F.lit("short").alias("platform"), F.lit(280).alias("lim")), F.struct(F.lit("long").alias("platform"), F.lit(300).alias("lim"))))
    body = F.concat("title", F.lit("\nCoverage: "), "state_count", F.lit(" inside, "), "diaspora_count", F.lit(" outside"), F.when(F.col("blindspot"), "\nOne side is silent").otherwise(""))
    return top.select("cluster_id", body.alias("b"), limits.alias("p")).select("cluster_id", "p.platform", F.substring("b", F.lit(1), F.col("p.lim")).alias("post"))


@query("A47", "SELECT count(*) FILTER (length(regexp_replace(title, '[^A-Za-z]', '', 'g')) > 0.3 * length(title)) AS latin_titles, count(*) FILTER (length(body) < 200) AS short_bodies, count(*) FILTER (published_at IS NULL) AS undated, count(*) FILTER (len(list_intersect(list_filter(string_split(lower(title), ' '), lambda w: length(w) >= 3), list_filter(string_split(lower(substr(body, 81, 300)), ' '), lambda w: length(w) >= 3))) = 0) AS unlike_body FROM v_articles")
def qa_checks(t: Tables) -> DataFrame:
    """Titles in Latin letters, short bodies, missing dates, and titles that share no word with what follows."""
    words = lambda c: F.filter(F.split(F.lower(c), " "), lambda w: F.length(w) >= 3)
    latin = F.length(F.regexp_replace("title", "[^A-Za-z]", "")) > 0.3 * F.length("title")
    apart = ~F.arrays_overlap(words(F.col("title")), words(F.substring("body", 81, 300)))
    return t.articles.agg(F.count_if(latin).alias("latin_titles"), F.count_if(F.length("body") < 200).alias("short_bodies"), F.count_if(F.col("published_at").isNull()).alias("undated"), F.count_if(apart).alias("unlike_body"))


@query("F45", """
, s AS (SELECT event_id, user_id, ts, substr(sha256('10.0.' || user_id % 7), 1, 16) || ':' || sha256('f' || user_id) AS identity FROM events WHERE event_type = 'click')
SELECT substr(identity, 1, 16) AS prefix, count(*) AS n, count(DISTINCT identity) AS people, count(*) FILTER (ts >= TIMESTAMP '2024-01-30') > 20 AS limited FROM s GROUP BY 1""")
def identity_prefixes(t: Tables) -> DataFrame:
    """Submissions by hashed address (the prefix of a layered identity), people behind it, and whether the day's limit is reached."""
    sha = lambda *c: F.sha2(F.concat(*c).cast("binary"), 256)
    s = t["events"].where("event_type = 'click'").select("ts", F.concat(F.substring(sha(F.lit("10.0."), F.col("user_id") % 7), 1, 16), F.lit(":"), sha(F.lit("f"), F.col("user_id"))).alias("identity"))
    return s.groupBy(F.substring("identity", 1, 16).alias("prefix")).agg(F.count("*").alias("n"), F.countDistinct("identity").alias("people"), (F.count_if(F.col("ts") >= hours_before(F.lit(24))) > 20).alias("limited"))


#: What bodies carry that isn't theirs.
BOILERPLATE = (r"(?i)Transferring to the website\.\.\.", r"در\s*[حﺡﺢﺣﺤ]ال\s*انتقال\s*به\s*سایت[\s\S]*$", r"گزارش\s+خطا[\s\S]*", r"(?m)^\s*کد\s+خبر:?\s*[\d۰-۹]+\s*$", r"(?m)^\s*\|\s*\|\s*[\d۰-۹]+\s+بازدید\s*$", r"(?m)^\s*تعداد\s+بازدید:?.*$")
CAPTION = {"src1": r"تصاویر\s+رسیده\s+به\s+ایران\s+اینترنشنال[^.؛\n]*[.؛]"}
DRESSED = ("Transferring to the website...", "\nکد خبر: ۱۲۳\n", "تصاویر رسیده به ایران اینترنشنال نشان می‌دهد. ", "گزارش خطا نظر شما", "\nتعداد بازدید: ۵\n", "در حال انتقال به سایت لطفا")


def replaced_sql(x: str, patterns) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p}', '', 'g')"
    return x


@query("F6 F41", ", d AS (SELECT article_id, source_id, substr(body, 1, 60) || ([" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in DRESSED) + f"])[article_id % {len(DRESSED)} + 1] || substr(body, 61) AS x FROM v_articles)" + f"""
, c AS (SELECT article_id, CASE WHEN source_id = 'src1' THEN regexp_replace({replaced_sql('x', BOILERPLATE)}, '{CAPTION['src1']}', '', 'g') ELSE {replaced_sql('x', BOILERPLATE)} END AS x FROM d)
SELECT article_id, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS kept, array_to_string(list_filter(list_transform(string_split_regex(x, '[؛.؟!]'), lambda s: trim(regexp_replace(regexp_replace(s, '[،,:«»"()\\-]', '', 'g'), '\\s+', ' ', 'g'))), lambda s: length(s) >= 15), '|') AS sentences FROM c""")
def stripped_bodies(t: Tables) -> DataFrame:
    """Bodies without what sites put into them, everywhere and by outlet; and their sentences without punctuation."""
    i = F.col("article_id")
    x = F.concat(F.substring("body", 1, 60), F.element_at(F.array(*map(F.lit, DRESSED)), (i % len(DRESSED) + 1).cast("int")), F.substring("body", 61, 2147483647))
    for p in BOILERPLATE:
        x = F.regexp_replace(x, text.to_the_end(p), "")
    for s, p in CAPTION.items():
        x = F.when(F.col("source_id") == s, F.regexp_replace(x, p, "")).otherwise(x)
    clean = lambda s: F.trim(F.regexp_replace(F.regexp_replace(s, r'[،,:«»"()\-]', ""), r"\s+", " "))
    said = F.filter(F.transform(F.split(x, "[؛.؟!]"), clean), lambda s: F.length(s) >= 15)
    return t.articles.select("article_id", F.trim(F.regexp_replace(x, r"\s+", " ")).alias("kept"), F.array_join(said, "|").alias("sentences"))


