"""Editorial rules: titles, images, labels, matching decisions, digests, slots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions import dates, text, vector
from heronlake.operators import similarity
from heronlake.plans.coverage import GROUP_SQL, grouped_sources
from heronlake.plans.ranking import CLUSTER_SQL, scored
from heronlake.plans.registry import query
from heronlake.plans.similarity import COSINE, STORED_SQL, story_centroids, vectors
from heronlake.sources.adapters import Tables, hours_before

#: Fixed values for the tests' language: tokens of titles about the page, not the event.
META = ("ing the", "!!", "###")


@query("P15 P33", """
, x AS (SELECT article_id, regexp_replace(title, '\\|[^\\n]+$', '') AS proposed, CASE WHEN article_id % 3 <> 0 THEN substr(body, 1, 20) END AS current, source_id AS fallback FROM v_articles)
SELECT article_id, coalesce(CASE WHEN NOT (contains(proposed, 'ing the') OR contains(proposed, '!!') OR contains(proposed, '###')) THEN proposed END, CASE WHEN NOT (contains(current, 'ing the') OR contains(current, '!!') OR contains(current, '###')) THEN current END, fallback) AS title FROM x""")
def clean_titles(t: Tables) -> DataFrame:
    """The first of proposed, current and fallback title that isn't about the page itself."""
    meta = lambda c: c.contains(META[0]) | c.contains(META[1]) | c.contains(META[2])
    proposed, current = F.regexp_replace("title", r"\|[^\n]+\z", ""), F.when(F.col("article_id") % 3 != 0, F.substring("body", 1, 20))
    return t.articles.select("article_id", F.coalesce(F.when(~meta(proposed), proposed), F.when(~meta(current), current), "source_id").alias("title"))


IMAGE_SQL = """
, img AS (SELECT article_id, story_id, CASE article_id % 6 WHEN 0 THEN 'https://i.example/logo.png' WHEN 1 THEN 'https://i.example/p/' || article_id || '-1200x800.jpg' WHEN 2 THEN 'https://i.example/t/' || article_id || '-150x150.jpg' WHEN 3 THEN 'x.png' WHEN 4 THEN 'https://cdn.example/w/' || article_id || '.webp' END AS u FROM v_articles WHERE story_id IS NOT NULL)
, ok AS (SELECT * FROM img WHERE u IS NOT NULL AND length(u) >= 10 AND NOT regexp_matches(u, '(?i)logo|icon|favicon|avatar|pixel'))
, sc AS (SELECT *, coalesce(TRY_CAST(regexp_extract(u, '-([0-9]+)x[0-9]+', 1) AS INT), 600) // 100 + CASE WHEN u LIKE '%.webp' THEN 2 ELSE 0 END AS score FROM ok)
"""


@query("P9 P10 F39", IMAGE_SQL + "SELECT story_id, max_by(u, (score, length(u), article_id)) AS image, max(score)::INT AS score, count(*) AS usable FROM sc GROUP BY story_id")
def best_images(t: Tables) -> DataFrame:
    """The best usable image per story: not an icon, by size and format, longest address."""
    i = F.col("article_id")
    u = F.when(i % 6 == 0, "https://i.example/logo.png").when(i % 6 == 1, F.concat(F.lit("https://i.example/p/"), i, F.lit("-1200x800.jpg"))).when(i % 6 == 2, F.concat(F.lit("https://i.example/t/"), i, F.lit("-150x150.jpg"))).when(i % 6 == 3, "x.png").when(i % 6 == 4, F.concat(F.lit("https://cdn.example/w/"), i, F.lit(".webp")))
    img = t.articles.where("story_id IS NOT NULL").select("article_id", "story_id", u.alias("u"))
    ok = img.where((F.length("u") >= 10) & ~F.col("u").rlike("(?i)logo|icon|favicon|avatar|pixel"))
    width = F.coalesce(F.expr("try_cast(regexp_extract(u, '-([0-9]+)x[0-9]+', 1) AS int)"), F.lit(600))
    s = ok.withColumn("score", (F.floor(width / 100) + F.when(F.col("u").endswith(".webp"), 2).otherwise(0)).cast("int"))
    return s.groupBy("story_id").agg(F.max_by("u", F.struct("score", F.length("u"), "article_id")).alias("image"), F.max("score").alias("score"), F.count("*").alias("usable"))


@query("F62", """SELECT article_id, CASE WHEN contains(body, '!!') THEN 'opinion' WHEN contains(body, ' | ') THEN 'aggregation' WHEN n_chars < 300 THEN 'brief' WHEN contains(url, '/a/7') THEN 'news' END AS label,
 CASE WHEN contains(body, '!!') THEN 0.9::DOUBLE WHEN contains(body, ' | ') THEN 0.85::DOUBLE WHEN n_chars < 300 THEN 0.7::DOUBLE WHEN contains(url, '/a/7') THEN 0.8::DOUBLE END AS confidence FROM v_articles""")
def content_heuristics(t: Tables) -> DataFrame:
    """An ordered rule list: the first that applies gives label and confidence."""
    rules = [(F.col("body").contains("!!"), "opinion", 0.9), (F.col("body").contains(" | "), "aggregation", 0.85), (F.col("n_chars") < 300, "brief", 0.7), (F.col("url").contains("/a/7"), "news", 0.8)]
    label, confidence = F, F
    for c, name, p in rules:
        label, confidence = label.when(c, name), confidence.when(c, F.lit(p))
    return t.articles.select("article_id", label.alias("label"), confidence.alias("confidence"))


@query("F40", r"""
, s AS (SELECT channel_id, message_id, list_distinct(list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda x: regexp_replace(x, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')), lambda x: length(x) >= 15)) AS s FROM v_posts)
, p AS (SELECT a.channel_id, a.message_id, len(a.s) AS n, len(list_filter(a.s, lambda x: NOT list_contains(b.s, x))) AS fresh FROM s a JOIN s b ON a.channel_id = b.channel_id AND a.message_id = b.message_id + 2)
SELECT channel_id, message_id, CASE WHEN n = 0 OR fresh > 0.995 * n THEN 0 ELSE least(fresh, 4) END AS shown FROM p""")
def sentence_diff(t: Tables) -> DataFrame:
    """New sentences of a text against its predecessor: four at most, none when nearly all is new (test share)."""
    s = t.posts.select("channel_id", "message_id", F.array_distinct(text.sentences(F.col("text"))).alias("s"))
    p = s.join(s.select("channel_id", (F.col("message_id") + 2).alias("message_id"), F.col("s").alias("before")), ["channel_id", "message_id"])
    n, fresh = F.size("s"), F.size(F.array_except("s", "before"))
    return p.select("channel_id", "message_id", F.when((n == 0) | (fresh > 0.995 * n), 0).otherwise(F.least(fresh, F.lit(4))).alias("shown"))


@query("F33 F32", """
, d AS (SELECT CAST(ts + INTERVAL 210 MINUTE AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY ALL), k AS (SELECT *, date_diff('day', DATE '2023-03-21', day) AS i FROM d)
SELECT CAST(day AS VARCHAR) AS local_day, event_type, n, '1402-' || lpad(CAST(CASE WHEN i < 186 THEN i // 31 + 1 ELSE (i - 186) // 30 + 7 END AS VARCHAR), 2, '0') || '-' || lpad(CAST(CASE WHEN i < 186 THEN i % 31 + 1 ELSE (i - 186) % 30 + 1 END AS VARCHAR), 2, '0') AS jalali FROM k""")
def local_days(t: Tables) -> DataFrame:
    """Events by the reader's day, with its date in the Solar Hijri calendar."""
    d = t["events"].groupBy(dates.local_day(F.col("ts")).alias("day"), "event_type").agg(F.count("*").alias("n"))
    return d.select(F.col("day").cast("string").alias("local_day"), "event_type", "n", dates.jalali(F.col("day")).alias("jalali"))


@query("F48 F50 X9 X10", """
, v AS (SELECT event_id, json_extract_string(props, '$.k')::INT AS k, event_type FROM events WHERE event_type <> 'view')
SELECT event_type, count(*) AS verdicts, round(avg(least(1.0::DOUBLE, (CASE WHEN k % 2 = 0 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) * 0.85::DOUBLE + 0.15::DOUBLE)), 6) AS confidence FROM v GROUP BY event_type""")
def verdicts(t: Tables) -> DataFrame:
    """A model's JSON verdict list, aligned by position: labels outside the whitelist are dropped."""
    item = F.concat(F.lit('{"i": 0, "label": "'), "event_type", F.lit('", "k": '), F.get_json_object("props", "$.k"), F.lit("}"))
    said = t["events"].select("event_id", F.concat(F.lit("["), item, F.lit("]")).alias("raw"))
    v = said.select("event_id", F.posexplode(F.from_json("raw", "array<struct<i: int, label: string, k: int>>")).alias("pos", "v")).where("pos = v.i AND v.label IN ('signup', 'purchase', 'click', 'error')")
    complete = F.when(F.col("v.k") % 2 == 0, 1.0).otherwise(0.5)
    return v.groupBy(F.col("v.label").alias("event_type")).agg(F.count("*").alias("verdicts"), F.round(F.avg(F.least(F.lit(1.0), complete * 0.85 + 0.15)), 6).alias("confidence"))


@query("F73", CLUSTER_SQL + """SELECT cluster_id, CASE WHEN state_count > diaspora_count THEN 1 WHEN state_count = diaspora_count THEN 3 ELSE 5 END AS spectrum, length(title) >= 60 AND NOT contains(title, '!!') AS two_sided,
 last_updated_at >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR AND article_count > 2 AS badge, coalesce(nullif(state_count * 100 // greatest(state_count + diaspora_count, 1), 0), 50)::BIGINT AS share FROM clusters""")
def card_rules(t: Tables) -> DataFrame:
    """What a card shows: spectrum column, two real narratives, fresh badge, share with fallback."""
    s, d = F.col("state_count"), F.col("diaspora_count")
    share = F.floor(s * 100 / F.greatest(s + d, F.lit(1))).cast("long")
    return scored(t).select(
        "cluster_id", F.when(s > d, 1).when(s == d, 3).otherwise(5).alias("spectrum"), ((F.length("title") >= 60) & ~F.col("title").contains("!!")).alias("two_sided"),
        ((F.col("last_updated_at") >= hours_before(F.lit(24))) & (F.col("article_count") > 2)).alias("badge"), F.coalesce(F.nullif(share, F.lit(0).cast("long")), F.lit(50)).alias("share"))


@query("L12 L15", CLUSTER_SQL + """
, blind AS (SELECT 'blind' AS slot, cluster_id FROM scored WHERE state_count = 0 OR diaspora_count = 0 ORDER BY trending DESC, cluster_id LIMIT 1)
, hero AS (SELECT 'hero', cluster_id FROM scored WHERE cluster_id NOT IN (SELECT cluster_id FROM blind) ORDER BY priority DESC, trending DESC, cluster_id LIMIT 1)
, battle AS (SELECT 'battle', cluster_id FROM scored WHERE cluster_id NOT IN (SELECT cluster_id FROM blind) AND cluster_id NOT IN (SELECT cluster_id FROM hero) AND state_count > 0 AND diaspora_count > 0 ORDER BY article_count DESC, cluster_id LIMIT 1)
SELECT * FROM blind UNION ALL SELECT * FROM hero UNION ALL SELECT * FROM battle""")
def homepage_slots(t: Tables) -> DataFrame:
    """Slots are filled in turn; a story stands in one slot at most."""
    s = scored(t)
    pick = lambda df, name, *order: df.orderBy(*order, "cluster_id").limit(1).select(F.lit(name).alias("slot"), "cluster_id")
    blind = pick(s.where("state_count = 0 OR diaspora_count = 0"), "blind", F.desc("trending"))
    hero = pick(s.join(blind, "cluster_id", "left_anti"), "hero", F.desc("priority"), F.desc("trending"))
    rest = s.where("state_count > 0 AND diaspora_count > 0").join(blind.union(hero), "cluster_id", "left_anti")
    return blind.union(hero).union(pick(rest, "battle", F.desc("article_count")))


@query("M13 L16", GROUP_SQL + """
, w AS (SELECT story_id, side, unnest(string_split(lower(title), ' ')) AS w FROM v_articles JOIN sided USING (source_id) WHERE story_id IS NOT NULL)
SELECT story_id, side, min_by(w, (length(w), w)) AS word, count(DISTINCT w) AS words FROM w WHERE length(w) >= 4 GROUP BY ALL""")
def loaded_words(t: Tables) -> DataFrame:
    """The shortest word of four letters or more per story and side."""
    a = t.articles.where("story_id IS NOT NULL").select("story_id", "source_id", F.explode(F.split(F.lower("title"), " ")).alias("w")).where(F.length("w") >= 4)
    j = a.join(grouped_sources(t).select("source_id", "side"), "source_id")
    return j.groupBy("story_id", "side").agg(F.min_by("w", F.struct(F.length("w"), "w")).alias("word"), F.countDistinct("w").alias("words"))


def against_stories(t: Tables) -> DataFrame:
    """Arrivals with their cosine to every stored story's centroid."""
    rows = vectors(t).where("arrived").select("article_id", F.col("story_id").alias("label"), "embedding")
    parts = similarity.scored_blocks(rows, "embedding", story_centroids(t, "NOT arrived"), "story_id", "centroid")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("M1 P31 J15", STORED_SQL + f"""
, pr AS (SELECT article_id, c.story_id, {COSINE.format('embedding', 'centroid')} AS s, article_id % 10 AS age FROM vec CROSS JOIN cent c WHERE arrived)
SELECT decision, count(*) AS n FROM (SELECT CASE WHEN (article_id + story_id) % 11 = 0 THEN 'negative_pair' WHEN s < 0 OR age > 7 THEN 'auto_reject' WHEN s >= 0.25 AND age <= 2 THEN 'auto_match' WHEN s >= CASE WHEN age >= 5 THEN 0.2 WHEN age > 2 THEN 0.15 ELSE 0.1 END THEN 'candidate' ELSE 'below_tier' END AS decision FROM pr) GROUP BY decision""")
def match_decisions(t: Tables) -> DataFrame:
    """The matcher's gates in order, over orphans and the (few) stories; thresholds for the test vectors."""
    pr = against_stories(t).select("article_id", "story_id", F.col("score").alias("s"), (F.col("article_id") % 10).alias("age"))
    tier = F.when(F.col("age") >= 5, 0.2).when(F.col("age") > 2, 0.15).otherwise(0.1)
    decision = F.when((F.col("article_id") + F.col("story_id")) % 11 == 0, "negative_pair").when((F.col("s") < 0) | (F.col("age") > 7), "auto_reject").when((F.col("s") >= 0.25) & (F.col("age") <= 2), "auto_match").when(F.col("s") >= tier, "candidate").otherwise("below_tier")
    return pr.groupBy(decision.alias("decision")).agg(F.count("*").alias("n"))


@query("M20", STORED_SQL + f"""
, sc AS (SELECT article_id, vec.story_id AS label, c.story_id, {COSINE.format('embedding', 'centroid')} AS s FROM vec CROSS JOIN cent c WHERE arrived)
, b AS (SELECT article_id, max(s) FILTER (story_id = label) AS own, max(s) AS best, max_by(story_id, (s, -story_id)) AS to_story FROM sc GROUP BY article_id)
SELECT article_id, to_story FROM b WHERE best - own >= 0.08 AND best >= 0.15""")
def reassignments(t: Tables) -> DataFrame:
    """Rows that fit another story better by .08 or more (and .15 at least)."""
    sc = against_stories(t).withColumnRenamed("score", "s")
    b = sc.groupBy("article_id").agg(F.max(F.when(F.col("story_id") == F.col("label"), F.col("s"))).alias("own"), F.max("s").alias("best"), F.max_by("story_id", F.struct("s", -F.col("story_id"))).alias("to_story"))
    return b.where("best - own >= 0.08 AND best >= 0.15").select("article_id", "to_story")


@query("X1", """
, n AS (SELECT vec_id, label, list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda y: y * y)))) AS u FROM embeddings)
, s AS (SELECT label, list(x ORDER BY p) AS t FROM (SELECT label, p, sum(x) AS x FROM (SELECT label, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM n) GROUP BY ALL) GROUP BY label)
SELECT label AS story_id, max_by(vec_id, (round(list_dot_product(u, t), 9), -vec_id)) AS medoid, count(*) AS members FROM n JOIN s USING (label) GROUP BY label""")
def medoids(t: Tables) -> DataFrame:
    """The member with the greatest summed cosine per story, from the sum of unit vectors (no pairs)."""
    u = t["embeddings"].select(F.col("vec_id").alias("article_id"), F.col("label").alias("story_id"), "embedding").select("article_id", "story_id", vector.unit(F.col("embedding")).alias("u"))
    total = u.select("story_id", F.posexplode("u").alias("p", "x")).groupBy("story_id", "p").agg(F.sum("x").alias("x")).groupBy("story_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias("t"))
    d = u.join(total, "story_id").select("story_id", "article_id", vector.dot(F.col("u"), F.col("t")).alias("d"))
    return d.groupBy("story_id").agg(F.max_by("article_id", F.struct(F.round("d", 9), -F.col("article_id"))).alias("medoid"), F.count("*").alias("members"))


@query("X2", f"""
, k AS (SELECT vec_id, label, embedding FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS k FROM embeddings) WHERE k <= 4)
SELECT a.label AS story_id, round(min({COSINE.format('a.embedding', 'b.embedding')}), 6) AS least FROM k a JOIN k b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def coherence(t: Tables) -> DataFrame:
    """Least cosine among the four newest members of a story."""
    k = t["embeddings"].select(F.col("vec_id").alias("article_id"), F.col("label").alias("story_id"), "embedding").withColumn("k", F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("article_id")))).where("k <= 4")
    pairs = k.alias("a").join(k.alias("b"), "story_id").where("a.article_id < b.article_id")
    return pairs.groupBy("story_id").agg(F.round(F.min(vector.cosine(F.col("a.embedding"), F.col("b.embedding"))), 6).alias("least"))


@query("M27 X14", """
, item AS (SELECT user_id AS item, event_id // 8 AS article_id FROM events WHERE event_type = 'signup')
SELECT item, count(DISTINCT article_id) AS evidence, count(DISTINCT source_id) AS outlets FROM item JOIN v_articles USING (article_id) GROUP BY item HAVING count(DISTINCT article_id) >= 3 AND count(DISTINCT source_id) >= 2""")
def grounding_floor(t: Tables) -> DataFrame:
    """Claims that keep three cited articles that exist, of two outlets."""
    cited = t["events"].where("event_type = 'signup'").select(F.col("user_id").alias("item"), F.floor(F.col("event_id") / 8).alias("article_id")).distinct()
    e = cited.join(t.articles.select("article_id", "source_id"), "article_id")
    return e.groupBy("item").agg(F.countDistinct("article_id").alias("evidence"), F.countDistinct("source_id").alias("outlets")).where("evidence >= 3 AND outlets >= 2")


@query("M26", GROUP_SQL + """
SELECT narrative_group, date_trunc('week', ingested_at) AS week, count(*) AS articles, count(DISTINCT source_id) AS outlets, CASE WHEN count(*) >= 20 AND count(DISTINCT source_id) >= 2 THEN 'ok' ELSE 'insufficient' END AS status FROM v_articles JOIN sided USING (source_id) GROUP BY ALL""")
def digest_gates(t: Tables) -> DataFrame:
    """Weekly bundles with their gate: twenty articles of two outlets."""
    a = t.articles.select("source_id", F.date_trunc("week", "ingested_at").cast("timestamp_ntz").alias("week")).join(grouped_sources(t).select("source_id", "narrative_group"), "source_id")
    g = a.groupBy("narrative_group", "week").agg(F.count("*").alias("articles"), F.countDistinct("source_id").alias("outlets"))
    return g.withColumn("status", F.when((F.col("articles") >= 20) & (F.col("outlets") >= 2), "ok").otherwise("insufficient"))


@query("X6", "SELECT coalesce(story_id, -1) AS story_id, count(*) AS articles FROM (SELECT CASE WHEN article_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN NULL WHEN article_id % 50 = 7 THEN 99 ELSE story_id END AS story_id FROM v_articles WHERE story_id IS NOT NULL) GROUP BY 1")
def apply_assignments(t: Tables) -> DataFrame:
    """Detach and move lists applied to membership, and the counts after."""
    gone = t["labels"].where("toxic = 1").select(F.col("doc_id").alias("article_id"), F.lit(True).alias("gone")).distinct()
    a = t.articles.where("story_id IS NOT NULL").select("article_id", "story_id").join(gone, "article_id", "left")
    new = F.when(F.col("gone"), None).when(F.col("article_id") % 50 == 7, 99).otherwise(F.col("story_id"))
    return a.groupBy(F.coalesce(new, F.lit(-1)).alias("story_id")).agg(F.count("*").alias("articles"))


@query("F15", CLUSTER_SQL + """
, top AS (SELECT cluster_id, list_distinct(list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) AS w FROM scored ORDER BY trending DESC, cluster_id LIMIT 80)
SELECT a.cluster_id AS a, b.cluster_id AS b FROM top a JOIN top b ON a.cluster_id < b.cluster_id WHERE len(a.w) > 0 AND len(b.w) > 0 AND len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::DOUBLE >= 0.4""")
def merge_candidates(t: Tables) -> DataFrame:
    """Among the eighty most visible stories, pairs whose titles overlap."""
    top = scored(t).orderBy(F.desc("trending"), "cluster_id").limit(80).select(F.col("cluster_id").alias("a"), text.tokens(F.col("title")).alias("wa"))
    pairs = top.join(F.broadcast(top.select(F.col("a").alias("b"), F.col("wa").alias("wb"))), F.col("a") < F.col("b"))
    return pairs.where(text.overlap(F.col("wa"), F.col("wb")) >= 0.4).select("a", "b")


@query("P34", """SELECT locale, count(*) AS stale FROM (SELECT unnest(['en', 'fr']) AS locale, cluster_id, last_updated_at FROM (SELECT cluster_no AS cluster_id, max(ingested_at) AS last_updated_at FROM v_articles GROUP BY 1)) WHERE cluster_id % 3 = 0 OR (CASE locale WHEN 'en' THEN TIMESTAMP '2024-01-30 12:00:00' ELSE TIMESTAMP '2024-01-29' END) <= last_updated_at GROUP BY locale""")
def stale_translations(t: Tables) -> DataFrame:
    """Translations that are missing or older than the story."""
    a = t.articles.groupBy(F.col("cluster_no").alias("cluster_id")).agg(F.max("ingested_at").alias("updated"))
    stored = F.when(F.col("cluster_id") % 3 != 0, F.lit('{"en": {"translated_at": "2024-01-30 12:00:00"}, "fr": {"translated_at": "2024-01-29 00:00:00"}}'))
    parsed = F.from_json(stored, "map<string, struct<translated_at: timestamp_ntz>>")
    x = a.select("updated", parsed.alias("m"), F.explode(F.array(F.lit("en"), F.lit("fr"))).alias("locale"))
    at = F.col("m")[F.col("locale")]["translated_at"]
    return x.where(at.isNull() | (at <= F.col("updated"))).groupBy("locale").agg(F.count("*").alias("stale"))


@query("F70 P18", """
, w AS (SELECT article_id, list_distinct(list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) AS t, list_distinct(list_filter(string_split_regex(lower(substr(body, 1, 1000)), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) AS b FROM v_articles)
SELECT article_id, len(t) = 0 OR len(list_filter(list_intersect(t, b), lambda x: x NOT IN ('the', 'and'))) > 0 AS matches, len(list_intersect(t, b)) >= 4 AND len(list_intersect(t, b)) >= 0.6 * len(t) AS strong FROM w""")
def extraction_guard(t: Tables) -> DataFrame:
    """Whether a page's text belongs to its title: shared tokens beyond the common ones."""
    w = t.articles.select("article_id", text.tokens(F.col("title")).alias("t"), text.tokens(F.substring("body", 1, 1000)).alias("b"))
    both = F.array_intersect("t", "b")
    return w.select("article_id", ((F.size("t") == 0) | (F.size(F.array_except(both, F.array(F.lit("the"), F.lit("and")))) > 0)).alias("matches"), ((F.size(both) >= 4) & (F.size(both) >= 0.6 * F.size("t"))).alias("strong"))
