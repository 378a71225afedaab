"""New articles and posts against the stories there are.

Stories here are runs of twelve consecutive stored articles with vectors, so they grow with the
data.  Thresholds suit the provided vectors, which have no structure; the product's are the
defaults of :mod:`heronlake.operators.matching`.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.functions import text, vector
from heronlake.operators import matching
from heronlake.plans.feedback import TRUST_SQL, source_trust
from heronlake.plans.registry import query
from heronlake.plans.similarity import COSINE
from heronlake.plans.texts import LEXICON
from heronlake.sources.adapters import Tables, hours_before, now
from heronlake.sources.storage import store

LENGTH, PINNED, MOST = 12, 40, 30


def signals(title) -> list:
    return [text.tokens(title).alias("tokens"), text.quoted(title).alias("quotes"), text.numbers(title).alias("numbers"), text.theatres(title, LEXICON).alias("theatres")]


def signals_sql(title: str) -> str:
    tags = ", ".join(f"CASE WHEN {' OR '.join(f'''contains(lower({title}), '{w}')''' for w in words)} THEN '{tag}' END" for tag, words in sorted(LEXICON.items()))
    return f"""list_distinct(list_filter(string_split_regex(lower({title}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3)) AS tokens, list_distinct(regexp_extract_all({title}, '«([^«»]+)»', 1)) AS quotes,
  list_distinct(regexp_extract_all({title}, '[0-9۰-۹]{{2,}}')) AS numbers, list_filter([{tags}], lambda x: x IS NOT NULL) AS theatres"""


def jaccard_sql(a: str, b: str) -> str:
    return f"(CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0 ELSE len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) END)"


def conflict_sql(a: str, b: str) -> str:
    return f"(len({a}) > 0 AND len({b}) > 0 AND NOT list_has_any({a}, {b}))"


#: Arrivals came in within a day; stored articles with vectors make the stories.
ARRIVED_SQL = f"""
, arrival AS (SELECT article_id, source_id, embedding, {signals_sql('title')} FROM v_articles WHERE ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR)
"""
THREAD_SQL = f"""
, stored AS (SELECT article_id, article_id // {LENGTH} AS story_id, embedding, title, ingested_at, published_at, story_id AS label, url FROM v_articles WHERE embedding IS NOT NULL AND ingested_at < TIMESTAMP '2024-01-31' - INTERVAL 24 HOUR)
, newest AS (SELECT story_id, string_agg(title, ' ' ORDER BY published_at DESC NULLS LAST, article_id) AS titles FROM (SELECT *, row_number() OVER (PARTITION BY story_id ORDER BY published_at DESC NULLS LAST, article_id) AS k FROM stored) WHERE k <= 3 GROUP BY story_id)
, centre AS (SELECT story_id, list(x ORDER BY p) AS centroid FROM (SELECT story_id, p, avg(x) AS x FROM (SELECT story_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM stored) GROUP BY ALL) GROUP BY story_id)
, thread AS (SELECT story_id, min_by(title, article_id) || ' ' || any_value(titles) AS words, any_value(centroid) AS centroid, count(*) AS article_count, date_diff('second', max(ingested_at), TIMESTAMP '2024-01-31') / 86400.0::DOUBLE AS age,
   coalesce(min(published_at), max(ingested_at)) AS first_at, CASE WHEN count(*) FILTER (label = 0) >= 3 THEN 50 ELSE 0 END AS priority, count(*) FILTER (label = 9) >= 3 AS frozen FROM stored JOIN newest USING (story_id) JOIN centre USING (story_id) GROUP BY story_id)
"""


def arrivals(t: Tables) -> DataFrame:
    a = t.articles.where(F.col("ingested_at") >= hours_before(F.lit(24)))
    return a.select("article_id", "source_id", "embedding", *signals(F.col("title")))


def stored(t: Tables) -> DataFrame:
    a = t.articles.where(F.col("embedding").isNotNull() & (F.col("ingested_at") < hours_before(F.lit(24))))
    return a.select("article_id", F.floor(F.col("article_id") / LENGTH).alias("story_id"), F.col("story_id").alias("label"), "embedding", "title", "ingested_at", "published_at", "url")


def threads(t: Tables) -> DataFrame:
    """Stories with what the matcher asks of them; ``words`` is the first title with the three newest."""
    a = stored(t)
    seen = F.struct(F.col("published_at").isNull().alias("none"), (-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("at"), "article_id")
    age = F.timestamp_diff("SECOND", F.max("ingested_at"), now()) / 86400.0
    g = a.groupBy("story_id").agg(
        F.min_by("title", "article_id").alias("first"), F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct(seen.alias("seen"), "title"))), 1, 3), lambda x: x["title"]), " ").alias("newest"), F.count("*").alias("article_count"),
        age.alias("age"), F.coalesce(F.min("published_at"), F.max("ingested_at")).alias("first_at"), F.when(F.count_if(F.col("label") == 0) >= 3, 50).otherwise(0).alias("priority"), (F.count_if(F.col("label") == 9) >= 3).alias("frozen"),
    )
    return g.join(vector.centroids(a, "story_id", "embedding"), "story_id").withColumn("words", F.concat_ws(" ", "first", "newest")).drop("first", "newest")


TRIAL = (0.2, 0.1)
EMERGING_SQL = f"""
, solid AS (SELECT * FROM arrival WHERE embedding IS NOT NULL)
, near AS (SELECT a.article_id AS a, b.article_id AS b FROM solid a JOIN solid b ON a.article_id <> b.article_id WHERE {COSINE.format('a.embedding', 'b.embedding')} >= {TRIAL[0]} AND NOT {conflict_sql('a.theatres', 'b.theatres')})
, reach(a, b) AS (SELECT a, a FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b)
, part AS (SELECT a AS article_id, min(b) AS component FROM reach GROUP BY a), member AS (SELECT * FROM solid JOIN part USING (article_id))
, kept AS (SELECT DISTINCT x.component FROM member x JOIN member y ON x.component = y.component AND x.article_id < y.article_id WHERE {jaccard_sql('x.tokens', 'y.tokens')} >= {TRIAL[1]} OR list_has_any(x.quotes, y.quotes) OR list_has_any(x.numbers, y.numbers))
, reserved AS (SELECT article_id, component FROM member WHERE component IN (SELECT component FROM kept))
"""


@query("M2", ARRIVED_SQL + EMERGING_SQL + "SELECT article_id, component FROM reserved")
def emerging_groups(t: Tables) -> DataFrame:
    """Arrivals that form a story of their own, before any is matched to a story there is (test cosine .2, Jaccard .1)."""
    return matching.emerging(arrivals(t).where("embedding IS NOT NULL"), *TRIAL)


GATES = matching.Gates(reject=0.05, auto=0.2, auto_jaccard=0.1, small=0.12, small_jaccard=0.05, fresh=0.08, aged=0.12, near_freeze=0.15)


@cache
def gates_sql() -> str:
    g = GATES
    overlap = jaccard_sql("a.tokens", "b.tokens")
    concrete = "(list_has_any(a.quotes, b.quotes) OR list_has_any(a.numbers, b.numbers))"
    return ARRIVED_SQL + THREAD_SQL + EMERGING_SQL + TRUST_SQL + f"""
, trusted AS (SELECT s.source_id, CASE WHEN s.created_at >= TIMESTAMP '2024-01-31' - INTERVAL 14 DAY THEN least(coalesce(trust, 1.0), 0.85) ELSE coalesce(trust, 1.0) END AS trust FROM v_sources s LEFT JOIN
   (SELECT source_id, round_even(least(1.0::DOUBLE, CASE WHEN flagged = 0 THEN 0.9::DOUBLE + 0.05::DOUBLE WHEN flagged / total > 3 * greatest(median, 0.01::DOUBLE) THEN greatest(0.5::DOUBLE, 1 - 2 * (flagged / total - median)) ELSE 0.9::DOUBLE + 0.05::DOUBLE END), 3) AS trust FROM r CROSS JOIN m) USING (source_id))
, target AS (SELECT *, {signals_sql('words')} FROM thread WHERE article_count >= 3 AND (priority >= {PINNED} OR article_count < {MOST}) AND age <= 7 AND NOT frozen AND (priority >= {PINNED} OR first_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY))
, general AS (SELECT coalesce(list(token), []) AS generic FROM (SELECT token, count(*) AS df FROM (SELECT unnest(tokens) AS token FROM target) GROUP BY token) WHERE df >= {g.generic} * (SELECT count(*) FROM target))
, refused AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS article_id, event_id // {LENGTH} AS story_id FROM events WHERE event_type = 'error')
, pair AS (SELECT a.article_id, b.story_id, b.age, {COSINE.format('a.embedding', 'b.centroid')} AS score, 1 / greatest(trust, 0.5::DOUBLE) AS factor, {overlap} AS overlap, {concrete} AS concrete, b.article_count < {g.small_count} AS small,
   len(list_filter(list_intersect(a.tokens, b.tokens), lambda x: NOT list_contains(generic, x))) > 0 AS special, {conflict_sql('a.theatres', 'b.theatres')} AS conflict
   FROM arrival a JOIN trusted USING (source_id) CROSS JOIN target b CROSS JOIN general WHERE a.embedding IS NOT NULL AND a.article_id NOT IN (SELECT article_id FROM reserved) AND NOT EXISTS (SELECT 1 FROM refused f WHERE f.article_id = a.article_id AND f.story_id = b.story_id))
, verdict AS (SELECT article_id, story_id, age, CASE WHEN score < {g.reject} OR age > {g.reject_age} OR conflict THEN NULL WHEN score >= least({g.auto} * factor, 0.99) AND age <= {g.auto_age} AND (overlap >= {g.auto_jaccard} OR concrete) THEN 'auto'
   WHEN score >= least(CASE WHEN small THEN {g.small} WHEN age >= {g.near_freeze_age} THEN {g.near_freeze} WHEN age > {g.aged_age} THEN {g.aged} ELSE {g.fresh} END * factor, 0.95) AND ((CASE WHEN small THEN overlap >= {g.small_jaccard} ELSE special END) OR concrete) THEN 'candidate' END AS v FROM pair)
, found AS (SELECT article_id, min_by(story_id, (age, story_id)) FILTER (v = 'auto') AS auto, array_to_string(list(story_id ORDER BY age, story_id) FILTER (v = 'candidate'), ',') AS candidates FROM verdict WHERE v IS NOT NULL GROUP BY article_id)
, decided AS (SELECT a.article_id, CASE WHEN a.article_id IN (SELECT article_id FROM reserved) THEN 'reserved' WHEN embedding IS NULL THEN 'no vector' WHEN auto IS NOT NULL THEN 'auto' WHEN candidates IS NOT NULL THEN 'candidates' ELSE 'new' END AS decision, auto AS story_id, candidates FROM arrival a LEFT JOIN found f ON f.article_id = a.article_id)
SELECT article_id, decision, story_id, CASE WHEN decision = 'candidates' THEN candidates ELSE '' END AS candidates FROM decided"""


@query("M1 P31 J15 J11", gates_sql())
def matched_stories(t: Tables) -> DataFrame:
    """Each arrival with what the matcher decides: reserved for an emerging group, matched to the youngest story
    that passes all gates, left to confirm with candidates, or new."""
    rows = arrivals(t)
    trust = t.sources.select("source_id", "created_at").join(source_trust(t).select("source_id", "trust"), "source_id", "left")
    plain = F.coalesce("trust", F.lit(1.0))
    trust = trust.select("source_id", F.when(F.col("created_at") >= hours_before(F.lit(14 * 24)), F.least(plain, F.lit(0.85))).otherwise(plain).alias("trust"))
    pinned = F.col("priority") >= PINNED
    open_ = threads(t).where((F.col("article_count") >= 3) & (pinned | (F.col("article_count") < MOST)) & (F.col("age") <= 7) & ~F.col("frozen") & (pinned | (F.col("first_at") >= hours_before(F.lit(168)))))
    targets = open_.select("story_id", "centroid", "age", "article_count", *signals(F.col("words")))
    refused = t["events"].where("event_type = 'error'").select(F.col("user_id").cast("long").alias("article_id"), F.floor(F.col("event_id") / LENGTH).alias("story_id")).distinct()
    reserved = matching.emerging(rows.where("embedding IS NOT NULL"), *TRIAL)
    found = matching.matched(rows.join(trust, "source_id"), targets, refused, reserved, GATES)
    return found.select("article_id", "decision", "story_id", F.array_join("candidates", ",").alias("candidates"))


#: Posts have the vector of their number; the first of each channel cites an article.
POST_SQL = THREAD_SQL + r"""
, post AS (SELECT channel_id * 1048576 + message_id AS post, channel_id, message_id, date, text || CASE WHEN message_id = 0 THEN ' see (' || url || CASE WHEN channel_id % 2 = 0 THEN '?utm_source=tg' ELSE '' END || ').' ELSE '' END AS text, e.embedding AS vec
   FROM v_posts LEFT JOIN embeddings e ON e.vec_id = channel_id * 5 + message_id LEFT JOIN (SELECT article_id, url FROM v_articles) x ON x.article_id = channel_id * 3 WHERE date >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)
, live AS (SELECT * FROM thread WHERE article_count >= 3 AND age <= 7)
, fresh AS (SELECT story_id, embedding AS vec, count(*) OVER (PARTITION BY story_id) AS n FROM stored WHERE ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY)
"""
LINK = {"threshold": 0.2, "aged": 0.05, "rescue": 0.3, "broad": 11}


def posts(t: Tables) -> DataFrame:
    """Posts of the last week: ``post`` (a number), channel, text and vector."""
    p = t.posts.where(F.col("date") >= hours_before(F.lit(168)))
    v = t["embeddings"].select(F.col("vec_id").cast("long").alias("n"), F.col("embedding").alias("vec"))
    cited = t.articles.where("article_id % 3 = 0").select((F.col("article_id") / 3).cast("long").alias("channel_id"), "url")
    p = p.join(v, F.col("channel_id") * 5 + F.col("message_id") == F.col("n"), "left").join(cited, "channel_id", "left")
    tail = F.concat(F.lit(" see ("), "url", F.when(F.col("channel_id") % 2 == 0, "?utm_source=tg").otherwise(""), F.lit(")."))
    said = F.concat("text", F.when(F.col("message_id") == 0, tail).otherwise(""))
    return p.select((F.col("channel_id") * 1048576 + F.col("message_id")).cast("long").alias("post"), "channel_id", "message_id", said.alias("text"), "vec")


SCORE_SQL = f"""
, asked AS (SELECT post, vec FROM post WHERE vec IS NOT NULL)
, centred AS (SELECT post, story_id, {COSINE.format('vec', 'centroid')} AS s, 1 AS centre FROM asked CROSS JOIN {{stories}})
, inner_ AS (SELECT post, f.story_id, {COSINE.format('p.vec', 'f.vec')} AS s, 0 AS centre FROM asked p CROSS JOIN {{members}} f WHERE f.story_id IN (SELECT story_id FROM {{stories}}))
, both_ AS (SELECT post, story_id, max((s, centre)) AS m FROM (SELECT * FROM centred UNION ALL SELECT * FROM inner_) GROUP BY ALL)
, scored_ AS (SELECT post, story_id, m[1] AS s, m[2] AS centre FROM both_)
"""


@query("M19 J20 J21", POST_SQL + SCORE_SQL.format(stories="live", members=f"(SELECT * FROM fresh WHERE n <= {LINK['broad']})") + f"""
, cite AS (SELECT post, unnest(l) AS u, generate_subscripts(l, 1) AS i FROM (SELECT post, list_transform(regexp_extract_all(text, 'https?://[^\\s<>"\\)]+'), lambda x: regexp_replace(x, '[.,;:!؟،؛]+$', '')) AS l FROM post))
, plain AS (SELECT post, i, u, lower(regexp_replace(regexp_extract(u, '^[a-z]+://([^?#]*)', 1), '/+$', '')) AS k FROM cite)
, hit AS (SELECT post, i, 0 AS how, story_id FROM plain JOIN stored ON url = u UNION ALL SELECT post, i, 1, story_id FROM plain JOIN stored ON k = lower(regexp_extract(url, '^[a-z]+://(.*)$', 1)))
, byurl AS (SELECT post, min_by(story_id, (i, how, story_id)) AS story_id FROM hit GROUP BY post)
, bv AS (SELECT post, max_by(story_id, (s, -story_id)) AS story_id, max_by(centre, (s, -story_id)) AS centre, max(s) AS s FROM scored_ WHERE s >= {LINK['threshold']} AND post NOT IN (SELECT post FROM byurl) GROUP BY post)
, ok AS (SELECT post, b.story_id, CASE WHEN centre = 1 THEN 'vector' ELSE 'rescue' END AS way, s FROM bv b JOIN live USING (story_id) WHERE s >= greatest({LINK['threshold']} + CASE WHEN age > 2 THEN {LINK['aged']} ELSE 0 END, CASE WHEN centre = 0 THEN {LINK['rescue']} ELSE 0 END))
SELECT p.channel_id, p.message_id, coalesce(u.story_id, ok.story_id) AS story_id, CASE WHEN u.story_id IS NOT NULL THEN 'url' ELSE coalesce(way, 'none') END AS way, CASE WHEN u.story_id IS NULL THEN round(s, 6) END AS score FROM post p LEFT JOIN byurl u USING (post) LEFT JOIN ok USING (post)""")
def linked_posts(t: Tables) -> DataFrame:
    """Posts and the story they belong to: by an address they cite, else by vector, by a single member only when that is near."""
    p, s, m = posts(t), threads(t).where("article_count >= 3 AND age <= 7"), stored(t)
    fresh = m.where(F.col("ingested_at") >= hours_before(F.lit(168))).select("story_id", F.col("embedding").alias("vec"))
    asked = p.select("post", "vec", text.cited_urls(F.col("text")).alias("urls"))
    found = matching.linked(asked, m.select("url", "story_id"), s.select("story_id", F.col("centroid").alias("vec"), "age"), fresh.select("story_id", F.col("vec").cast("array<double>").alias("vec")), **LINK)
    return found.select(F.floor(F.col("post") / 1048576).alias("channel_id"), (F.col("post") % 1048576).alias("message_id"), "story_id", "way", F.round("score", 6).alias("score"))


MOVE_SQL = POST_SQL + SCORE_SQL.format(stories="(SELECT * FROM thread WHERE article_count >= 3)", members="(SELECT story_id, embedding AS vec FROM stored)") + f"""
, home AS (SELECT post, (channel_id * 7 + message_id) // {LENGTH} AS story_id FROM post WHERE vec IS NOT NULL)
, top AS (SELECT post, max_by(story_id, (s, -story_id)) AS to_story, max(s) AS s FROM scored_ WHERE s >= 0.3 GROUP BY post)
, mv AS (SELECT post, h.story_id, to_story, t.s - greatest(coalesce(o.s, 0), 0) AS gain FROM home h JOIN top t USING (post) LEFT JOIN scored_ o ON o.post = h.post AND o.story_id = h.story_id WHERE to_story <> h.story_id)
"""


def post_moves(t: Tables) -> DataFrame:
    p = posts(t).where("vec IS NOT NULL").select("post", "vec", F.floor((F.col("channel_id") * 7 + F.col("message_id")) / LENGTH).alias("story_id"))
    s = threads(t).where("article_count >= 3").select("story_id", F.col("centroid").alias("vec"))
    m = stored(t).join(s.select("story_id"), "story_id", "left_semi").select("story_id", F.col("embedding").cast("array<double>").alias("vec"))
    return matching.reassigned(p, s, m, 0.08, 0.3)


@query("M20", MOVE_SQL + "SELECT post // 1048576 AS channel_id, post % 1048576 AS message_id, story_id, to_story, round(gain, 6) AS gain FROM mv WHERE gain >= 0.08")
def moved_posts(t: Tables) -> DataFrame:
    """Posts that fit another story better than their own, by its centroid or its best member."""
    return post_moves(t).select(F.floor(F.col("post") / 1048576).alias("channel_id"), (F.col("post") % 1048576).alias("message_id"), "story_id", "to_story", F.round("gain", 6).alias("gain"))


@query("M20", MOVE_SQL + "SELECT story_id, sum(d)::BIGINT AS change FROM (SELECT story_id, -1 AS d FROM mv WHERE gain >= 0.08 UNION ALL SELECT to_story, 1 FROM mv WHERE gain >= 0.08) GROUP BY story_id HAVING sum(d) <> 0")
def shifted_stories(t: Tables) -> DataFrame:
    """Stories whose number of posts changes with those moves, so that their cached analysis goes."""
    return matching.shifted(post_moves(t))


VOTE_SQL = THREAD_SQL + f"""
, rater AS (SELECT DISTINCT doc_id AS article_id FROM labels WHERE toxic = 1)
, anon AS (SELECT event_id // 20 AS article_id, count(DISTINCT coalesce(CASE WHEN value >= 20 THEN 'c' || user_id END, 'f' || user_id % 7)) AS voters FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(DISTINCT coalesce(CASE WHEN value >= 20 THEN 'c' || user_id END, 'f' || user_id % 7)) >= 3)
, orphan AS (SELECT article_id, s.story_id, embedding AS vec, CASE WHEN r.article_id IS NOT NULL THEN 'rater' ELSE 'readers' END AS voted FROM stored s LEFT JOIN rater r USING (article_id) LEFT JOIN anon a USING (article_id) WHERE r.article_id IS NOT NULL OR a.article_id IS NOT NULL)
, refused AS (SELECT article_id, story_id FROM orphan UNION SELECT doc_id, (doc_id + {LENGTH}) // {LENGTH} FROM labels WHERE toxic = 1)
, home AS (SELECT o.article_id, t.story_id, {COSINE.format('vec', 'centroid')} AS s FROM orphan o CROSS JOIN thread t WHERE article_count >= 2 AND NOT frozen AND NOT EXISTS (SELECT 1 FROM refused f WHERE f.article_id = o.article_id AND f.story_id = t.story_id))
, best AS (SELECT article_id, max_by(story_id, (s, -story_id)) AS to_story, max(s) AS s FROM home WHERE s >= 0.25 GROUP BY article_id)
SELECT article_id, o.story_id, voted, to_story, round(s, 6) AS score FROM orphan o LEFT JOIN best USING (article_id)"""


@query("M15 A27 J11", VOTE_SQL)
def voted_out(t: Tables) -> DataFrame:
    """Articles that a rater or three readers took out of their story, and the nearest story that nobody refused for them (test cosine .25)."""
    s, o = threads(t), stored(t)
    rater = t["labels"].where("toxic = 1").select(F.col("doc_id").alias("article_id")).distinct().withColumn("rater", F.lit(True))
    identity = F.coalesce(F.when(F.col("value") >= 20, F.concat(F.lit("c"), "user_id")), F.concat(F.lit("f"), F.col("user_id") % 7))
    anon = t["events"].where("event_type = 'error'").groupBy(F.floor(F.col("event_id") / 20).alias("article_id")).agg(F.countDistinct(identity).alias("voters")).where("voters >= 3")
    out = o.join(rater, "article_id", "left").join(anon, "article_id", "left").where("rater OR voters IS NOT NULL")
    out = out.select("article_id", "story_id", F.col("embedding").alias("vec"), F.when(F.col("rater"), "rater").otherwise("readers").alias("voted"))
    refused = out.select("article_id", "story_id").unionByName(t["labels"].where("toxic = 1").select(F.col("doc_id").alias("article_id"), F.floor((F.col("doc_id") + LENGTH) / LENGTH).alias("story_id")))
    home = matching.rehomed(out.select("article_id", "vec"), refused, s.where("article_count >= 2 AND NOT frozen").select("story_id", F.col("centroid").alias("vec")), 0.25)
    return out.select("article_id", "story_id", "voted").join(home.withColumnRenamed("story_id", "to_story"), "article_id").select("article_id", "story_id", "voted", "to_story", F.round("score", 6).alias("score"))


LABEL_SQL = """
, a AS (SELECT article_id, lower(trim(array_to_string(string_split(title, ' ')[1:2], ' '))) AS label, row_number() OVER (ORDER BY published_at DESC NULLS LAST, article_id) AS i FROM v_articles WHERE ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR)
, g AS (SELECT label, count(*) AS n, row_number() OVER (ORDER BY min(i)) AS place FROM a WHERE label <> '' GROUP BY label)
, st AS (SELECT lower(min_by(title, article_id)) AS title, 1 - row_number() OVER (ORDER BY cluster_no DESC) AS p0 FROM v_articles WHERE ingested_at < TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR AND ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 120 HOUR GROUP BY cluster_no)
, s AS (SELECT title, p0 - (SELECT 0) AS place FROM st WHERE title <> '')
, tx AS (SELECT place, title AS text, false AS grp, 2 AS n FROM s UNION ALL SELECT place, label, true, n FROM g)
, e AS (SELECT x.place AS a, y.place AS b FROM tx x JOIN tx y ON y.grp AND x.place < y.place AND (NOT x.grp OR x.n >= 2) WHERE contains(x.text, y.text) OR contains(y.text, x.text)
  OR len(list_intersect(list_filter(string_split_regex(x.text, '\\s+'), lambda w: w <> ''), list_filter(string_split_regex(y.text, '\\s+'), lambda w: w <> ''))) > 0.5 * least(len(list_distinct(list_filter(string_split_regex(x.text, '\\s+'), lambda w: w <> ''))), len(list_distinct(list_filter(string_split_regex(y.text, '\\s+'), lambda w: w <> '')))))
, near AS (SELECT b, list(a ORDER BY a) AS l FROM e GROUP BY b)
, go(i, made, into_) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT
  UNION ALL SELECT place, CASE WHEN hit IS NULL AND n >= 2 THEN list_append(made, place) ELSE made END, hit FROM (SELECT g.place, g.n, made, list_filter(coalesce(l, []), lambda x: x < 1 OR list_contains(made, x))[1] AS hit FROM go JOIN g ON g.place = go.i + 1 LEFT JOIN near ON b = g.place))
"""


@query("M38", LABEL_SQL + "SELECT label, CASE WHEN into_ IS NOT NULL THEN 'merged' WHEN g.n >= 2 THEN 'new' ELSE 'single' END AS fate, x.text AS \"into\" FROM go JOIN g ON g.place = go.i LEFT JOIN tx x ON x.place = into_")
def topic_labels(t: Tables) -> DataFrame:
    """Articles of three days grouped by equal labels (their titles' first two words), each group in turn joined to the first story that
    its label fits, the stories that earlier groups became included."""
    label = F.lower(F.trim(F.array_join(F.slice(F.split("title", " "), 1, 2), " ")))
    order = F.struct(F.col("published_at").isNull().alias("none"), (-F.unix_micros(F.col("published_at").cast("timestamp"))).alias("at"), "article_id")
    new = t.articles.where(F.col("ingested_at") >= hours_before(F.lit(72))).select(label.alias("label"), order.alias("o")).where("label <> ''")
    # numbers that only rise in the order, so that no task numbers all rows; stories' are negative
    place = F.monotonically_increasing_id()
    groups = new.groupBy("label").agg(F.count("*").alias("n"), F.min("o").alias("o")).orderBy("o")
    groups = store(groups.select("label", "n", place.alias("place")), "label-groups")
    old = t.articles.where((F.col("ingested_at") < hours_before(F.lit(72))) & (F.col("ingested_at") >= hours_before(F.lit(120))))
    stories = old.groupBy("cluster_no").agg(F.lower(F.min_by("title", "article_id")).alias("title"))
    stories = store(stories.where("title <> ''").orderBy(F.desc("cluster_no")).select("title", (-1 - place).alias("place")), "label-old")
    return matching.merged_labels(groups, stories)


OWN_SQL = THREAD_SQL + f"""
, own AS (SELECT s.article_id, s.story_id, ingested_at, {COSINE.format('embedding', 'centroid')} AS score FROM stored s JOIN thread t USING (story_id) WHERE article_count >= 5)
"""


def own_scores(t: Tables) -> DataFrame:
    """Each article's cosine to its own story's centroid, in stories of five or more."""
    s = threads(t).where("article_count >= 5").select("story_id", "centroid")
    return stored(t).join(s, "story_id").select("article_id", "story_id", "ingested_at", vector.cosine(F.col("embedding").cast("array<double>"), F.col("centroid")).alias("score"))


@query("M16", OWN_SQL + "SELECT article_id, story_id, round(score, 6) AS score FROM own WHERE score < 0.25 AND ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY ORDER BY story_id, article_id LIMIT 50")
def detached_articles(t: Tables) -> DataFrame:
    """The week's articles below .25 to their own story, which leave it: fifty a run, story by story."""
    week = own_scores(t).where((F.col("score") < 0.25) & (F.col("ingested_at") >= hours_before(F.lit(168))))
    return week.orderBy("story_id", "article_id").limit(50).select("article_id", "story_id", F.round("score", 6).alias("score"))


@query("M33", OWN_SQL + "SELECT article_id, story_id, round(score, 6) AS score FROM own WHERE score < 0.2")
def unrelated_report(t: Tables) -> DataFrame:
    """All articles below .20 to their own story."""
    return own_scores(t).where("score < 0.2").select("article_id", "story_id", F.round("score", 6).alias("score"))
