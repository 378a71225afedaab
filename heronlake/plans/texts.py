"""Text, URL and markup queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.functions import text
from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables

#: Regular expressions for URL parts, for the oracle.
URL = r"'^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$'"
PARTS = f", u AS (SELECT page_id, url, regexp_extract(url, {URL}, 1) AS scheme, lower(regexp_extract(url, {URL}, 2)) AS host, regexp_replace(regexp_extract(url, {URL}, 3), '/+$', '') AS path, list_filter(string_split(regexp_extract(url, {URL}, 4), '&'), lambda p: contains(p, '=') AND NOT ends_with(p, '=') AND lower(string_split(p, '=')[1]) NOT IN ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'mc_cid', 'mc_eid', 'ref', 'ref_src', 'yclid')) AS kept FROM pages)\n"


@query("F18 P8", PARTS + "SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical FROM u")
def url_canonical(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", text.canonical_url(F.col("url")).alias("canonical"))


@query("F19 F22", PARTS + "SELECT regexp_replace(host, '^www\\.|:\\d+$', '', 'g') AS domain, count(*) AS pages, count(DISTINCT lower(regexp_replace(host, '^www\\.|:\\d+$', '', 'g') || path)) AS keys FROM u GROUP BY 1")
def url_domains(t: Tables) -> DataFrame:
    p = t["pages"].select(text.domain(F.col("url")).alias("domain"), text.url_key(F.col("url")).alias("k"))
    return p.groupBy("domain").agg(F.count("*").alias("pages"), F.countDistinct("k").alias("keys"))


@query("J22 S15", PARTS + """
, known AS (SELECT DISTINCT regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS parent FROM u WHERE page_id % 3 = 0)
SELECT page_id, parent FROM (SELECT page_id, regexp_extract(host, '([^.]+\\.[^.]+)$', 1) AS p FROM u) JOIN known ON parent = p""")
def domain_suffix_match(t: Tables) -> DataFrame:
    """Pages whose parent domain is known: the small domain list is joined by equality."""
    p = t["pages"].select("page_id", F.regexp_extract(F.lower(text.url_part(F.col("url"), "host")), r"([^.]+\.[^.]+)\z", 1).alias("parent"))
    return p.join(p.where("page_id % 3 = 0").select("parent").distinct(), "parent").select("page_id", "parent")


@query("S2 T9 J9", PARTS + """
, k AS (SELECT page_id, host || path AS key FROM u)
SELECT min(page_id) AS page_id, key FROM k WHERE page_id % 2 = 1 AND key NOT IN (SELECT key FROM k WHERE page_id % 2 = 0) GROUP BY key""")
def ingest_new_urls(t: Tables) -> DataFrame:
    """Insert-if-absent: new urls that aren't stored yet, the first of each."""
    k = t["pages"].select("page_id", F.concat(F.lower(text.url_part(F.col("url"), "host")), F.regexp_replace(text.url_part(F.col("url"), "path"), r"/+\z", "")).alias("key"))
    new = k.where("page_id % 2 = 1").join(k.where("page_id % 2 = 0").select("key").distinct(), "key", "left_anti")
    return new.groupBy("key").agg(F.min("page_id").alias("page_id")).select("page_id", "key")


@query("S8", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS headline, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<a href=\"[^\"]*\"')) AS links FROM pages")
def page_metadata(t: Tables) -> DataFrame:
    get = lambda p: F.regexp_extract("html", p, 1)
    return t["pages"].select("page_id", get("<title>([^<]*)</title>").alias("title"), get("<h1>([^<]*)</h1>").alias("headline"), get('<html lang="([a-z]+)"').alias("lang"), F.regexp_count("html", F.lit('<a href="[^"]*"')).alias("links"))


@query("S4", "SELECT page_id, regexp_extract(l, 'href=\"([^\"]*)\"', 1) AS href, min(pos) AS pos FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]{6,}</a>')) AS l, generate_subscripts(regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]{6,}</a>'), 1) - 1 AS pos FROM pages) GROUP BY ALL")
def scraped_links(t: Tables) -> DataFrame:
    """Links with a title of some length, the first of each address."""
    links = F.regexp_extract_all("html", F.lit('(<a href="[^"]*">[^<]{6,}</a>)'), F.lit(1))
    x = t["pages"].select("page_id", F.posexplode(links).alias("pos", "l"))
    return x.groupBy("page_id", F.regexp_extract("l", 'href="([^"]*)"', 1).alias("href")).agg(F.min("pos").alias("pos"))


@query("F9 F10 F11 F14 F15", """
, w AS (SELECT article_id, list_distinct(list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 3)) AS w FROM v_articles)
, p AS (SELECT a.article_id, a.w AS a, b.w AS b FROM w a JOIN w b ON b.article_id = a.article_id + 1)
SELECT article_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b)))::DOUBLE, 6) END AS jaccard, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a, b)) / least(len(a), len(b))::DOUBLE, 6) END AS overlap FROM p""")
def title_similarity(t: Tables) -> DataFrame:
    """Token Jaccard and overlap of each article's title with the next one's."""
    w = t.articles.select("article_id", text.tokens(F.col("title")).alias("a"))
    p = w.join(w.select((F.col("article_id") - 1).alias("article_id"), F.col("a").alias("b")), "article_id")
    return p.select("article_id", F.round(text.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(text.overlap(F.col("a"), F.col("b")), 6).alias("overlap"))


LEXICON = {"north": ("the", "and"), "south": ("que", "ción"), "west": ("eau", "ment"), "east": ("ung", "keit")}


@query("F16", """
, g AS (SELECT article_id, list_filter(['east', 'north', 'south', 'west'], lambda t: CASE t WHEN 'north' THEN contains(lower(title), 'the') OR contains(lower(title), 'and') WHEN 'south' THEN contains(lower(title), 'que') OR contains(lower(title), 'ción') WHEN 'west' THEN contains(lower(title), 'eau') OR contains(lower(title), 'ment') ELSE contains(lower(title), 'ung') OR contains(lower(title), 'keit') END) AS tags FROM v_articles)
SELECT a.article_id, array_to_string(a.tags, ',') AS tags, len(a.tags) > 0 AND len(b.tags) > 0 AND len(list_intersect(a.tags, b.tags)) = 0 AS conflict FROM g a JOIN g b ON b.article_id = a.article_id + 1""")
def theatre_conflict(t: Tables) -> DataFrame:
    """Places named in a title, and whether the next title's contradict them."""
    g = t.articles.select("article_id", text.theatres(F.col("title"), LEXICON).alias("a"))
    p = g.join(g.select((F.col("article_id") - 1).alias("article_id"), F.col("a").alias("b")), "article_id")
    return p.select("article_id", F.array_join("a", ",").alias("tags"), text.conflict(F.col("a"), F.col("b")).alias("conflict"))


@query("F54 A49", "SELECT source_id, sum(len(regexp_extract_all(lower(body), '[^\\p{L}](the|und|que|la)[^\\p{L}]'))) ::BIGINT AS hits, sum(len(regexp_extract_all(body, '!!'))) ::BIGINT AS marks, sum(len(string_split(body, ' ')))::BIGINT AS words FROM v_articles GROUP BY source_id")
def evidence_counts(t: Tables) -> DataFrame:
    """Lexicon hits, marks and words per outlet."""
    return t.articles.groupBy("source_id").agg(F.sum(F.regexp_count(F.lower("body"), F.lit(r"[^\p{L}](the|und|que|la)[^\p{L}]"))).alias("hits"), F.sum(F.regexp_count("body", F.lit("!!"))).alias("marks"), F.sum(F.size(F.split("body", " "))).alias("words"))


@query("F43 F44 F75", """SELECT story_id, substr(md5(CAST(sum(('0x' || substr(md5(CAST(article_id AS VARCHAR)), 1, 12))::BIGINT) AS VARCHAR) || ':' || count(*)), 1, 12) AS set_hash, substr(sha1(min(title)), 1, 10) AS title_hash FROM v_articles WHERE story_id IS NOT NULL GROUP BY story_id""")
def article_set_hash(t: Tables) -> DataFrame:
    """A short hash of each story's set of articles, from a sum over them."""
    whole = F.concat(text.set_sum(F.col("article_id")).cast("string"), F.lit(":"), F.count("*"))
    return t.articles.where("story_id IS NOT NULL").groupBy("story_id").agg(text.short_hash(F.min("title"), 10).alias("title_hash"), F.substring(F.md5(whole.cast("binary")), 1, 12).alias("set_hash"))


@query("P12", r"SELECT message_id, count(*) AS posts, count(*) FILTER (len(string_split_regex(trim(text), '[ \t\n\r]+')) >= 12 AND length(text) >= 60) AS kept, count(*) FILTER (len(list_filter(string_split(text, chr(10)), lambda x: x <> '')) > 1 AND length(text) >= 120 OR length(text) >= 200) AS discussion FROM v_posts GROUP BY message_id")
def post_predicates(t: Tables) -> DataFrame:
    """Posts that aren't noise, and those long enough to be a discussion (test sizes for noise)."""
    long = F.length("text")
    lines = F.size(F.filter(F.split("text", "\n"), lambda x: x != ""))
    return t.posts.groupBy("message_id").agg(F.count("*").alias("posts"), F.count_if((F.size(F.split(F.trim("text"), "[ \t\n\r]+")) >= 12) & (long >= 60)).alias("kept"), F.count_if(((lines > 1) & (long >= 120)) | (long >= 200)).alias("discussion"))


@query("P21", """SELECT article_id, round(least(1.0::DOUBLE, (CASE WHEN lower(title) LIKE '%the%' THEN 1 ELSE 0 END + CASE WHEN lower(title) LIKE '%ing%' THEN 1 ELSE 0 END + CASE WHEN lower(title) LIKE '%ter%' THEN 1 ELSE 0 END) / 3.0::DOUBLE), 6) AS confidence FROM v_articles WHERE lower(title) LIKE '%the%' OR lower(title) LIKE '%ing%' OR lower(title) LIKE '%ter%'""")
def topic_match(t: Tables) -> DataFrame:
    """Titles that hold any word of a topic, with the share that they hold."""
    hits = sum(F.when(F.col("title").ilike(f"%{w}%"), 1).otherwise(0) for w in ("the", "ing", "ter"))
    return t.articles.select("article_id", hits.alias("h")).where("h > 0").select("article_id", F.round(F.least(F.lit(1.0), F.col("h") / 3.0), 6).alias("confidence"))


@query("F46", """SELECT event_type, count(*) AS n, count(TRY_CAST(json_extract_string(props, '$.k') AS INT)) AS parsed, sum(least(50, greatest(10, TRY_CAST(json_extract_string(props, '$.k') AS INT))))::BIGINT AS clamped FROM events GROUP BY event_type""")
def json_scores(t: Tables) -> DataFrame:
    """Tolerant JSON parse and clamp to 10 to 50."""
    k = F.from_json("props", "k int", {"mode": "PERMISSIVE"})["k"]
    return t["events"].groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("parsed"), F.sum(F.when(k.isNotNull(), F.greatest(F.lit(10), F.least(F.lit(50), k)))).alias("clamped"))


@query("F25", r"""
, l AS (SELECT channel_id, message_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] AS line, text FROM v_posts)
, c AS (SELECT *, substr(line, 1, 100) AS head, length(substr(line, 1, 100)) - strpos(reverse(substr(line, 1, 100)), ' ') AS cut_at FROM l)
SELECT channel_id, message_id, CASE WHEN length(line) <= 100 THEN line WHEN contains(head, ' ') AND cut_at > 50 THEN substr(head, 1, cut_at) || '…' ELSE head || '…' END AS title, len(list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda x: regexp_replace(x, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')), lambda x: length(x) >= 15)) AS sentences FROM c""")
def post_titles(t: Tables) -> DataFrame:
    """A post's first line as its title, and its number of sentences."""
    return t.posts.select("channel_id", "message_id", text.first_line(F.col("text")).alias("title"), F.size(text.sentences(F.col("text"))).alias("sentences"))


@query("F34 F31", """SELECT channel_id, message_id, CASE WHEN sentiment <= -0.6 THEN 'strong_left' WHEN sentiment <= -0.2 THEN 'left' WHEN sentiment < 0.2 THEN 'center' WHEN sentiment < 0.6 THEN 'right' ELSE 'strong_right' END AS label,
 CASE WHEN h = 0 THEN 'now' WHEN h < 24 THEN h || ' h' WHEN h < 168 THEN (h // 24) || ' d' ELSE strftime(date, '%Y-%m-%d') END AS age FROM (SELECT *, date_diff('hour', date, TIMESTAMP '2024-01-31') AS h FROM v_posts WHERE sentiment IS NOT NULL)""")
def post_labels(t: Tables) -> DataFrame:
    from heronlake.functions import scores
    from heronlake.sources.adapters import now

    return t.posts.where("sentiment IS NOT NULL").select("channel_id", "message_id", scores.alignment_label(F.col("sentiment")).alias("label"), text.relative_time(F.col("date"), now()).alias("age"))
