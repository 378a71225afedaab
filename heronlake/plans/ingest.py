"""Ingest, conversion, export: what enters, what is appended, what leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.functions import scores
from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables, now
from heronlake.sources.storage import new_path


@query("S11 S12 S13", "SELECT channel_id, count(*) AS fresh, max(message_id) AS high_water FROM v_posts WHERE message_id > channel_id % 3 GROUP BY channel_id")
def channel_ingest(t: Tables) -> DataFrame:
    """Posts beyond each channel's mark, each once, and the new marks."""
    p = t.posts.where(F.col("message_id") > F.col("channel_id") % 3).dropDuplicates(["channel_id", "message_id"])
    return p.groupBy("channel_id").agg(F.count("*").alias("fresh"), F.max("message_id").alias("high_water"))


@query("S14", "SELECT 't.me/' || channel_id || '/' || message_id AS url, substr(text, 1, 100) AS title FROM v_posts WHERE length(text) >= 50 AND role = 'assistant' AND channel_id % 4 <> 0 AND (channel_id, message_id) NOT IN (SELECT channel_id, message_id FROM v_posts WHERE message_id % 2 = 0)")
def post_conversion(t: Tables) -> DataFrame:
    """Posts that become articles: long enough, of mapped channels, not converted yet."""
    done = t.posts.where("message_id % 2 = 0").select("channel_id", "message_id")
    p = t.posts.where((F.length("text") >= 50) & (F.col("role") == "assistant") & (F.col("channel_id") % 4 != 0)).join(done, ["channel_id", "message_id"], "left_anti")
    return p.select(F.concat(F.lit("t.me/"), "channel_id", F.lit("/"), "message_id").alias("url"), F.substring("text", 1, 100).alias("title"))


@query("S16", "SELECT url, max_by(story_id, (ingested_at, article_id)) AS story_id FROM v_articles WHERE story_id IS NOT NULL GROUP BY url")
def url_story_map(t: Tables) -> DataFrame:
    """Story by url; the last article wins."""
    return t.articles.where("story_id IS NOT NULL").groupBy("url").agg(F.max_by("story_id", F.struct("ingested_at", "article_id")).alias("story_id"))


SEED = '{"src1": {"reach": 3}, "src5": {"reach": 5}, "src77": {"reach": 2}, "src78": {"reach": null}}'


@query("S17 S18 S19", """
, seed AS (SELECT * FROM (VALUES ('src1', 3), ('src5', 5), ('src77', 2), ('src78', NULL)) v(source_id, reach))
SELECT source_id, reach, 'update' AS action FROM seed JOIN v_sources USING (source_id) UNION ALL SELECT source_id, reach, 'insert' FROM seed WHERE source_id NOT IN (SELECT source_id FROM v_sources)""")
def seed_sources(t: Tables) -> DataFrame:
    """A JSON seed keyed by slug: rows to update and rows to insert."""
    seed = t.spark.range(1).select(F.explode(F.from_json(F.lit(SEED), "map<string, struct<reach: int>>")).alias("source_id", "v")).select("source_id", F.col("v.reach").alias("reach"))
    have = t.sources.select("source_id")
    return seed.join(have, "source_id", "left_semi").withColumn("action", F.lit("update")).unionByName(seed.join(have, "source_id", "left_anti").withColumn("action", F.lit("insert")))


@query("S24 S25 S26", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date, event_type, count(*) AS n, max(length(props)) AS longest FROM events GROUP BY ALL")
def event_log(t: Tables) -> DataFrame:
    """The append-only log: values clipped, partitioned by day, read back."""
    path = new_path(t.spark, "event-log")
    rows = t["events"].select("event_id", "event_type", F.substring("props", 1, 2000).alias("value"), F.to_date("ts").alias("event_date"))
    # a day's events are spread over several tasks and files
    rows.repartition("event_date", F.pmod(F.xxhash64("event_id"), F.lit(8))).write.mode("append").partitionBy("event_date").parquet(path)
    return t.spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date"), "event_type").agg(F.count("*").alias("n"), F.max(F.length("value")).alias("longest"))


@query("S27 S28 A43", "SELECT story_id, source_id, round(avg(greatest(-1, least(1, (n_chars % 41 - 20) / 10.0::DOUBLE))), 6) AS neutrality, count(*) AS n FROM v_articles WHERE story_id IS NOT NULL GROUP BY ALL")
def audit_round_trip(t: Tables) -> DataFrame:
    """Stories exported as nested JSON in blocks of a hundred article numbers, scores read back, clamped and averaged per outlet."""
    item = F.struct("article_id", "source_id", ((F.col("n_chars") % 41 - 20) / 10.0).alias("score"))
    out = t.articles.where("story_id IS NOT NULL").groupBy("story_id", F.floor(F.col("article_id") / 100).alias("block")).agg(F.to_json(F.collect_list(item)).alias("doc"))
    back = out.select("story_id", F.explode(F.from_json("doc", "array<struct<article_id: long, source_id: string, score: double>>")).alias("a"))
    return back.groupBy("story_id", F.col("a.source_id").alias("source_id")).agg(F.round(F.avg(scores.clamp(F.col("a.score"), -1.0, 1.0)), 6).alias("neutrality"), F.count("*").alias("n"))


@query("S21 S22 S23", """
, p AS (SELECT * FROM (VALUES ('short', 280), ('long', 300)) v(platform, lim))
, c AS (SELECT article_id, title, CASE WHEN length(body) <= 250 THEN body WHEN length(substr(body, 1, 250)) - position('.' IN reverse(substr(body, 1, 250))) + 1 > 100 AND position('.' IN reverse(substr(body, 1, 250))) > 0 THEN substr(body, 1, length(substr(body, 1, 250)) - position('.' IN reverse(substr(body, 1, 250))) + 1) ELSE substr(body, 1, 250) END AS s FROM v_articles)
SELECT article_id, platform, length(substr(title || chr(10) || s, 1, lim)) AS size, md5(substr(title || chr(10) || s, 1, lim)) AS digest FROM c CROSS JOIN p""")
def post_texts(t: Tables) -> DataFrame:
    """Post texts per platform: the summary cut at its last stop after 100 characters, then the platform's limit."""
    head = F.substring("body", 1, 250)
    stop = F.locate(".", F.reverse(head))
    at = F.length(head) - stop + 1
    summary = F.when(F.length("body") <= 250, F.col("body")).when((stop > 0) & (at > 100), F.substring("body", F.lit(1), at)).otherwise(head)
    limits = F.explode(F.array(F.struct(F.lit("short").alias("platform"), F.lit(280).alias("lim")), F.struct(F.lit("long").alias("platform"), F.lit(300).alias("lim"))))
    x = t.articles.select("article_id", F.concat("title", F.lit("\n"), summary).alias("x"), limits.alias("p"))
    cut = F.substring("x", F.lit(1), F.col("p.lim"))
    return x.select("article_id", "p.platform", F.length(cut).alias("size"), F.md5(cut.cast("binary")).alias("digest"))


@query("J20 S15", """
, l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS pos FROM pages), m AS (SELECT '/' || lower(string_split(title, ' ')[1]) AS href, min(article_id) AS article_id FROM v_articles GROUP BY 1)
SELECT page_id, min_by(article_id, pos) AS article_id FROM l JOIN m ON lower(l.href) = m.href GROUP BY page_id""")
def url_link_first_wins(t: Tables) -> DataFrame:
    """The first of a page's links that is known decides."""
    links = t["pages"].select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("pos", "href"))
    known = t.articles.groupBy(F.concat(F.lit("/"), F.lower(F.get(F.split("title", " "), F.lit(0)))).alias("h")).agg(F.min("article_id").alias("article_id"))
    return links.join(known, F.lower("href") == F.col("h")).groupBy("page_id").agg(F.min_by("article_id", "pos").alias("article_id"))


@query("A33 T12", "SELECT user_id AS feed, count(*) AS errors FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-27' GROUP BY user_id HAVING count(*) >= 3")
def failing_feeds(t: Tables) -> DataFrame:
    return t["events"].where("event_type = 'error' AND ts >= TIMESTAMP_NTZ '2024-01-27 00:00:00'").groupBy(F.col("user_id").alias("feed")).agg(F.count("*").alias("errors")).where("errors >= 3")


@query("J24 M29", """
, s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Outlet ' || doc_id % 23 WHEN 1 THEN 'src' || doc_id % 23 WHEN 2 THEN 'The Outlet ' || doc_id % 23 || ' TV' ELSE 'nobody' END AS said FROM documents)
, m AS (SELECT doc_id, coalesce(max(CASE WHEN said = v.source_id THEN v.source_id END), max(CASE WHEN said = v.name THEN v.source_id END), max_by(v.source_id, (length(v.name), v.source_id))) AS source_id FROM s JOIN v_sources v ON said = v.source_id OR contains(said, v.name) GROUP BY doc_id)
SELECT source_id, count(*) AS supporters, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM documents), 4) AS pct FROM m GROUP BY source_id""")
def supporter_counts(t: Tables) -> DataFrame:
    """Names as people write them: exact handle, exact name, else the longest name contained."""
    n = F.col("doc_id") % 23
    said = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Outlet "), n)).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("src"), n)).when(F.col("doc_id") % 4 == 2, F.concat(F.lit("The Outlet "), n, F.lit(" TV"))).otherwise("nobody")
    d = t["documents"].select("doc_id", said.alias("said"))
    names = t.sources.select("source_id", "name")
    # each distinct spelling is resolved once: by the handle, or by its parts that are as long as names are
    spelt = d.select("said").distinct()
    sizes = names.agg(F.collect_set(F.length("name")).alias("sizes"))
    part = F.flatten(F.transform("sizes", lambda n: F.when(F.length("said") >= n, F.transform(F.sequence(F.lit(1), F.length("said") - n + 1), lambda i: F.substring(F.col("said"), i, n))).otherwise(F.array())))
    parts = spelt.join(F.broadcast(sizes)).select("said", F.explode(F.array_distinct(part)).alias("name"))
    met = spelt.join(names, F.col("said") == F.col("source_id")).unionByName(parts.join(names, "name").select("said", "source_id", "name")).distinct()
    found = met.groupBy("said").agg(F.coalesce(F.max(F.when(F.col("said") == F.col("source_id"), F.col("source_id"))), F.max(F.when(F.col("said") == F.col("name"), F.col("source_id"))), F.max_by("source_id", F.struct(F.length("name"), "source_id"))).alias("source_id"))
    total = t["documents"].agg(F.count("*").alias("total"))
    return d.join(found, "said").groupBy("source_id").agg(F.count("*").alias("supporters")).join(F.broadcast(total)).select("source_id", "supporters", F.round(100.0 * F.col("supporters") / F.col("total"), 4).alias("pct"))


@query("A48 P1", "SELECT count(*) AS rows, round(avg(octet_length(encode(body))), 4) AS mean_bytes, max(octet_length(encode(body))) AS most_bytes FROM (SELECT body FROM v_articles ORDER BY ingested_at DESC, article_id LIMIT 300)")
def column_sizes(t: Tables) -> DataFrame:
    """Sizes of a heavy column over the newest rows."""
    x = t.articles.orderBy(F.desc("ingested_at"), "article_id").limit(300).select(F.octet_length("body").alias("b"))
    return x.agg(F.count("*").alias("rows"), F.round(F.avg("b"), 4).alias("mean_bytes"), F.max("b").alias("most_bytes"))


@query("A35 A52", "SELECT event_type, count(*) AS n, min(event_id) AS first, max(value) AS top FROM events WHERE ts >= TIMESTAMP '2024-01-22' AND ts < TIMESTAMP '2024-01-29' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5")
def weekly_digest(t: Tables) -> DataFrame:
    week = t["events"].where("ts >= TIMESTAMP_NTZ '2024-01-22 00:00:00' AND ts < TIMESTAMP_NTZ '2024-01-29 00:00:00'")
    return week.groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"), F.max("value").alias("top")).orderBy(F.desc("n"), "event_type").limit(5)


@query("X17 F7", "SELECT story_id, md5(string_agg(k || '. ' || title, chr(10) ORDER BY k)) AS digest FROM (SELECT story_id, title, row_number() OVER (PARTITION BY story_id ORDER BY article_id) AS k FROM v_articles WHERE story_id IS NOT NULL) WHERE k <= 20 GROUP BY story_id")
def prompt_blocks(t: Tables) -> DataFrame:
    """Numbered title lists of twenty articles per story."""
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("story_id").orderBy("article_id"))
    rows = t.articles.where("story_id IS NOT NULL").select("story_id", "title", k.alias("k")).where("k <= 20")
    lines = F.array_sort(F.collect_list(F.struct("k", "title")))
    return rows.groupBy("story_id").agg(F.md5(F.array_join(F.transform(lines, lambda s: F.concat(s["k"], F.lit(". "), s["title"])), "\n").cast("binary")).alias("digest"))


#: What a million tokens cost: input, cached input (null: as input), output.
PRICES = (
    ("gpt-5", 1.25, 0.125, 10.0), ("gpt-5-mini", 0.25, 0.025, 2.0), ("gpt-5-nano", 0.05, 0.005, 0.4), ("gpt-5-pro", 15.0, None, 120.0), ("gpt-4.1", 2.0, 0.5, 8.0), ("gpt-4.1-mini", 0.4, 0.1, 1.6), ("gpt-4.1-nano", 0.1, 0.025, 0.4),
    ("gpt-4o", 2.5, 1.25, 10.0), ("gpt-4o-mini", 0.15, 0.075, 0.6), ("o4-mini", 1.1, 0.275, 4.4), ("o3", 2.0, 0.5, 8.0), ("text-embedding-3-small", 0.02, None, 0.0),
)
MODELS = ("gpt-4o-mini-2024-07-18", "gpt-5-mini", "gpt-4.1", "o3-2025-04-16", "unheard-of", "text-embedding-3-small", "gpt-5-pro-max")
_PRICE_ROWS = ", ".join(f"('{m}', {i}, {'NULL' if c is None else c}, {o})" for m, i, c, o in PRICES)


@query("F63 S25", f"""
, price AS (SELECT * FROM (VALUES {_PRICE_ROWS}) v(prefix, inp, cached_rate, outp))
, call AS (SELECT event_id, ([{', '.join(f"'{m}'" for m in MODELS)}])[CAST(user_id % {len(MODELS)} + 1 AS BIGINT)] AS model, TRY_CAST(json_extract_string(props, '$.k') AS INT) * 1000 AS inp_n, TRY_CAST(json_extract_string(props, '$.k') AS INT) * 1500 AS cached_n, user_id * 10 AS out_n FROM events)
, rate AS (SELECT model, max_by(prefix, length(prefix)) AS prefix FROM (SELECT DISTINCT model FROM call) JOIN price ON starts_with(model, prefix) GROUP BY model)
, c AS (SELECT event_id, model, r.prefix, inp_n, least(cached_n, inp_n) AS cached, out_n, p.* EXCLUDE (prefix) FROM call LEFT JOIN rate r USING (model) LEFT JOIN price p ON p.prefix = r.prefix)
SELECT event_id, prefix AS rate_source, round(coalesce((inp_n - cached) * inp / 1000000.0::DOUBLE, 0), 6) AS input_cost, round(coalesce(cached * coalesce(cached_rate, inp) / 1000000.0::DOUBLE, 0), 6) AS cached_cost, round(coalesce(out_n * outp / 1000000.0::DOUBLE, 0), 6) AS output_cost FROM c""")
def priced_calls(t: Tables) -> DataFrame:
    """Calls with their cost as they are logged: rates by the longest known prefix of the model's name, cached input at its own rate
    and never more than the input, unknown models at nothing."""
    prices = t.spark.createDataFrame(list(PRICES), "prefix string, inp double, cached_rate double, outp double")
    k = F.get_json_object("props", "$.k").cast("int")
    call = t["events"].select("event_id", F.element_at(F.array(*map(F.lit, MODELS)), (F.col("user_id") % len(MODELS) + 1).cast("int")).alias("model"), (k * 1000).alias("inp_n"), (k * 1500).alias("cached_n"), (F.col("user_id") * 10).alias("out_n"))
    # each model's name is looked up once in the price list, a stated list of a few rows
    rate = call.select("model").distinct().join(F.broadcast(prices), F.col("model").startswith(F.col("prefix"))).groupBy("model").agg(F.max_by(F.struct("prefix", "inp", "cached_rate", "outp"), F.length("prefix")).alias("r")).select("model", "r.*")
    c = call.join(rate, "model", "left").withColumn("cached", F.least("cached_n", "inp_n"))
    cost = lambda n, r: F.round(F.coalesce(n * r / 1_000_000.0, F.lit(0.0)), 6)
    return c.select("event_id", F.col("prefix").alias("rate_source"), cost(F.col("inp_n") - F.col("cached"), F.col("inp")).alias("input_cost"), cost(F.col("cached"), F.coalesce("cached_rate", "inp")).alias("cached_cost"), cost(F.col("out_n"), F.col("outp")).alias("output_cost"))


@query("S1 S3 S2 F35 F36", """
, f AS (SELECT article_id, url || '?utm_source=feed' AS link, title, CASE WHEN article_id % 4 <> 0 THEN published_at END AS published_at, ingested_at, language FROM v_articles )
, k AS (SELECT *, regexp_replace(link, '\\?.*$', '') AS key FROM f WHERE trim(title) <> '' AND NOT contains(link, 'src3.example'))
, old AS (SELECT DISTINCT url AS key FROM v_articles WHERE ingested_at < TIMESTAMP '2024-01-05')
, n AS (SELECT key, min_by(article_id, article_id) AS article_id FROM k WHERE key NOT IN (SELECT key FROM old) GROUP BY key)
SELECT n.key AS url, CASE WHEN n.article_id % 2 = 0 THEN 'World ' || n.article_id % 5 END AS category, coalesce(published_at, ingested_at) AS published_at FROM n JOIN k ON k.article_id = n.article_id""")
def feed_ingest(t: Tables) -> DataFrame:
    """Feeds in a landing folder read as XML: excluded and stored addresses dropped, of equal new ones the first; category and date picked."""
    from heronlake.functions import text
    from heronlake.sources import feeds

    i = F.col("article_id")
    rfc = lambda c: F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    items = t.articles.where("trim(title) <> ''").select(
        F.regexp_replace("title", r"[\x{0}-\x{1F}]", " ").alias("title"), F.concat("url", F.lit("?utm_source=feed")).alias("link"), F.lpad(i.cast("string"), 12, "0").alias("guid"), F.array(F.lit("-"), F.when(i % 2 == 0, F.concat(F.lit("World "), i % 5))).alias("category"),
        F.when(i % 4 != 0, rfc("published_at")).alias("pubDate"), F.date_format("ingested_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated"),
    )
    path = new_path(t.spark, "feeds")
    items.write.option("rowTag", "item").option("rootTag", "channel").xml(path)
    entries = feeds.read_feed(t.spark, path)
    link = text.canonical_url(F.col("link"))
    fresh = entries.where(~F.col("link").contains("src3.example")).withColumn("title", F.col("guid"))  # of equal addresses the first article
    stored = t.articles.where("ingested_at < TIMESTAMP_NTZ '2024-01-05 00:00:00'").select("url")
    new = feeds.new_entries(fresh, stored, link, "url")
    return new.select(text.canonical_url(F.col("link")).alias("url"), feeds.category(F.filter("category", lambda c: c != "-")).alias("category"), feeds.published(F.col("pubDate"), F.col("updated")).cast("timestamp_ntz").alias("published_at"))


STOPS = {"de": ("und", "der", "die", "ist", "nicht", "sch"), "en": ("the", "and", "of", "to", "is", "that"), "es": ("que", "el", "los", "una", "del", "se"), "fr": ("et", "les", "des", "une", "est", "dans")}


@query("F37", "SELECT article_id, CASE WHEN best = 0 THEN 'fa' ELSE lang END AS lang FROM (SELECT article_id, " + "greatest(" + ", ".join(f"n_{k}" for k in STOPS) + ") AS best, CASE " + " ".join(f"WHEN n_{k} = greatest({', '.join(f'n_{x}' for x in STOPS)}) THEN '{k}'" for k in STOPS) + " END AS lang FROM (SELECT article_id, " + ", ".join(f"len(list_filter(string_split_regex(lower(title), '[^\\p{{L}}]+'), lambda w: w IN {v})) AS n_{k}" for k, v in STOPS.items()) + " FROM v_articles))")
def detected_languages(t: Tables) -> DataFrame:
    """A text's language by its function words; without any it counts as the product's own."""
    w = F.split(F.lower("title"), r"[^\p{L}]+")
    hits = lambda words: F.size(F.filter("w", lambda x: x.isin(*words)))
    n = t.articles.select("article_id", w.alias("w")).select("article_id", *(hits(v).alias(k) for k, v in STOPS.items()))
    best = F.greatest(*STOPS)
    lang = F
    for k in STOPS:
        lang = lang.when(F.col(k) == best, k)
    return n.select("article_id", F.when(best == 0, "fa").otherwise(lang).alias("lang"))


@query("T15 T16", """
, r AS (SELECT user_id % 8 AS bundle, date_trunc('week', ts) AS week, event_id, ts, value FROM events WHERE event_type = 'view')
, u AS (SELECT bundle, week, max_by(round(value, 4), (ts, event_id)) AS value, max(ts) AS written_at, count(*) AS writes FROM r GROUP BY ALL)
SELECT bundle, week, value, writes, date_sub('second', written_at, TIMESTAMP '2024-01-31') < 6 * 3600 AS fresh FROM u""")
def digest_upserts(t: Tables) -> DataFrame:
    """One digest per bundle and week, the last write wins; a stored one is fresh for six hours."""
    r = t["events"].where("event_type = 'view'").select((F.col("user_id") % 8).alias("bundle"), F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), "event_id", "ts", "value")
    u = r.groupBy("bundle", "week").agg(F.max_by(F.round("value", 4), F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("written_at"), F.count("*").alias("writes"))
    return u.select("bundle", "week", "value", "writes", (F.timestamp_diff("SECOND", F.col("written_at"), now()) < 6 * 3600).alias("fresh"))
