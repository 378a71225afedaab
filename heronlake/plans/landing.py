"""Ingest: entries of feeds, the scraper where a feed fails, insert-if-absent, one log row per source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.functions import text
from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables
from heronlake.sources.sink import KeyedTable
from heronlake.sources.storage import store

#: Addresses that a source's feed carries but that aren't articles.
EXCLUDED = {"src3": "/a/1", "src8": "/a/22"}
ARTICLE = "url string, source_id string, title string, language string, published_at timestamp_ntz, way string, seen long"


def list_links(pages: DataFrame, base: str = "base", html: str = "html", least: int = 10) -> DataFrame:
    """Links of list pages with a title of *least* characters: *pages*' other columns, ``url`` (absolute) and ``title``, with
    its place ``at``; of equal addresses of a page the first."""
    links = F.posexplode(F.regexp_extract_all(html, F.lit(r'(?s)(<a\s[^>]*href="[^"]*"[^>]*>.*?</a>)'), F.lit(1))).alias("at", "link")
    href, title = F.regexp_extract("link", r'href="([^"]*)"', 1), F.trim(F.regexp_replace(F.regexp_extract("link", r"(?s)>(.*)</a>\z", 1), r"<[^>]*>|\s+", " "))
    url = F.when(href.rlike("^https?://"), href).otherwise(F.concat(base, href))
    found = pages.select(*(c for c in pages.columns if c != html), links).select("*", url.alias("url"), title.alias("title")).where((href != "") & (F.length("title") >= least))
    rest = [c for c in pages.columns if c not in (html, base)]
    return found.groupBy(*rest, "url").agg(F.min(F.struct("at", "title")).alias("f")).select(*rest, "url", "f.at", "f.title")


def checked(entries: DataFrame, excluded: dict[str, str]) -> DataFrame:
    """*entries* with their canonical ``url`` and ``reason``: why an entry is dropped, in this order: no address, an excluded
    one, no title (null: it stays)."""
    e = entries.withColumn("url", text.canonical_url(F.trim("link")))
    out = F.lit(False)
    for source, part in excluded.items():
        out = out | ((F.col("source_id") == source) & F.col("url").contains(part))
    reason = F.when(F.coalesce(F.trim("link"), F.lit("")) == "", "no_url").when(out, "excluded").when(F.coalesce(F.trim("title"), F.lit("")) == "", "no_title")
    return e.withColumn("reason", reason)


def ingest(table: KeyedTable, run: str, sources: DataFrame, entries: DataFrame, pages: DataFrame, excluded: dict[str, str]) -> DataFrame:
    """Add what is new to *table* and give the run's log, a row per source.

    *sources* has ``source_id`` and ``failed`` (its feed gave an error and nothing else); *entries* are of the others' feeds,
    *pages* the list pages (``source_id``, ``base``, ``page``, ``html``) of those that failed.  A run that is whole already
    adds nothing and gives the same log.
    """
    e = store(checked(entries, excluded), "entries")
    scraped = list_links(pages.join(sources.where("failed"), "source_id", "left_semi"))
    scraped = scraped.select("url", "source_id", "title", F.lit(None).cast("string").alias("language"), F.lit(None).cast("timestamp_ntz").alias("published_at"), F.lit("scrape").alias("way"), (F.col("page") * 1000 + F.col("at")).cast("long").alias("seen"))
    rows = e.where("reason IS NULL").select("url", "source_id", "title", "language", "published_at", F.lit("feed").alias("way"), "seen").unionByName(scraped)
    table.insert(rows, run, "seen")
    came = e.groupBy("source_id").agg(F.count("*").alias("found"), *(F.count_if(F.col("reason") == r).alias(r) for r in ("no_url", "excluded", "no_title")))
    new = table.batch(run).groupBy("source_id").agg(F.count_if(F.col("way") == "feed").alias("new"), F.count_if(F.col("way") == "scrape").alias("scraped"))
    log = sources.join(came, "source_id", "left").join(new, "source_id", "left").na.fill(0)
    repeated = F.col("found") - F.col("no_url") - F.col("excluded") - F.col("no_title") - F.col("new")
    return log.select("source_id", F.lit(run).alias("run"), F.when(F.col("failed"), "error").otherwise("success").alias("status"), "found", "no_url", "excluded", "no_title", "new", repeated.alias("repeated"), "scraped")


RUNS = {"run-1": "2024-01-20", "run-2": "2024-02-01", "run-3": "2024-02-01"}


@query("S1 S2 S3 S4 S24", """
, runs AS (SELECT * FROM (VALUES ('run-1', TIMESTAMP '2024-01-20'), ('run-2', TIMESTAMP '2024-02-01'), ('run-3', TIMESTAMP '2024-02-01')) r(run, upto))
, src AS (SELECT source_id, factional_alignment IS NULL AS failed FROM v_sources)
, raw AS (SELECT run, article_id, a.source_id, failed, url, CASE WHEN contains(title, '!!') THEN ' ' ELSE title END AS title, n_chars < 40 AS bare FROM runs JOIN v_articles a ON ingested_at < upto JOIN src s ON s.source_id = a.source_id)
, e AS (SELECT *, CASE WHEN bare THEN 'no_url' WHEN (source_id = 'src3' AND contains(url, '/a/1')) OR (source_id = 'src8' AND contains(url, '/a/22')) THEN 'excluded' WHEN trim(title) = '' THEN 'no_title' END AS reason FROM raw WHERE NOT failed)
, c AS (SELECT run, article_id, source_id, url, 'feed' AS way FROM e WHERE reason IS NULL UNION ALL SELECT run, article_id, source_id, url, 'scrape' FROM raw WHERE failed AND length(trim(regexp_replace(translate(title, '<>', '  '), '\\s+', ' ', 'g'))) >= 10)
, f AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY url ORDER BY run, article_id) = 1)
, m AS (SELECT run, source_id, count(*) AS found, count(*) FILTER (reason = 'no_url') AS no_url, count(*) FILTER (reason = 'excluded') AS excluded, count(*) FILTER (reason = 'no_title') AS no_title FROM e GROUP BY ALL)
, n AS (SELECT run, source_id, count(*) FILTER (way = 'feed') AS new_, count(*) FILTER (way = 'scrape') AS scraped FROM f GROUP BY ALL)
SELECT s.source_id, r.run, CASE WHEN failed THEN 'error' ELSE 'success' END AS status, coalesce(found, 0) AS found, coalesce(no_url, 0) AS no_url, coalesce(excluded, 0) AS excluded, coalesce(no_title, 0) AS no_title, coalesce(new_, 0) AS new,
 coalesce(found, 0) - coalesce(no_url, 0) - coalesce(excluded, 0) - coalesce(no_title, 0) - coalesce(new_, 0) AS repeated, coalesce(scraped, 0) AS scraped FROM src s CROSS JOIN runs r LEFT JOIN m ON m.run = r.run AND m.source_id = s.source_id LEFT JOIN n ON n.run = r.run AND n.source_id = s.source_id""")
def ingest_log(t: Tables) -> DataFrame:
    """Three runs over the feeds: what came, why entries were dropped, what was new; the third adds nothing.  Outlets whose feed
    fails are scraped from their list pages (fifty links each)."""
    sources = t.sources.select("source_id", F.col("factional_alignment").isNull().alias("failed"))
    title = F.when(F.col("title").contains("!!"), " ").otherwise(F.col("title"))
    a = store(t.articles.select("article_id", "source_id", "url", title.alias("title"), "n_chars", "language", "published_at", "ingested_at").join(sources, "source_id"), "landing")
    table, log = KeyedTable(t.spark, ARTICLE, "url"), None
    for run, upto in RUNS.items():
        some = a.where(F.col("ingested_at") < F.lit(upto).cast("timestamp_ntz"))
        link = F.when(F.col("n_chars") < 40, "").otherwise(F.concat("url", F.lit("?utm_source=feed")))
        entries = some.where("NOT failed").select("source_id", link.alias("link"), "title", "language", "published_at", F.col("article_id").cast("long").alias("seen"))
        anchor = F.concat(F.lit('<li><a class="x" href="'), F.regexp_extract("url", "^https?://[^/]*(.*)$", 1), F.lit('"><b>'), F.translate("title", "<>", "  "), F.lit("</b></a></li>"))
        lists = some.where("failed").select("source_id", F.concat(F.lit("https://"), "source_id", F.lit(".example")).alias("base"), F.expr("article_id div 50").alias("page"), F.struct("article_id", anchor.alias("a")).alias("x"))
        pages = lists.groupBy("source_id", "base", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["a"]), "").alias("html"))
        here = store(ingest(table, run, sources, entries, pages, EXCLUDED), "ingest-log")
        log = here if log is None else log.unionByName(here)
    return log
