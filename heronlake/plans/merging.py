"""Which articles and stories belong together: duplicates, same events, merges, splits.

Thresholds in the queries suit the provided vectors; the product's are the defaults of the
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions import text, vector
from heronlake.operators import blocks
from heronlake.operators.graph import components
from heronlake.operators.matching import generic_tokens
from heronlake.plans.ranking import CLUSTER_SQL, eligible
from heronlake.plans.registry import query
from heronlake.plans.similarity import COSINE, VECTOR_SQL
from heronlake.sources.adapters import Tables, hours_before
from heronlake.sources.storage import store

def titled(t: Tables) -> DataFrame:
    """Embedded articles with the signals of their titles."""
    a = t.articles.where("embedding IS NOT NULL")
    first = F.substring("body", 1, 400)
    return a.select("article_id", "story_id", "embedding", "published_at", text.tokens(F.col("title"), 4).alias("w"), text.quoted(first).alias("q"), text.numbers(first).alias("n"))


SIGNAL_SQL = """
, sig AS (SELECT article_id, story_id, embedding, published_at, list_distinct(list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 4)) AS w, list_distinct(regexp_extract_all(substr(body, 1, 400), '«([^«»]+)»', 1)) AS q, list_distinct(regexp_extract_all(substr(body, 1, 400), '[0-9۰-۹]{2,}')) AS n FROM v_articles WHERE embedding IS NOT NULL)
"""


def linked(rows: DataFrame, cosine: float = 0.75, days: int = 5) -> DataFrame:
    """``node`` and ``root``: components of *rows* (of :func:`titled`) that are near in direction and time and share two
    title words, a quotation or a number."""
    signs = F.concat(*(F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x, c=c: F.concat(F.lit(f"{c} "), x)) for c in ("q", "n")))
    kept = blocks.usable(rows, "embedding").select(
        F.col("article_id").cast("long").alias("k"), *blocks.vectors("embedding"), F.coalesce("w", F.array().cast("array<string>")).alias("w"), signs.alias("any"), F.unix_micros(F.col("published_at").cast("timestamp")).alias("at")
    )
    return blocks.linked_components(kept, blocks.linked_judge(cosine, days * 86400))


@query("M11 U6", SIGNAL_SQL + f"""
, e AS (SELECT x.article_id AS a, y.article_id AS b FROM sig x JOIN sig y ON x.article_id < y.article_id WHERE (len(list_intersect(x.w, y.w)) >= 2 OR list_has_any(x.q, y.q) OR list_has_any(x.n, y.n)) AND {COSINE.format('x.embedding', 'y.embedding')} >= 0.02
  AND (x.published_at IS NULL OR y.published_at IS NULL OR abs(date_diff('second', x.published_at, y.published_at)) <= 5 * 86400))
, edge AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(a, b) AS (SELECT a, a FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT a AS article_id, min(b) AS cluster FROM reach GROUP BY a""")
def agglomerative_clusters(t: Tables) -> DataFrame:
    """Clusters of articles linked by direction, time and a shared signal (test cosine .02); single articles are none."""
    return linked(titled(t), 0.02).select(F.col("node").alias("article_id"), F.col("root").alias("cluster"))


#: Share of all rows from which on a word says nothing about an event.
GENERIC = 0.15


def event_rows(rows: DataFrame, key: str, words: str, vec: str, generic: float = GENERIC) -> DataFrame:
    """*rows* as :func:`heronlake.operators.blocks.same_event_judge` asks for them: words that are generic (on a share of
    *generic* of the rows) apart from the specific ones."""
    # one row with the generic words
    told = blocks.usable(rows, vec).join(F.broadcast(generic_tokens(rows, words, generic)))
    own = F.coalesce(words, F.array().cast("array<string>"))
    return told.select(F.col(key).cast("long").alias("k"), *blocks.vectors(vec), F.array_except(own, "generic").alias("s"), F.array_intersect(own, F.col("generic")).alias("g"))


#: The same-event test of the queries (test cosine .1): two shared words, one of them specific, enough overlap.
SAME_EVENT = blocks.same_event_judge(0.1, 0.12, 2)


SMALL_SQL = f"""
, vec AS (SELECT article_id // 3 AS small_id, embedding, title, ingested_at FROM v_articles WHERE embedding IS NOT NULL)
, cell AS (SELECT small_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM vec)
, cent AS (SELECT small_id, list(x ORDER BY p) AS centroid FROM (SELECT small_id, p, avg(x) AS x FROM cell GROUP BY ALL) GROUP BY small_id)
, small AS (SELECT small_id, count(*) AS n, max(ingested_at) AS updated, list_distinct(list_filter(string_split_regex(lower(string_agg(title, ' ')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3)) AS w FROM vec GROUP BY small_id HAVING count(*) <= 4)
, general AS (SELECT coalesce(list(w), []) AS generic FROM (SELECT w FROM (SELECT unnest(w) AS w FROM small) GROUP BY w HAVING count(*) >= {GENERIC} * (SELECT count(*) FROM small)))
, pass AS (SELECT x.small_id AS a, y.small_id AS b FROM small x JOIN small y ON x.small_id < y.small_id JOIN cent cx ON cx.small_id = x.small_id JOIN cent cy ON cy.small_id = y.small_id CROSS JOIN general WHERE len(list_intersect(x.w, y.w)) >= 2
  AND len(list_filter(list_intersect(x.w, y.w), lambda z: NOT list_contains(generic, z))) >= 1 AND len(list_intersect(x.w, y.w)) / (len(x.w) + len(y.w) - len(list_intersect(x.w, y.w)))::DOUBLE >= 0.12 AND {COSINE.format('cx.centroid', 'cy.centroid')} >= 0.1)
"""


def small_stories(t: Tables) -> DataFrame:
    """Stories of three articles in a row."""
    a = t.articles.where("embedding IS NOT NULL").withColumn("small_id", F.floor(F.col("article_id") / 3))
    s = a.groupBy("small_id").agg(F.count("*").alias("n"), F.max("ingested_at").alias("updated"), F.array_join(F.collect_list("title"), " ").alias("title")).where("n <= 4")
    return s.join(vector.centroids(a, "small_id", "embedding"), "small_id").select("small_id", "n", "updated", text.tokens(F.col("title")).alias("w"), "centroid")


@query("M4 M9", SMALL_SQL + "SELECT a, b FROM pass")
def same_event_stories(t: Tables) -> DataFrame:
    """Pairs of small stories that pass the same-event test (test cosine .1)."""
    return blocks.pairs(event_rows(small_stories(t), "small_id", "w", "centroid"), SAME_EVENT)


@query("M5 U8", SMALL_SQL + """
, edge AS (SELECT a, b FROM pass UNION SELECT b, a FROM pass), reach(a, b) AS (SELECT a, a FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
, root AS (SELECT a AS small_id, min(b) AS root FROM reach GROUP BY a)
, keeper AS (SELECT root, max_by(small_id, (n, updated, -small_id)) AS keeper FROM root JOIN small USING (small_id) GROUP BY root)
SELECT r.small_id AS victim, keeper FROM root r JOIN keeper k USING (root) JOIN edge e ON e.a = k.keeper AND e.b = r.small_id""")
def tiny_merges(t: Tables) -> DataFrame:
    """Small stories merged into the largest (then newest) of their chain, if they pass the test with that one directly."""
    small = store(small_stories(t), "small")
    told = store(event_rows(small, "small_id", "w", "centroid"), "small-told")
    root = store(blocks.linked_components(told, SAME_EVENT).withColumnRenamed("node", "small_id"), "small-roots")
    keeper = root.join(small.select("small_id", "n", "updated"), "small_id").groupBy("root").agg(F.max_by("small_id", F.struct("n", "updated", -F.col("small_id"))).alias("keeper"))
    both = root.join(keeper, "root").where("small_id <> keeper").select(F.col("small_id").alias("victim"), "keeper")
    side = lambda x: told.select(F.col("k").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("cell", "v", "s", "g")))
    both = both.join(side("victim"), "victim").join(side("keeper"), "keeper").where("cell_victim = cell_keeper")
    words = lambda x: F.concat(f"s_{x}", f"g_{x}")
    shared = F.array_intersect(words("victim"), words("keeper"))
    passes = F.arrays_overlap("s_victim", "s_keeper") & (F.size(shared) >= 2) & (text.jaccard(words("victim"), words("keeper")) >= 0.12) & (vector.cosine(F.col("v_victim"), F.col("v_keeper")) >= 0.1)
    return both.where(passes).select("victim", "keeper")


LAYER_SQL = f"""
, a0 AS (SELECT article_id, title, url, ingested_at, n_chars, embedding, story_id, first_value(story_id) OVER (PARTITION BY title ORDER BY ingested_at, article_id) AS ks, row_number() OVER (PARTITION BY title ORDER BY ingested_at, article_id) AS k FROM v_articles)
, l1 AS (SELECT article_id FROM a0 WHERE k > 1 AND length(trim(title)) >= 10 AND story_id = ks)
, a1 AS (SELECT article_id, url, ingested_at, n_chars, embedding, CASE WHEN article_id NOT IN (SELECT article_id FROM l1) THEN story_id END AS story_id FROM v_articles)
, b1 AS (SELECT *, first_value(story_id) OVER (PARTITION BY url ORDER BY ingested_at, article_id) AS ks, row_number() OVER (PARTITION BY url ORDER BY ingested_at, article_id) AS k FROM a1)
, l2 AS (SELECT article_id FROM b1 WHERE k > 1 AND length(url) >= 10 AND url NOT LIKE '%t.me/%' AND story_id = ks)
, a2 AS (SELECT article_id, url, n_chars, embedding, story_id, row_number() OVER (ORDER BY ingested_at DESC, article_id) AS i FROM a1 WHERE story_id IS NOT NULL AND article_id NOT IN (SELECT article_id FROM l2) AND embedding IS NOT NULL AND ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 48 HOUR)
, near AS (SELECT x.article_id AS a, y.article_id AS b, row_number() OVER (ORDER BY x.i, y.i) AS k, CASE WHEN contains(x.url, 't.me/') <> contains(y.url, 't.me/') THEN contains(y.url, 't.me/') ELSE x.n_chars >= y.n_chars END AS keep_a
  FROM a2 x JOIN a2 y ON x.i < y.i AND y.i <= 800 AND x.story_id = y.story_id WHERE {COSINE.format('x.embedding', 'y.embedding')} > 0.15)
, go(k, gone, cur, live) AS (SELECT 0::BIGINT, []::BIGINT[], -1::BIGINT, false UNION ALL
  SELECT k, CASE WHEN live AND NOT list_contains(gone, b) THEN list_append(gone, CASE WHEN keep_a THEN b ELSE a END) ELSE gone END, a, live
  FROM (SELECT n.k, g.gone, n.a, n.b, n.keep_a, CASE WHEN n.a = g.cur THEN g.live ELSE NOT list_contains(g.gone, n.a) END AS live FROM go g JOIN near n ON n.k = g.k + 1))
, l3 AS (SELECT unnest(arg_max(gone, k)) AS article_id FROM go)
"""


def keep_first(rows: DataFrame, by: str) -> DataFrame:
    """``article_id`` of the rows that share *by* with an earlier row, and its story with the earliest."""
    first = rows.groupBy(by).agg(F.min(F.struct("ingested_at", "article_id", "story_id")).alias("first"))
    return rows.join(first, by).where("article_id <> first.article_id AND story_id = first.story_id").select("article_id")


def near_repeats(rows: DataFrame, cosine: float = 0.92, most: int = 800) -> DataFrame:
    """``article_id`` of the newest *most* of *rows* that repeat another one of their story: of each pair the
    shorter goes, a channel's copy before an outlet's own.  Pairs are judged from the newest on,
    and what has gone judges no more, so a story's pairs are one fold; there are few such pairs
    among *most* rows.
    """
    own = F.col("url").contains("t.me/")
    top = rows.orderBy(F.desc("ingested_at"), "article_id").limit(most).select("article_id", "story_id", "embedding", "n_chars", own.alias("tg"), F.struct(-F.unix_seconds(F.col("ingested_at").cast("timestamp")), "article_id").alias("i"))
    top = store(top, "newest")
    pairs = top.alias("x").join(top.alias("y"), "story_id").where("x.i < y.i").where(vector.cosine(F.col("x.embedding"), F.col("y.embedding")) > cosine)
    keep_a = F.when(F.col("x.tg") != F.col("y.tg"), F.col("y.tg")).otherwise(F.col("x.n_chars") >= F.col("y.n_chars"))
    rows = pairs.select("story_id", F.struct(F.col("x.i").alias("xi"), F.col("y.i").alias("yi"), F.col("x.article_id").alias("a"), F.col("y.article_id").alias("b"), keep_a.alias("keep_a")).alias("p"))
    lists = rows.groupBy("story_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    start = F.struct(F.array().cast("array<long>").alias("gone"), F.lit(-1).cast("long").alias("cur"), F.lit(False).alias("live"))

    def step(s: Column, p: Column) -> Column:
        live = F.when(p["a"] == s["cur"], s["live"]).otherwise(~F.array_contains(s["gone"], p["a"]))
        gone = F.when(live & ~F.array_contains(s["gone"], p["b"]), F.array_append(s["gone"], F.when(p["keep_a"], p["b"]).otherwise(p["a"]))).otherwise(s["gone"])
        return F.struct(gone.alias("gone"), p["a"].alias("cur"), live.alias("live"))

    return lists.select(F.explode(F.aggregate("ps", start, step)["gone"]).alias("article_id"))


@query("M17 W10", LAYER_SQL + "SELECT article_id, 'title' AS layer FROM l1 UNION ALL SELECT article_id, 'url' FROM l2 UNION ALL SELECT article_id, 'vector' FROM l3")
def dedup_layers(t: Tables) -> DataFrame:
    """Articles that leave their story: equal title, then equal address, then vectors above a cosine (test .15)
    within 48 hours; each layer sees what the one before has left."""
    a = t.articles.select("article_id", "story_id", "title", "url", "ingested_at", "n_chars", "embedding")
    titles = store(keep_first(a.where(F.length(F.trim("title")) >= 10), "title"), "by-title")
    left = lambda rows, gone: rows.join(gone.withColumn("_gone", F.lit(True)), "article_id", "left").withColumn("story_id", F.when(F.col("_gone").isNull(), F.col("story_id"))).drop("_gone")
    a = left(a, titles)
    urls = store(keep_first(a.where((F.length("url") >= 10) & ~F.col("url").contains("t.me/")), "url"), "by-url")
    a = left(a, urls).where(F.col("story_id").isNotNull() & F.col("embedding").isNotNull() & (F.col("ingested_at") >= hours_before(F.lit(48))))
    layer = lambda rows, name: rows.select("article_id", F.lit(name).alias("layer"))
    return layer(titles, "title").unionByName(layer(urls, "url")).unionByName(layer(near_repeats(a, 0.15), "vector"))


@query("X5", VECTOR_SQL + """
, g AS (SELECT article_id, article_id // 8 AS grp, embedding::DOUBLE[] AS e FROM vec), s AS (SELECT grp, list(x ORDER BY p) AS s, any_value(n) AS n FROM (SELECT grp, p, sum(x) AS x, count(*) AS n FROM (SELECT grp, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM g) GROUP BY ALL) GROUP BY grp)
SELECT article_id, n < 2 OR coalesce(list_cosine_similarity(e, list_transform(list_zip(s, e), lambda z: z[1] - z[2])), 0) >= 0.02 AS kept FROM g JOIN s USING (grp)""")
def leave_one_out(t: Tables) -> DataFrame:
    """Members of candidate groups that point the way of the others' mean (test cosine .02; a group has 8 at most).

    The mean without a member is the group's sum less that member, so no pairs are formed.
    """
    g = t.articles.where("embedding IS NOT NULL").select("article_id", F.floor(F.col("article_id") / 8).alias("grp"), "embedding")
    cells = g.select("grp", F.posexplode("embedding").alias("p", "x")).groupBy("grp", "p").agg(F.sum(F.col("x").cast("double")).alias("x"), F.count("*").alias("n"))
    sums = cells.groupBy("grp").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda c: c["x"]).alias("s"), F.max("n").alias("n"))
    others = F.zip_with("s", "embedding", lambda a, b: a - b.cast("double"))
    return g.join(sums, "grp").select("article_id", ((F.col("n") < 2) | (vector.cosine(F.col("embedding"), others) >= 0.02)).alias("kept"))


@query("X1", VECTOR_SQL + """
, g AS (SELECT 'story ' || story_id AS grp, article_id, embedding::DOUBLE[] AS e FROM vec WHERE len(list_filter(embedding[1:5], lambda x: x <> 0)) > 0 UNION ALL SELECT 'small ' || (article_id // 8), article_id, embedding::DOUBLE[] FROM vec WHERE len(list_filter(embedding[1:5], lambda x: x <> 0)) > 0)
, u AS (SELECT *, sqrt(list_dot_product(e, e)) AS size FROM g), c AS (SELECT grp, p, avg(x) AS mean, sum(x / size) AS dir, count(*) AS n FROM (SELECT grp, size, unnest(e) AS x, generate_subscripts(e, 1) AS p FROM u) GROUP BY ALL)
, s AS (SELECT grp, list(mean ORDER BY p) AS mean, list(dir ORDER BY p) AS dir, any_value(n) AS n FROM c GROUP BY grp)
, m AS (SELECT grp, arg_max(e, (round(list_dot_product(e, dir) / size, 9), -article_id)) AS medoid FROM u JOIN s USING (grp) GROUP BY grp)
, f AS (SELECT grp, CASE WHEN n >= 25 THEN medoid ELSE mean END AS v FROM s JOIN m USING (grp))
SELECT grp, round(v[1] / sqrt(list_dot_product(v, v)), 6) AS first, round(v[64] / sqrt(list_dot_product(v, v)), 6) AS last FROM f""")
def anchors(t: Tables) -> DataFrame:
    """What stands for a group: the normalised mean, from 25 members on the member of greatest summed cosine.

    Summed cosines come from the sum of unit vectors, so no pairs are formed.
    """
    v = t.articles.where("embedding IS NOT NULL").where(F.exists(F.slice("embedding", 1, 5), lambda x: x != 0))
    group = F.explode(F.array(F.concat(F.lit("story "), "story_id"), F.concat(F.lit("small "), F.floor(F.col("article_id") / 8))))
    u = v.select(group.alias("grp"), "article_id", "embedding", vector.norm(F.col("embedding")).alias("size"))
    cells = u.select("grp", "size", F.posexplode("embedding").alias("p", "x")).groupBy("grp", "p").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.sum(F.col("x").cast("double") / F.col("size")).alias("dir"), F.count("*").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct("p", "mean", "dir")))
    s = cells.groupBy("grp").agg(F.transform(listed, lambda c: c["mean"]).alias("mean"), F.transform(listed, lambda c: c["dir"]).alias("dir"), F.max("n").alias("n"))
    d = u.join(s.select("grp", "dir"), "grp").withColumn("d", F.round(vector.dot(F.col("embedding"), F.col("dir")) / F.col("size"), 9))
    m = d.groupBy("grp").agg(F.max_by("embedding", F.struct("d", -F.col("article_id"))).alias("medoid"))
    f = s.join(m, "grp").select("grp", vector.unit(F.when(F.col("n") >= 25, F.transform("medoid", lambda x: x.cast("double"))).otherwise(F.col("mean"))).alias("v"))
    return f.select("grp", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


def largest_gap_parts(rows: DataFrame, key: str, item: str, at: str, days: float = 4, most: int = 8) -> DataFrame:
    """*item* and ``part`` (its first item): rows of a *key*, ordered by time, cut at their largest gap while
    they are more than *most* and that gap is over *days*; a part that can't be cut keeps its latest *most*.

    Each round cuts every part that still can be; parts that are done wait.
    """
    first = F.struct(at, item)
    work = store(rows.select(F.col(key).alias("_g"), item, at), "parts")
    done: list[DataFrame] = []
    while True:
        per, order = Window.partitionBy("_g"), Window.partitionBy("_g").orderBy(at, item)
        g = work.withColumn("_gap", F.coalesce(F.timestamp_diff("SECOND", F.lag(at).over(order), F.col(at)), F.lit(0))).withColumn("_n", F.count("*").over(per)).withColumn("_i", F.row_number().over(Window.partitionBy("_g").orderBy(F.desc(at), F.desc(item))))
        g = store(g.withColumn("_cut", F.max(F.struct("_gap", F.struct(at, item))).over(per)), "gaps")
        can = (F.col("_n") > most) & (F.col("_cut._gap") > days * 86400)
        done.append(g.where(~can & (F.col("_i") <= most)).select("_g", item, at))
        open_ = g.where(can)
        if open_.isEmpty():
            break
        # the later half begins with the item after the gap
        later = F.struct(F.col(at), F.col(item)) >= F.struct(F.col(f"_cut.col2.{at}"), F.col(f"_cut.col2.{item}"))
        work = store(open_.select(F.concat_ws("/", F.col("_g").cast("string"), F.when(later, "b").otherwise("a")).alias("_g"), item, at), "parts")
        done = [d.withColumn("_g", F.col("_g").cast("string")) for d in done]
    out = done[0].withColumn("_g", F.col("_g").cast("string"))
    for d in done[1:]:
        out = out.unionByName(d.withColumn("_g", F.col("_g").cast("string")))
    return out.select(item, F.min(first).over(Window.partitionBy("_g"))[item].alias("part"))


@query("W7", """
, e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'signup')
, go(g, event_id, ts, depth, open) AS (SELECT CAST(user_id AS VARCHAR), event_id, ts, 0, true FROM e UNION ALL
  SELECT CASE WHEN can THEN g || CASE WHEN (ts, event_id) >= (cut_at, cut_id) THEN '/b' ELSE '/a' END ELSE g END, event_id, ts, depth + 1, can
  FROM (SELECT *, n > 8 AND gap_max > 4 * 86400 AS can FROM (SELECT *, max(gap) OVER (PARTITION BY g) AS gap_max, last_value(ts) OVER (PARTITION BY g ORDER BY gap, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cut_at, last_value(event_id) OVER (PARTITION BY g ORDER BY gap, ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS cut_id
    FROM (SELECT *, coalesce(date_diff('second', lag(ts) OVER (PARTITION BY g ORDER BY ts, event_id), ts), 0) AS gap, count(*) OVER (PARTITION BY g) AS n FROM go WHERE open)) ) WHERE depth < 40)
, fin AS (SELECT g, event_id, ts FROM go WHERE NOT open)
SELECT event_id, first_value(event_id) OVER (PARTITION BY g ORDER BY ts, event_id) AS part FROM (SELECT * FROM fin QUALIFY row_number() OVER (PARTITION BY g ORDER BY ts DESC, event_id DESC) <= 8)""")
def arc_parts(t: Tables) -> DataFrame:
    """Arcs (a user's sign-ups stand for a component of stories) cut at their largest gaps."""
    return largest_gap_parts(t["events"].where("event_type = 'signup'"), "user_id", "event_id", "ts")


@query("M24 U7", VECTOR_SQL + f"""
, t50 AS (SELECT * FROM (SELECT v.article_id, s.source_id, state_alignment, v.ingested_at, v.embedding, row_number() OVER (PARTITION BY state_alignment ORDER BY v.ingested_at DESC, v.article_id) AS k FROM vec v JOIN v_articles a USING (article_id) JOIN v_sources s ON s.source_id = a.source_id) WHERE k <= 50)
, e AS (SELECT x.article_id AS a, y.article_id AS b FROM t50 x JOIN t50 y ON x.state_alignment = y.state_alignment AND x.source_id <> y.source_id AND x.article_id <> y.article_id AND abs(date_diff('second', x.ingested_at, y.ingested_at)) <= 6 * 3600 WHERE {COSINE.format('x.embedding', 'y.embedding')} > 0.05)
, reach(a, b) AS (SELECT DISTINCT a, a FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b), c AS (SELECT a AS article_id, min(b) AS campaign FROM reach GROUP BY a)
SELECT campaign, count(*) AS articles, count(DISTINCT source_id) AS outlets FROM c JOIN t50 USING (article_id) GROUP BY campaign HAVING count(*) >= 3 AND count(DISTINCT source_id) >= 3""")
def coordination_groups(t: Tables) -> DataFrame:
    """Among the fifty newest articles of each alignment: groups of three or more from three outlets or more, linked by
    vectors (test cosine .05) within six hours."""
    a = t.articles.where("embedding IS NOT NULL").select("article_id", "source_id", "embedding", "ingested_at").join(t.sources.select("source_id", "state_alignment"), "source_id")
    newest = Window.partitionBy("state_alignment").orderBy(F.desc("ingested_at"), "article_id")
    top = store(a.withColumn("k", F.row_number().over(newest)).where("k <= 50"), "newest")
    x, y = top.alias("x"), top.alias("y")
    near = (F.col("x.article_id") < F.col("y.article_id")) & (F.col("x.source_id") != F.col("y.source_id")) & (F.abs(F.timestamp_diff("SECOND", F.col("x.ingested_at"), F.col("y.ingested_at"))) <= 6 * 3600)
    pairs = x.join(y, "state_alignment").where(near & (vector.cosine(F.col("x.embedding"), F.col("y.embedding")) > 0.05)).select(F.col("x.article_id").alias("a"), F.col("y.article_id").alias("b"))
    c = components(pairs).select(F.col("node").alias("article_id"), F.col("root").alias("campaign")).join(top.select("article_id", "source_id"), "article_id")
    return c.groupBy("campaign").agg(F.count("*").alias("articles"), F.countDistinct("source_id").alias("outlets")).where("articles >= 3 AND outlets >= 3")


@query("M24", VECTOR_SQL + f"""
, t50 AS (SELECT * FROM (SELECT v.article_id, s.source_id, state_alignment, a.published_at, v.embedding, row_number() OVER (PARTITION BY state_alignment ORDER BY v.ingested_at DESC, v.article_id) AS k FROM vec v JOIN v_articles a USING (article_id) JOIN v_sources s ON s.source_id = a.source_id) WHERE k <= 50)
, e AS (SELECT x.article_id AS a, y.article_id AS b, {COSINE.format('x.embedding', 'y.embedding')} AS s FROM t50 x JOIN t50 y ON x.state_alignment = y.state_alignment AND x.source_id <> y.source_id AND x.article_id < y.article_id AND abs(date_diff('second', x.published_at, y.published_at)) <= 6 * 3600 WHERE {COSINE.format('x.embedding', 'y.embedding')} > 0.05)
, u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), reach(a, b) AS (SELECT DISTINCT a, a FROM u UNION SELECT r.a, u.b FROM reach r JOIN u ON u.a = r.b), c AS (SELECT a AS article_id, min(b) AS campaign FROM reach GROUP BY a)
, m AS (SELECT campaign, avg(s) AS s FROM e JOIN c ON article_id = a GROUP BY campaign)
SELECT campaign, state_alignment AS side, count(*) AS articles, array_to_string(list_sort(list(DISTINCT source_id)), ',') AS outlets, round(any_value(s), 6) AS similarity, round(date_diff('second', min(published_at), max(published_at)) / 3600, 1) AS window_hours FROM c JOIN t50 USING (article_id) JOIN m USING (campaign) GROUP BY campaign, state_alignment HAVING count(*) >= 3 AND count(DISTINCT source_id) >= 3""")
def coordination_reports(t: Tables) -> DataFrame:
    """Such groups by time of publication, with their side, outlets, the mean similarity of their links and the hours they span."""
    a = t.articles.where("embedding IS NOT NULL").select("article_id", "source_id", "embedding", "ingested_at", "published_at").join(t.sources.select("source_id", "state_alignment"), "source_id")
    newest = Window.partitionBy("state_alignment").orderBy(F.desc("ingested_at"), "article_id")
    top = store(a.withColumn("k", F.row_number().over(newest)).where("k <= 50"), "newest")
    x, y = top.alias("x"), top.alias("y")
    near = (F.col("x.article_id") < F.col("y.article_id")) & (F.col("x.source_id") != F.col("y.source_id")) & (F.abs(F.timestamp_diff("SECOND", F.col("x.published_at"), F.col("y.published_at"))) <= 6 * 3600)
    pairs = x.join(y, "state_alignment").where(near).select(F.col("x.article_id").alias("a"), F.col("y.article_id").alias("b"), vector.cosine(F.col("x.embedding"), F.col("y.embedding")).alias("s")).where("s > 0.05")
    pairs = store(pairs, "coordinated")
    c = store(components(pairs.select("a", "b")).select(F.col("node").alias("article_id"), F.col("root").alias("campaign")), "campaigns")
    mean = pairs.join(c.withColumnRenamed("article_id", "a"), "a").groupBy("campaign").agg(F.round(F.avg("s"), 6).alias("similarity"))
    hours = F.round(F.timestamp_diff("SECOND", F.min("published_at"), F.max("published_at")) / 3600, 1)
    g = c.join(top, "article_id").groupBy("campaign", F.col("state_alignment").alias("side")).agg(F.count("*").alias("articles"), F.array_sort(F.collect_set("source_id")).alias("o"), hours.alias("window_hours")).where((F.col("articles") >= 3) & (F.size("o") >= 3))
    return g.join(mean, "campaign").select("campaign", "side", "articles", F.array_join("o", ",").alias("outlets"), "similarity", "window_hours")


@query("M6 M7", CLUSTER_SQL + VECTOR_SQL + f"""
, cell AS (SELECT cluster_no AS cluster_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM vec), cent AS (SELECT cluster_id, list(x ORDER BY p) AS v FROM (SELECT cluster_id, p, avg(x) AS x FROM cell GROUP BY ALL) GROUP BY cluster_id)
, top AS (SELECT cluster_id, priority, list_distinct(list_filter(string_split_regex(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 3)) AS w, v FROM (SELECT * FROM eligible ORDER BY trending DESC, cluster_id LIMIT 80) LEFT JOIN cent USING (cluster_id))
SELECT a.cluster_id AS a, b.cluster_id AS b FROM top a JOIN top b ON a.cluster_id < b.cluster_id, LATERAL (SELECT CASE WHEN len(a.w) > 0 AND len(b.w) > 0 THEN len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w))::DOUBLE ELSE 0 END AS o, {COSINE.format('a.v', 'b.v')} AS c) WHERE NOT (a.priority >= 40 AND b.priority >= 40) AND (o >= 0.4 OR c >= 0.5) ORDER BY c DESC, a.cluster_id, b.cluster_id LIMIT 30""")
def merge_pairs(t: Tables) -> DataFrame:
    """Of the eighty most visible stories the thirty pairs nearest in direction whose titles overlap or whose centroids are near
    (test cosine .5); two pinned stories are never merged."""
    v = vector.centroids(t.articles.where("embedding IS NOT NULL").withColumn("cluster_id", F.col("cluster_no")), "cluster_id", "embedding")
    top = eligible(t).orderBy(F.desc("trending"), "cluster_id").limit(80).join(v, "cluster_id", "left")
    side = lambda x: top.select(F.col("cluster_id").alias(x), F.col("priority").alias(f"p{x}"), text.tokens(F.col("title")).alias(f"w{x}"), F.col("centroid").alias(f"v{x}"))
    # eighty rows by eighty
    both = side("a").join(F.broadcast(side("b")), F.col("a") < F.col("b")).withColumn("c", F.coalesce(vector.cosine(F.col("va"), F.col("vb")), F.lit(0.0)))
    both = both.where(~((F.col("pa") >= 40) & (F.col("pb") >= 40)) & ((text.overlap(F.col("wa"), F.col("wb")) >= 0.4) | (F.col("c") >= 0.5)))
    return both.orderBy(F.desc("c"), "a", "b").limit(30).select("a", "b")
