"""Vector and set similarity: centroids, pairs, components, matching.

Thresholds are the test values; the product's are the operators' defaults or in the docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions import text, vector
from heronlake.operators import blocks, similarity
from heronlake.operators.graph import components
from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables, hours_before

COSINE = "coalesce(list_cosine_similarity({0}::DOUBLE[], {1}::DOUBLE[]), 0)"
#: Embedded articles are *arrivals* if they came in during the last week, else *stored*.
VECTOR_SQL = """
, vec AS (SELECT article_id, story_id, cluster_no, embedding, ingested_at, ingested_at >= TIMESTAMP '2024-01-31' - INTERVAL 168 HOUR AS arrived FROM v_articles WHERE embedding IS NOT NULL)
"""


def centroid_sql(where: str) -> str:
    return VECTOR_SQL + f"""
, cell AS (SELECT story_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM vec WHERE {where})
, cent AS (SELECT story_id, list(x ORDER BY p) AS centroid FROM (SELECT story_id, p, avg(x) AS x FROM cell GROUP BY ALL) GROUP BY story_id)
"""


CENTROID_SQL, STORED_SQL = centroid_sql("true"), centroid_sql("NOT arrived")


def vectors(t: Tables) -> DataFrame:
    arrived = F.col("ingested_at") >= hours_before(F.lit(168))
    return t.articles.where("embedding IS NOT NULL").select("article_id", "story_id", "embedding", "ingested_at", arrived.alias("arrived"))


def story_centroids(t: Tables, where: str = "true") -> DataFrame:
    return vector.centroids(vectors(t).where(where), "story_id", "embedding")


@query("F52 A2 X1", CENTROID_SQL + "SELECT story_id, round(centroid[1], 6) AS first, round(centroid[64], 6) AS last, round(sqrt(list_sum(list_transform(centroid, lambda x: x * x))), 6) AS norm FROM cent")
def centroid_mean(t: Tables) -> DataFrame:
    c = F.col("centroid")
    return story_centroids(t).select("story_id", F.round(c[0], 6).alias("first"), F.round(c[63], 6).alias("last"), F.round(vector.norm(c), 6).alias("norm"))


@query("M16 M33 F51", CENTROID_SQL + f"SELECT article_id, round({COSINE.format('embedding', 'centroid')}, 6) AS score FROM vec JOIN cent USING (story_id) WHERE {COSINE.format('embedding', 'centroid')} < 0.25")
def unrelated_articles(t: Tables) -> DataFrame:
    """Articles below a cosine of .25 to the centroid of their own story."""
    score = vector.cosine(F.col("embedding"), F.col("centroid"))
    return vectors(t).join(story_centroids(t), "story_id").select("article_id", score.alias("s")).where("s < 0.25").select("article_id", F.round("s", 6).alias("score"))


@query("M10 J16", CENTROID_SQL + f"""SELECT story_id, other, score FROM (SELECT a.story_id, b.story_id AS other, round({COSINE.format('a.centroid', 'b.centroid')}, 6) AS score, row_number() OVER (PARTITION BY a.story_id ORDER BY {COSINE.format('a.centroid', 'b.centroid')} DESC, b.story_id) AS k FROM cent a JOIN cent b ON a.story_id <> b.story_id) WHERE k <= 3""")
def related_topk(t: Tables) -> DataFrame:
    """Three nearest stories of each story."""
    c = story_centroids(t)
    others = c.select(F.col("story_id").alias("other"), F.col("centroid").alias("oc"))
    top = None
    for part in similarity.scored_blocks(c, "centroid", others, "other", "oc"):
        here = part.where("story_id <> other").select("story_id", "other", F.col("score").alias("s"))
        top = here if top is None else top.unionByName(here)
    return top.withColumn("k", F.row_number().over(Window.partitionBy("story_id").orderBy(F.desc("s"), "other"))).where("k <= 3").select("story_id", "other", F.round("s", 6).alias("score"))


BEST_SQL = STORED_SQL + f"""
, sc AS (SELECT article_id, c.story_id, {COSINE.format('embedding', 'centroid')} AS s FROM vec CROSS JOIN cent c WHERE arrived)
, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY s DESC, story_id) AS k FROM sc WHERE s >= 0.10) WHERE k = 1)
"""


def orphans(t: Tables) -> DataFrame:
    """Arrivals: their stories are still to be found."""
    return vectors(t).where("arrived").select("article_id", "embedding")


def orphan_matches(t: Tables) -> DataFrame:
    return similarity.best_match(orphans(t), "article_id", "embedding", story_centroids(t, "NOT arrived"), "story_id", "centroid", 0.10)


@query("J15 J23", BEST_SQL + "SELECT article_id, story_id, round(s, 6) AS score FROM best")
def orphan_best_match(t: Tables) -> DataFrame:
    """Arrivals and the stored story they fit best."""
    return orphan_matches(t).select("article_id", "story_id", F.round("score", 6).alias("score"))


def against(t: Tables, least: float) -> DataFrame:
    """Arrivals with their cosine to the stored stories' centroids, from *least* on."""
    return similarity.scored(orphans(t), "article_id", "embedding", story_centroids(t, "NOT arrived"), "story_id", "centroid", least)


#: Places left in a story; arrivals are placed in the order of their numbers.
PLACES = 5


@query("M14 W12", BEST_SQL + f"""
, turn AS (SELECT article_id, row_number() OVER (ORDER BY article_id) AS i FROM (SELECT DISTINCT article_id FROM sc))
, fits AS (SELECT i, article_id, story_id, s, row_number() OVER (PARTITION BY article_id ORDER BY s DESC, story_id) AS k FROM sc JOIN turn USING (article_id) WHERE s >= 0.10)
, go(i, used, article_id, story_id) AS (
  SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT, NULL::BIGINT
  UNION ALL
  SELECT go.i + 1, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, t.article_id, pick FROM (
    SELECT g.i AS gi, (SELECT arg_min(f.story_id, f.k) FROM fits f WHERE f.i = g.i + 1 AND len(list_filter(g.used, lambda x: x = f.story_id)) < {PLACES}) AS pick FROM go g) p JOIN go ON go.i = p.gi JOIN turn t ON t.i = go.i + 1)
SELECT article_id, story_id FROM go WHERE story_id IS NOT NULL""")
def capacity_assignment(t: Tables) -> DataFrame:
    """Arrivals placed one after another in the best story that still has room; what finds none stays out."""
    wishes = against(t, 0.10)
    return similarity.placed(wishes, "article_id", "story_id", "score", PLACES)


@query("M19", BEST_SQL + "SELECT floor(s * 20)::BIGINT AS band, count(*) AS n FROM best GROUP BY 1")
def triage_bands(t: Tables) -> DataFrame:
    return orphan_matches(t).groupBy(F.floor(F.col("score") * 20).alias("band")).agg(F.count("*").alias("n"))


TOKEN_SQL = """
, tok AS (SELECT article_id, embedding, list_distinct(list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}]+'), lambda x: length(x) >= 5)) AS w FROM v_articles WHERE embedding IS NOT NULL)
, pr AS (SELECT a.article_id AS a, b.article_id AS b, len(list_intersect(a.w, b.w)) AS shared, len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)) AS un, coalesce(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 0) AS c FROM tok a JOIN tok b ON a.article_id < b.article_id)
"""


def titled(t: Tables) -> DataFrame:
    return t.articles.where("embedding IS NOT NULL").select("article_id", "embedding", text.tokens(F.col("title"), 5).alias("w"))


@query("J16", TOKEN_SQL + "SELECT a, b, shared, round(c, 6) AS cosine FROM pr WHERE shared >= 2 AND shared / un::DOUBLE >= 0.12 AND c >= -0.05")
def same_event_pairs(t: Tables) -> DataFrame:
    """Pairs with two shared title tokens, a Jaccard of .12 and a cosine (test value)."""
    # no word is generic here, so all are specific
    none = F.array().cast("array<string>")
    rows = blocks.usable(titled(t), "embedding").select(F.col("article_id").cast("long").alias("k"), *blocks.vectors("embedding"), F.coalesce("w", none).alias("s"), none.alias("g"))
    found = blocks.pairs(rows, blocks.same_event_judge(-0.05, 0.12, 2), (("shared", "int"), ("c", "double")))
    return found.select("a", "b", "shared", F.round("c", 6).alias("cosine"))


@query("U6", TOKEN_SQL + """
, edge AS (SELECT a, b FROM pr WHERE shared >= 2 UNION SELECT b, a FROM pr WHERE shared >= 2)
, reach(a, b) AS (SELECT a, a FROM edge UNION SELECT r.a, e.b FROM reach r JOIN edge e ON e.a = r.b)
SELECT a AS article_id, min(b) AS component, count(*) AS size FROM reach GROUP BY a""")
def event_components(t: Tables) -> DataFrame:
    """Connected components of pairs that share two title tokens."""
    c = components(similarity.shared_pair_links(titled(t), "article_id", "w"))
    size = c.groupBy("root").agg(F.count("*").alias("size"))
    return c.join(size, "root").select(F.col("node").alias("article_id"), F.col("root").alias("component"), "size")


@query("J17", f"""
, a AS (SELECT article_id, state_alignment, source_id, article_id % 720 AS h, embedding FROM v_articles JOIN v_sources USING (source_id) WHERE embedding IS NOT NULL)
SELECT x.article_id AS a, y.article_id AS b, round({COSINE.format('x.embedding', 'y.embedding')}, 6) AS cosine FROM a x JOIN a y ON x.state_alignment = y.state_alignment AND x.source_id <> y.source_id AND abs(x.h - y.h) <= 6 AND x.article_id < y.article_id WHERE {COSINE.format('x.embedding', 'y.embedding')} > 0.1""")
def coordination_pairs(t: Tables) -> DataFrame:
    """Same alignment, other outlet, within six hours, similar (test cosine .1)."""
    a = t.articles.where("embedding IS NOT NULL").select("article_id", "source_id", "embedding", ((F.col("article_id") % 720) * 3600).alias("s")).join(t.sources.select("source_id", "state_alignment"), "source_id")
    rows = blocks.usable(a, "embedding").select(F.col("article_id").cast("long").alias("k"), F.col("embedding").alias("v"), F.col("state_alignment").alias("equal"), F.col("source_id").alias("other"), F.col("s").alias("at"))
    return blocks.band_pairs(rows, 0.1, 6 * 3600).select("a", "b", F.round("c", 6).alias("cosine"))


#: Where alignments stand across, with an axis and (under three articles) without one.
AXIS = {"state": 80, "semi_state": 65, "independent": 50, "diaspora": 20}
PLAIN = {"state": 15, "semi_state": 35, "independent": 50, "diaspora": 80}


def _outer_sums(batches):
    """Per story: number, sum and sums of products of vector components, one row per component."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        story = batch.column(0).to_numpy()
        matrix = np.array(batch.column(1).to_pylist(), float)
        for s in np.unique(story):
            x = matrix[story == s]
            d = x.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([int(s)] * d, pa.int64()), pa.array(range(d), pa.int32()), pa.array([len(x)] * d, pa.int64()), pa.array(x.sum(axis=0)), pa.array((x.T @ x).tolist(), pa.list_(pa.float64()))], ["story_id", "p", "n", "total", "products"])


def _main_axis(key, rows):
    """The first principal axis of one story (its largest component positive), from its covariance: 64 rows."""
    import numpy as np
    import pandas as pd

    rows = rows.sort_values("p")
    n, mean = rows["n"].iloc[0], rows["total"].to_numpy() / rows["n"].iloc[0]
    cov = np.stack(rows["products"].to_list()) / n - np.outer(mean, mean)
    axis = np.linalg.eigh(cov)[1][:, -1]
    axis = axis * np.sign(axis[np.abs(axis).argmax()])
    return pd.DataFrame({"story_id": [key[0]], "axis": [axis.tolist()], "n": [int(n)]})


DOT = "list_dot_product({0}, {1})"


@query("X4", VECTOR_SQL + """
, cell AS (SELECT story_id, article_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM vec), mean AS (SELECT story_id, p, avg(x) AS m FROM cell GROUP BY ALL)
, cx AS (SELECT story_id, article_id, list(x - m ORDER BY p) AS v FROM cell JOIN mean USING (story_id, p) GROUP BY ALL), col AS (SELECT story_id, p, list(x - m ORDER BY article_id) AS c FROM cell JOIN mean USING (story_id, p) GROUP BY ALL)
, row AS (SELECT a.story_id, a.p, list(list_dot_product(a.c, b.c) ORDER BY b.p) AS r FROM col a JOIN col b ON a.story_id = b.story_id GROUP BY ALL), mat AS (SELECT story_id, list(r ORDER BY p) AS m FROM row GROUP BY story_id)
, pow(story_id, k, m) AS (SELECT story_id, 0, m FROM mat UNION ALL SELECT story_id, k + 1, list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / list_sum(list_transform(m, lambda z: list_dot_product(z, z))))) FROM pow WHERE k < 16)
, ax AS (SELECT story_id, list_sort(list_transform(m, lambda a: {'s': list_dot_product(a, a), 'a': a}), 'DESC')[1].a AS a FROM pow WHERE k = 16)
, sgn AS (SELECT story_id, list_transform(a, lambda z: z / sqrt(list_dot_product(a, a)) * CASE WHEN list_max(a) >= -list_min(a) THEN 1 ELSE -1 END) AS a FROM ax)
, y AS (SELECT story_id, article_id, list_dot_product(v, a) AS y, count(*) OVER (PARTITION BY story_id) AS n FROM cx JOIN sgn USING (story_id)), z AS (SELECT *, min(y) OVER (PARTITION BY story_id) AS lo, max(y) OVER (PARTITION BY story_id) AS hi FROM y)
, j AS (SELECT z.*, state_alignment, row_number() OVER (PARTITION BY z.story_id, state_alignment ORDER BY z.article_id) - 1 AS i FROM z JOIN v_articles USING (article_id) JOIN v_sources USING (source_id))
SELECT article_id, CASE WHEN n >= 3 THEN CASE state_alignment WHEN 'state' THEN 80 WHEN 'semi_state' THEN 65 WHEN 'diaspora' THEN 20 ELSE 50 END + (i % 3 - 1) * 5 ELSE CASE state_alignment WHEN 'state' THEN 15 WHEN 'semi_state' THEN 35 WHEN 'diaspora' THEN 80 ELSE 50 END + i * 5 END AS x, CASE WHEN n >= 3 THEN round(15 + (y - lo) / (hi - lo) * 70, 1) ELSE 50.0 + i * 10 END AS y FROM j""")
def article_positions(t: Tables) -> DataFrame:
    """Where a story's articles stand on its map: outlets' alignment across, the first principal axis of the vectors up (15 to 85).

    Covariances are summed by tasks and merged per component, so no task holds a story's vectors.
    """
    from heronlake.sources.storage import store

    v = vectors(t).select(F.col("story_id").cast("long").alias("story_id"), "article_id", "embedding")
    parts = v.select("story_id", "embedding").mapInArrow(_outer_sums, "story_id long, p int, n long, total double, products array<double>")
    summed = parts.select("story_id", "p", "n", "total", F.posexplode("products").alias("q", "x")).groupBy("story_id", "p", "q").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("x").alias("x"))
    cov = summed.groupBy("story_id", "p").agg(F.max("n").alias("n"), F.max("total").alias("total"), F.transform(F.array_sort(F.collect_list(F.struct("q", "x"))), lambda c: c["x"]).alias("products"))
    axis = store(cov.groupBy("story_id").applyInPandas(_main_axis, "story_id long, axis array<double>, n long"), "axes")
    # centring moves all of a story's projections alike, and scaling takes that out again
    up = store(v.join(axis, "story_id").select("story_id", "article_id", "n", vector.dot(F.col("embedding"), F.col("axis")).alias("y")), "projected")
    ends = up.groupBy("story_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    outlet = t.articles.select("article_id", "source_id").join(t.sources.select("source_id", "state_alignment"), "source_id")
    j = up.join(ends, "story_id").join(outlet, "article_id")
    i = F.row_number().over(Window.partitionBy("story_id", "state_alignment").orderBy("article_id")) - 1
    base = lambda places: F.coalesce(*(F.when(F.col("state_alignment") == k, x) for k, x in places.items()), F.lit(50))
    many = F.col("n") >= 3
    scaled = F.when(F.col("hi") > F.col("lo"), 15 + (F.col("y") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 70).otherwise(50.0)
    j = j.withColumn("i", i)
    return j.select("article_id", F.when(many, base(AXIS) + (F.col("i") % 3 - 1) * 5).otherwise(base(PLAIN) + F.col("i") * 5).alias("x"), F.when(many, F.round(scaled, 1)).otherwise(50.0 + F.col("i") * 10).alias("y"))
