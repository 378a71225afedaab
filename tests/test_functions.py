"""Expressions against hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from heronlake.functions import groups, scores, text, vector


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "location, faction, state, want",
    [("inside", "hardline", None, "principlist"), ("inside", None, "state", "principlist"), ("inside", "reformist", "independent", "reformist"), ("inside", None, None, "reformist"), ("outside", "monarchist", None, "radical_diaspora"), ("outside", "hardline", "state", "moderate_diaspora"), (None, None, None, "moderate_diaspora")],
)
def test_narrative_group(spark, location, faction, state, want):
    df = spark.createDataFrame([(location, faction, state)], "production_location string, factional_alignment string, state_alignment string")
    assert df.select(groups.narrative_group().alias("g")).first().g == want


@pytest.mark.parametrize("counts, want", [((1, 1, 1, 0), (34, 33, 33, 0)), ((0, 0, 0, 0), (0, 0, 0, 0)), ((1, 2, 3, 1), (14, 29, 43, 14)), ((1, 1, 1, 1), (25, 25, 25, 25)), ((7, 0, 0, 0), (100, 0, 0, 0))])
def test_largest_remainder(spark, counts, want):
    df = spark.createDataFrame([(1, g, i, c) for i, (g, c) in enumerate(zip(groups.GROUPS, counts))], "k int, g string, o int, n long")
    got = {r.g: r.pct for r in groups.largest_remainder(df, "k", "g", "n", F.col("o")).collect()}
    assert tuple(got[g] for g in groups.GROUPS) == want


@pytest.mark.parametrize("state, diaspora, want", [(0, 0, None), (0, 3, "diaspora_only"), (2, 0, "state_only"), (1, 2, "diaspora_only"), (3, 1, "state_only"), (2, 2, None), (1, 9, "diaspora_only"), (2, 8, None), (9, 1, "state_only"), (1, 1, None)])
def test_blindspot_by_articles(spark, state, diaspora, want):
    assert one(spark, scores.blindspot_by_articles(F.lit(state), F.lit(diaspora))) == want


@pytest.mark.parametrize("inside, outside, want", [(70, 30, "state_only"), (30, 70, "diaspora_only"), (69, 31, None), (0, 0, None)])
def test_blindspot_by_shares(spark, inside, outside, want):
    assert one(spark, scores.blindspot_by_shares(F.lit(inside), F.lit(outside))) == want


def test_trending(spark):
    now, none = F.lit(dt.datetime(2024, 1, 11)), F.lit(None).cast("timestamp")
    day = lambda d: F.lit(dt.datetime(2024, 1, d))
    score = lambda n, s, fr, up, fi: one(spark, scores.trending(F.lit(n), F.lit(s), fr, up, fi, now))
    assert score(5, 1, none, day(11), none) == 0
    assert score(4, 1, none, none, none) == pytest.approx(0.2)
    assert score(10, 3, day(9), day(11), day(1)) == pytest.approx(10 * 0.85**2)
    assert score(10, 3, none, day(1), none) == pytest.approx(10 * 0.85**10)
    assert score(10, 3, none, day(20), none) == 10


@pytest.mark.parametrize("state, diaspora, want", [(None, ["a"], 0.15), ([" "], ["a"], 0.15), (["a", "b", "c"], ["d", "e", "f"], 1.0), (["a"], ["a"], 0.38), (["a", "b"], ["b", "c"], 0.66)])
def test_dispute(spark, state, diaspora, want):
    df = spark.createDataFrame([(state, diaspora)], "s array<string>, d array<string>")
    assert df.select(scores.dispute(F.col("s"), F.col("d")).alias("x")).first().x == pytest.approx(want)


@pytest.mark.parametrize(
    "now, old, want",
    [((5, 0.5, 50, 50, "a"), (5, 0.3, 50, 50, "a"), "dispute"), ((5, None, 65, 35, "a"), (5, 0.3, 50, 50, "a"), "coverage_shift"), ((8, 0.3, 50, 50, "b"), (5, 0.3, 50, 50, "a"), "new_articles"), ((8, 0.3, 50, 50, "a"), (5, 0.3, 50, 50, "a"), None), ((8, 0.3, 50, 50, None), (5, 0.3, 50, 50, "a"), None)],
)
def test_update_kind(spark, now, old, want):
    kinds = ("int", "double", "int", "int", "string")
    assert one(spark, scores.update_kind(*(F.lit(v).cast(k) for v, k in zip(now, kinds)), *(F.lit(v).cast(k) for v, k in zip(old, kinds)))) == want


@pytest.mark.parametrize("machine, people, want", [(0.5, 5.0, 0.8), (0.5, None, 0.5), (None, 3.0, 0.5), (None, None, None)])
def test_combined(spark, machine, people, want):
    assert one(spark, scores.combined(F.lit(machine).cast("double"), F.lit(people).cast("double"))) == (want if want is None else pytest.approx(want))


@pytest.mark.parametrize("current, flagged, total, median, want", [(0.9, 0, 20, 0.1, 0.95), (0.98, 0, 20, 0.1, 1.0), (0.9, 10, 20, 0.1, 0.5), (0.9, 3, 20, 0.1, 0.95), (0.9, 2, 50, 0.0, 0.92)])
def test_trust(spark, current, flagged, total, median, want):
    assert one(spark, scores.trust(F.lit(current), F.lit(flagged), F.lit(total), F.lit(median))) == pytest.approx(want)


@pytest.mark.parametrize(
    "url, want",
    [
        ("HTTPS://WWW.Example.org/A/b/?utm_source=x&id=3&ref=y#top", "HTTPS://www.example.org/A/b?id=3"), ("http://a.b", "http://a.b/"), ("http://a.b/?", "http://a.b/"),
        ("http://a.b/x?k=&z=1", "http://a.b/x?z=1"), ("not a url", "not a url"), (" http://a.b/c ", "http://a.b/c"), ("http://a.b/c//", "http://a.b/c"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, text.canonical_url(F.lit(url))) == want


def test_text_helpers(spark):
    assert one(spark, text.normalize_glyphs(F.lit("كتاب  علي​"))) == "کتاب علی"
    assert sorted(one(spark, text.tokens(F.lit("The cat‌sat, THE mat!")))) == ["cat", "mat", "sat", "the"]
    assert one(spark, text.quoted(F.lit("a «b c» d «e»"))) == ["b c", "e"]
    assert one(spark, text.numbers(F.lit("in 2024, ۱۲۳ and 5"))) == ["2024", "۱۲۳"]
    assert one(spark, text.persian_digits(F.lit(1305))) == "۱۳۰۵"
    assert one(spark, text.truncate(F.lit("aaaa bbbb cccc"), 12)) == "aaaa bbbb..."
    assert one(spark, text.truncate(F.lit("short"), 12)) == "short"
    assert one(spark, text.slug(F.lit("  Hello, World!  of_things "))) == "hello-world-of-things"
    assert one(spark, text.clean_post(F.lit("see [this](http://x.y) http://a.b/c @me now\n| channel"))) == "see this now"
    assert one(spark, text.urls_in(F.lit("go http://example.org/a, then (https://x.example/b)."))) == ["http://example.org/a", "https://x.example/b"]
    assert one(spark, text.first_line(F.lit("\n  \n first \nsecond"))) == "first"
    assert one(spark, text.first_line(F.lit(""))) is None
    assert one(spark, text.jaccard(F.array(F.lit("a")), F.array().cast("array<string>"))) == 0
    assert one(spark, text.overlap(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 1
    assert one(spark, text.domain(F.lit("http://www.A.b:80/x"))) == "a.b"
    assert one(spark, text.submission_hash(F.lit(" A‏  b"))) == one(spark, text.submission_hash(F.lit("a b")))


def test_cosine(spark):
    v = lambda *x: F.array(*map(F.lit, x)).cast("array<float>")
    assert one(spark, vector.cosine(v(1.0, 0.0), v(1.0, 1.0))) == pytest.approx(0.5**0.5)
    assert one(spark, vector.cosine(v(0.0, 0.0), v(1.0, 1.0))) == 0
    assert one(spark, vector.cosine(v(1.0), v(1.0, 1.0))) is None
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, None)], "k int, v array<double>")
    assert {r.k: r.centroid for r in vector.centroids(df, "k", "v").collect()} == {1: [2.0, 3.0]}


def test_similarity_joins(spark):
    import random

    from heronlake.operators import similarity

    r = random.Random(1)
    rows = [(i, [r.choice("abcdefghij") for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, t array<string>")
    got = {(x.a, x.b, x.shared) for x in similarity.shared_token_pairs(df, "k", "t", 2).collect()}
    want = {(i, j, len(set(a) & set(b))) for i, a in rows for j, b in rows if i < j and len(set(a) & set(b)) >= 2}
    assert got == want
    times = [(i, "xy"[i % 2], r.randrange(5000)) for i in range(80)]
    df = spark.createDataFrame(times, "k int, e string, s long")
    got = {(x.a, x.b) for x in similarity.band_pairs(df, "k", "e", "s", 300).collect()}
    assert got == {(i, j) for i, e, s in times for j, f, u in times if i < j and e == f and abs(s - u) <= 300}
    vecs = spark.createDataFrame([(i, [r.random() - 0.5 for _ in range(4)]) for i in range(30)], "k int, v array<double>")
    to = spark.createDataFrame([(i, [r.random() - 0.5 for _ in range(4)]) for i in range(7)], "t int, w array<double>")
    small = similarity.best_match(vecs, "k", "v", to, "t", "w", 0.1).collect()
    blocks = similarity.best_match(vecs, "k", "v", to, "t", "w", 0.1, bound=3).collect()
    assert sorted((x.k, x.t) for x in small) == sorted((x.k, x.t) for x in blocks) and small


def test_components(spark):
    from heronlake.operators.graph import components

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (None, 3), (101, 102), (102, 100)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_composition_takes_batches_bounded_by_bytes(spark):
    """However many texts a task has and however long they are, Python holds a few MB of them (F22)."""
    import pyarrow as pa

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = F.arrow_udf(lambda x: pa.array([len(x)] * len(x), pa.int32()), "int", F.ArrowUDFType.SCALAR)
    long = F.concat(F.repeat(F.lit("e\u0301🔥"), 2000), F.col("id"))
    texts = spark.range(3000, numPartitions=1).select(F.when(F.col("id") != 7, long).alias("x"), "id")
    found = texts.select("id", text.nfc(F.col("x")).alias("y"), rows("x").alias("n"))
    got = found.agg(F.max("n"), F.count("y"), F.sum((F.col("y") == F.concat(F.repeat(F.lit("é🔥"), 2000), F.col("id"))).cast("int"))).first()
    assert got[0] < 1000 and got[1:] == (2999, 2999)
