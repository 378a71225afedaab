"""Feeds, calendar, model boundaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.functions import dates, models, text
from heronlake.sources import feeds

FEED = """<?xml version="1.0"?><rss version="2.0"><channel><title>c</title>
<item><title>One</title><link>http://a.b/1/?utm_source=x</link><category> </category><category>World</category><pubDate>Wed, 31 Jan 2024 10:00:00 +0330</pubDate></item>
<item><title>One again</title><link>http://a.b/1</link><pubDate>nonsense</pubDate><updated>2024-01-30T05:00:00Z</updated></item>
<item><title> </title><link>http://a.b/2</link></item><item><title>Stored</title><link>http://a.b/3#x</link></item><item><title>No link</title></item></channel></rss>"""


def test_feed_entries_are_new_dated_and_labelled(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    entries = feeds.read_feed(spark, str(tmp_path))
    assert entries.count() == 5
    first = entries.where("title = 'One'").select(feeds.category(F.col("category")).alias("c"), feeds.published(F.col("pubDate"), F.col("updated")).alias("at")).first()
    assert first.c == "World" and first.at == dt.datetime(2024, 1, 31, 6, 30)
    again = entries.where("title = 'One again'").select(feeds.published(F.col("pubDate"), F.col("updated")).alias("at")).first()
    assert again.at == dt.datetime(2024, 1, 30, 5)
    stored = spark.createDataFrame([("http://a.b/3",)], "url string")
    fresh = feeds.new_entries(entries, stored, text.canonical_url(F.col("link")), "url")
    assert [r.title for r in fresh.collect()] == ["One"]


@pytest.mark.parametrize("day, want", [("2024-03-20", "1403-01-01"), ("2021-03-21", "1400-01-01"), ("2000-01-01", "1378-10-11"), ("2024-01-31", "1402-11-11"), ("2025-03-20", "1403-12-30"), ("2025-03-21", "1404-01-01"), ("1979-02-11", "1357-11-22")])
def test_jalali(spark, day, want):
    assert spark.range(1).select(dates.jalali(F.lit(day).cast("date")).alias("x")).first().x == want


def test_local_day(spark):
    day = spark.range(1).select(dates.local_day(F.lit("2024-01-30 20:31:00").cast("timestamp")).alias("x")).first().x
    assert day == dt.date(2024, 1, 31)


def test_provider_boundary(spark):
    df = spark.createDataFrame([(1, "a!"), (2, None), (3, " "), (4, "b")], "id int, t string")
    rows = models.apply_provider(df, "t", "e", T.ArrayType(T.FloatType()), models.stub_embedding, batch=2).collect()
    assert {r.id: r.e is None for r in rows} == {1: False, 2: True, 3: True, 4: False}
    scored = models.apply_provider(df, "t", "s", T.StringType(), models.stub_scores)
    labels = scored.select("id", F.from_json("s", "tone double, labels array<string>").alias("j")).select("id", "j.*").collect()
    assert {r.id: r.labels for r in labels if r.labels is not None} == {1: ["conflict"], 4: []}
    with pytest.raises(ValueError):
        models.apply_provider(df, "t", "id", T.StringType(), models.stub_scores)
