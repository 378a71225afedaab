"""The keyed sink under failures, micro-batches with restarts, and states with timers."""

import random
from collections import defaultdict
from dataclasses import astuple

import pytest
from pyspark.sql import functions as F

from heronlake.functions import content
from heronlake.plans import landing
from heronlake.sources.sink import KeyedTable
from heronlake.sources.storage import new_path
from heronlake.streaming import replay, state
from heronlake.streaming.state import DAY, HOUR, Life, Retry


def rows(spark, data):
    return spark.createDataFrame(data, "key string, n long")


def test_first_row_of_a_key_stays(spark):
    table = KeyedTable(spark, "key string, n long", "key")
    assert table.read().count() == 0
    assert table.insert(rows(spark, [("a", 3), ("a", 1), ("b", 2), (None, 9)]), "one", "n") == {"rows": 4, "keyed": 3, "new": 2}
    assert table.insert(rows(spark, [("a", 0), ("c", 5)]), "two", "n") == {"rows": 2, "keyed": 2, "new": 1}
    assert table.insert(rows(spark, [("z", 0)]), "two", "n") == {"rows": 2, "keyed": 2, "new": 1}  # whole already
    assert sorted(map(tuple, table.read().collect())) == [("a", 1), ("b", 2), ("c", 5)]
    assert table.insert(rows(spark, []), "three") == {"rows": 0, "keyed": 0, "new": 0}


def test_a_batch_that_died_is_invisible_and_written_anew(spark, monkeypatch):
    table = KeyedTable(spark, "key string, n long", "key")

    def die(*_):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(table, "publish", die)
    with pytest.raises(RuntimeError):
        table.insert(rows(spark, [("a", 1)]), "one")
    assert table.read().count() == 0 and table.batches() == []
    monkeypatch.undo()
    table.insert(rows(spark, [("a", 2)]), "one")
    assert [tuple(r) for r in table.read().collect()] == [("a", 2)]


def test_a_stream_killed_between_data_and_ledger_counts_once(spark):
    data = [(f"k{i % 7}", i) for i in range(40)]
    df = rows(spark, data)
    folder, log = new_path(spark, "in"), new_path(spark, "log")
    replay.deal(df, df["n"] % 4, range(4), folder)
    table, calls = KeyedTable(spark, "key string, n long", "key"), []

    def each(batch, number):
        calls.append(number)
        if number == 2 and calls.count(2) == 1:
            batch.select("key", "n").write.mode("overwrite").parquet(f"{table.path}/data/s-{number:09d}")
            raise RuntimeError("killed")
        replay.once_into(table, "s", "n")(batch, number)

    from pyspark.errors import StreamingQueryException

    with pytest.raises(StreamingQueryException):
        replay.drain(replay.source(spark, df, folder), each, log)
    replay.drain(replay.source(spark, df, folder), each, log)
    want = {}
    for part in range(4):
        for key, n in data:
            if n % 4 == part:
                want.setdefault(key, []).append((part, n))
    assert {r.key: r.n for r in table.read().collect()} == {k: min(v)[1] for k, v in want.items()}
    assert table.read().count() == 7 and calls.count(2) == 2


def test_retry_rests_and_gives_up():
    r = Retry()
    for at in (1, 2, DAY, 1 + DAY, 3 + 2 * DAY, 4 + 9 * DAY):
        r.row(at, True)
    assert (r.attempts, r.last, r.due) == (3, 3 + 2 * DAY, False) and r.deadline() is None
    r.row(5 + 9 * DAY, False)
    assert (r.attempts, r.due) == (0, True)


def test_life_is_the_same_by_rows_or_by_timers():
    draw = random.Random(4)
    for _ in range(200):
        times = sorted(draw.randrange(1, 40 * DAY) for _ in range(draw.randint(1, 30)))
        plain, timed = Life(), Life()
        for t in times:
            plain.row(t)
            while (d := timed.deadline()) is not None and timed.first and d <= t:
                timed.advance(d)
            timed.row(t)
            assert plain == timed
        end = times[-1] + 3 * DAY + HOUR
        plain.advance(end)
        while (d := timed.deadline()) is not None and d <= end:
            timed.advance(d)
        assert plain == timed


def test_life_by_hand():
    s = Life()
    for t in (1, 2, 3):
        s.row(t * HOUR)
    assert (s.taken, s.frozen, s.priority) == (3, 0, 0)
    s.advance(HOUR + 7 * DAY)
    assert (s.frozen, s.priority) == (HOUR + 7 * DAY, -50)
    for t in (1, 2, 3, 4):
        s.row(8 * DAY + t * HOUR)
    assert (s.taken, s.offered, s.priority) == (3, 7, 0)
    s.advance(30 * DAY)
    assert (s.priority, s.archived) == (-50, 18 * DAY + 4 * HOUR)
    many = Life()
    for t in range(1, 120):
        many.row(t)
    assert (many.taken, many.offered, many.frozen) == (101, 119, 101)


def test_list_links(spark):
    html = '<ul><li><a class="x" href="/a/1"><b>First  long title</b></a><a href="/a/1">Second long title</a><a href="http://o.example/z">Other long title</a><a href="/s">short</a><a href="">No address here</a></ul>'
    df = spark.createDataFrame([("s", "https://s.example", 0, html), ("s", "https://s.example", 1, None)], "source_id string, base string, page long, html string")
    got = sorted((r.url, r.title) for r in landing.list_links(df).collect())
    assert got == [("http://o.example/z", "Other long title"), ("https://s.example/a/1", "First long title")]


@pytest.mark.parametrize(
    "title, body, url, category, label",
    [
        ("یادداشت/ متن", "", "", "", "opinion"), ("مسعود پزشکیان یادداشت تفاهم را امضا کرد", "", "", "", None), ("ورزشگاه آزادی", "", "", "", None), ("ورزش: برد", "", "", "", "off_topic"), ("ایران ۲-۲ نیوزیلند", "", "", "", "off_topic"), ("ماده ۵-۳ قانون", "", "", "", None),
        ("تیم ملی فوتبال و ویزا", "", "", "", None), ("x", "", "https://s.example/opinion/1", "sport", "off_topic"), ("x", "", "https://s.example/opinion/1", "", "opinion"), ("x", "", "", "Interview", "discussion"), ("x", "به گزارش a به نقل از b", "", "", "aggregation"), ("x", "وزیر اعلام کرد", "", "", "news"),
        ("x", "«" + "a" * 400 + "»", "", "", "aggregation"), (None, None, None, None, None), ("x", "y" * 5000, "https://bbc.co.uk/persian/live/1", "", "aggregation"), ("x", "y" * 4999, "https://bbc.co.uk/persian/live/1", "", None),
    ],
)
def test_content_kinds(spark, title, body, url, category, label):
    df = spark.createDataFrame([(title, body, url, category)], "t string, b string, u string, c string")
    found = df.select(content.kind(df.t, df.b, df.u, df.c).alias("k")).first().k
    assert (found and found.label) == label


@pytest.mark.parametrize("kind", [Retry, Life])
def test_states_of_a_block_are_those_of_its_keys(kind):
    """Rows and deadlines of many keys, taken together, bring each key what it gets alone."""
    draw = random.Random(8)
    alone, block = {}, defaultdict(kind)
    for batch in range(5):
        rows = sorted((draw.randrange(8 * DAY) + batch * 8 * DAY + 1, draw.choice([None, -3, 7, 2**62 + 1]), draw.random() < 0.7) for _ in range(draw.randint(0, 20)))
        for at, key, bad in rows:
            alone.setdefault(key, kind()).row(at, bad)
        assert set(state.come(block, [k for _, k, _ in rows], [t for t, _, _ in rows], [b for _, _, b in rows])) == {k for _, k, _ in rows}
        now = batch * 8 * DAY + HOUR
        before = {k: astuple(s) for k, s in block.items()}
        changed = state.passed(block, now)
        assert all(s.deadline() is None or s.deadline() > now for s in block.values())
        assert {k for k, s in block.items() if astuple(s) != before[k]} <= set(changed)
    end = 60 * DAY
    for s in alone.values():
        s.advance(end)
    state.passed(block, end)
    assert dict(block) == alone


@pytest.mark.parametrize("type_, keys", [("long", [-257, -1, 0, 255, 256, 2**62 + 1, 2**62 + 2, None]), ("string", ["a", "b", None])])
def test_stream_of_states_by_blocks(spark, type_, keys):
    draw = random.Random(2)
    data = [(draw.choice(keys), i, (p * 8 * DAY + draw.randrange(1, 8 * DAY)), draw.random() < 0.6, p) for p in range(2) for i in range(60)]
    e = spark.createDataFrame(data, f"user_id {type_}, event_id long, at long, failed boolean, part long").withColumn("ts", F.timestamp_micros("at"))
    folder, latest = new_path(spark, "blocks-in"), replay.Latest(spark, "blocks")
    replay.deal(e, e["part"], range(2), folder)
    with state.rocksdb(spark):
        kept = state.kept(replay.source(spark, e, folder).withWatermark("ts", "1 hour"), Retry, "user_id", "at", "failed")
        replay.drain(kept, latest.each, new_path(spark, "blocks-log"), "update")
    want = defaultdict(Retry)
    for key, _, at, bad, _ in sorted(data, key=lambda r: (r[4], r[2], r[1])):
        want[key].row(at, bad)
    for s in want.values():
        s.advance(max(r[2] for r in data) // 1000 * 1000 - HOUR)
    found = {r.user_id: (r.attempts, r.last, r.due) for r in latest.read(["user_id"], [F.expr("attempts"), F.expr("due")]).collect()}
    assert found == {k: astuple(s) for k, s in want.items()}
