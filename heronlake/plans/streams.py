"""Streaming queries; each ends with what the batch query gives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.plans.registry import query
from heronlake.sources.adapters import Tables
from heronlake.sources.sink import KeyedTable
from heronlake.sources.storage import new_path
from heronlake.streaming import events, replay, state


@query("T1 T5", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_events(t: Tables) -> DataFrame:
    out = events.run(events.windowed(events.event_stream(t.spark, t.sf_dir), "1 day", None), "tumbling", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("T6", "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS start FROM events) GROUP BY ALL")
def sliding_events(t: Tables) -> DataFrame:
    out = events.run(events.windowed(events.event_stream(t.spark, t.sf_dir), "2 days", "1 day"), "sliding", "complete")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("T7", "SELECT date_trunc('week', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def weekly_events(t: Tables) -> DataFrame:
    """Weeks that begin on Monday."""
    s = events.event_stream(t.spark, t.sf_dir).withWatermark("ts", "7 days")
    g = s.groupBy(F.window("ts", "7 days", None, "4 days").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
    return events.run(g, "weekly", "complete").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("T8", """
, e AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events WHERE event_type = 'signup')
, s AS (SELECT user_id, ts, sum(CASE WHEN before IS NULL OR ts - before >= INTERVAL 2 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS part FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, part""")
def session_events(t: Tables) -> DataFrame:
    out = events.run(events.sessions(events.event_stream(t.spark, t.sf_dir).where("event_type = 'signup'"), "2 days"), "sessions", "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("T3 T9", "SELECT event_type, count(DISTINCT (user_id, event_type)) AS n FROM events GROUP BY event_type")
def stream_dedup(t: Tables) -> DataFrame:
    """The first event per user and type, counted by type."""
    out = events.run(events.first_of_each(events.event_stream(t.spark, t.sf_dir), ["user_id", "event_type"]), "dedup", "append")
    return out.groupBy("event_type").agg(F.count("*").alias("n"))


@query("T2 S12", "SELECT user_id, max(event_id) AS high_water, count(*) AS n FROM events GROUP BY user_id")
def high_water_marks(t: Tables) -> DataFrame:
    """Offsets per channel after the stream has run."""
    g = events.event_stream(t.spark, t.sf_dir).groupBy("user_id").agg(F.max("event_id").alias("high_water"), F.count("*").alias("n"))
    return events.run(g, "high-water", "complete")


#: Events come in files of eight days, one a micro-batch.
PART_SQL = ", e AS (SELECT *, (day(ts) - 1) // 8 AS part, epoch_us(ts) AS us FROM events)\n"
PARTS = range(4)


def dated(t: Tables) -> DataFrame:
    e = t["events"].withColumn("ts", F.col("ts").cast("timestamp"))
    return e.withColumns({"at": F.unix_micros("ts"), "part": F.floor((F.dayofmonth("ts") - 1) / 8)})


@query("T3 S13 S2", PART_SQL + "SELECT user_id || ' ' || event_type AS key, min_by(event_id, (part, event_id)) AS event_id FROM e GROUP BY ALL")
def exactly_once(t: Tables) -> DataFrame:
    """The first event per user and type, from four micro-batches with a restart between: each batch enters the table once."""
    e = dated(t).withColumn("key", F.concat_ws(" ", "user_id", "event_type"))
    folder, log = new_path(t.spark, "once-in"), new_path(t.spark, "once-log")
    table = KeyedTable(t.spark, "key string, event_id long", "key")
    for some in (PARTS[:2], PARTS[2:]):
        replay.deal(e, F.col("part"), some, folder)
        replay.drain(replay.source(t.spark, e, folder), replay.once_into(table, "first", "event_id"), log)
    return table.read()


@query("T1 T4", PART_SQL + """
, l AS (SELECT *, part + CASE WHEN event_type = 'error' THEN 2 ELSE 0 END AS come FROM e), m AS (SELECT come, max(ts) AS top FROM l GROUP BY come)
, k AS (SELECT l.*, date_trunc('day', ts) + INTERVAL 1 DAY > coalesce((SELECT max(top) FROM m WHERE m.come < l.come - 1), TIMESTAMP '1970-01-01') - INTERVAL 2 DAY AS timely FROM l)
SELECT date_trunc('day', ts) AS start, event_type, count(*) FILTER (timely) AS n, count(*) FILTER (NOT timely) AS late FROM k GROUP BY ALL""")
def late_windows(t: Tables) -> DataFrame:
    """Counts by day and type with a watermark of two days, and how many rows came too late: errors arrive two files after the rest.

    A batch's late rows are judged by the watermark that the batch before ran with.
    """
    e = dated(t).withColumn("come", F.col("part") + F.when(F.col("event_type") == "error", 2).otherwise(0))
    folder = new_path(t.spark, "late-in")
    replay.deal(e, F.col("come"), range(6), folder)
    counts = replay.source(t.spark, e, folder).withWatermark("ts", "2 days").groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    latest = replay.Latest(t.spark, "late")
    replay.drain(counts.select(F.col("w.start").alias("start"), "event_type", "n"), latest.each, new_path(t.spark, "late-log"), "update")
    all_ = e.groupBy(F.date_trunc("day", "ts").alias("start"), "event_type").agg(F.count("*").alias("all"))
    both = all_.join(latest.read(["start", "event_type"], ["n"]), ["start", "event_type"], "left")
    return both.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", F.coalesce("n", F.lit(0)).alias("n"), (F.col("all") - F.coalesce("n", F.lit(0))).alias("late"))


def keyed_states(t: Tables, kind: type, types: tuple[str, ...]) -> DataFrame:
    """The state of each user after all events of *types*, with timers up to an hour before the last one."""
    e = dated(t).where(F.col("event_type").isin(*types)).withColumn("failed", F.col("event_type") == "error")
    folder, latest = new_path(t.spark, "state-in"), replay.Latest(t.spark, "state")
    replay.deal(e, F.col("part"), PARTS, folder)
    with state.rocksdb(t.spark):
        kept = state.kept(replay.source(t.spark, e, folder).withWatermark("ts", "1 hour"), kind, "user_id", "at", "failed")
        replay.drain(kept, latest.each, new_path(t.spark, "state-log"), "update")
    order = [F.expr("attempts"), F.expr("due")] if kind is state.Retry else [F.expr("offered"), F.expr("frozen"), F.expr("archived"), F.expr("-priority")]
    return latest.read(["user_id"], order)


@query("T12", PART_SQL + """
, x AS (SELECT user_id, us, event_type = 'error' AS failed, row_number() OVER (PARTITION BY user_id ORDER BY part, us, event_id) AS i FROM e WHERE event_type IN ('error', 'signup'))
, w AS (SELECT max(us) - 3600000000 AS w FROM x)
, go(user_id, i, attempts, last, due) AS (SELECT DISTINCT user_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, true FROM x
  UNION ALL SELECT g.user_id, x.i, CASE WHEN NOT g.failed THEN 0 WHEN ready THEN attempts + 1 ELSE attempts END, CASE WHEN NOT g.failed THEN 0 WHEN ready THEN g.us ELSE last END, NOT g.failed AND true
   FROM (SELECT g.*, x.us, x.failed, x.i AS xi, due OR (attempts < 3 AND x.us >= last + 86400000000) AS ready FROM go g JOIN x ON x.user_id = g.user_id AND x.i = g.i + 1) g JOIN x ON x.user_id = g.user_id AND x.i = xi)
SELECT user_id, attempts, last, due OR (attempts < 3 AND w >= last + 86400000000) AS due FROM go JOIN w ON true QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def retry_states(t: Tables) -> DataFrame:
    """Failed work per user as keyed state: attempts, the last one, and whether it is due again (a timer after a day)."""
    return keyed_states(t, state.Retry, ("error", "signup")).select("user_id", "attempts", "last", "due")


@query("T10 T11 M41", PART_SQL + """
, x AS (SELECT user_id, us, event_id, lead(us) OVER u AS nxt, lag(us, 3) OVER u AS third, row_number() OVER u AS i, first_value(us) OVER u AS first FROM e WHERE event_type = 'signup' WINDOW u AS (PARTITION BY user_id ORDER BY part, us, event_id))
, g AS (SELECT user_id, min(first) AS first, max(us) AS last, greatest(max(us), (SELECT max(us) FROM x) - 3600000000) AS now_, count(*) AS offered, least(101, count(*) FILTER (us < first + 604800000000)) AS taken, least(min(first) + 604800000000, coalesce(min(us) FILTER (i = 101), 9000000000000000)) AS froze FROM x GROUP BY user_id)
, d AS (SELECT x.user_id, greatest(us + 172800000000, froze) AS down, nxt, now_ FROM x JOIN g USING (user_id)), dm AS (SELECT user_id, max(down) AS down FROM d WHERE down <= now_ AND (nxt IS NULL OR nxt >= down) GROUP BY user_id)
, up AS (SELECT user_id, max(us) AS up FROM x WHERE third IS NOT NULL AND us - third <= 172800000000 GROUP BY user_id)
, ar AS (SELECT x.user_id, min(us + 864000000000) AS archived FROM x JOIN g USING (user_id) WHERE us + 864000000000 <= now_ AND (nxt IS NULL OR nxt >= us + 864000000000) GROUP BY x.user_id)
SELECT user_id, taken, offered, CASE WHEN froze <= now_ THEN froze ELSE 0 END AS frozen, coalesce(archived, 0) AS archived, CASE WHEN down IS NOT NULL AND (up IS NULL OR up < down) THEN -50 ELSE 0 END AS priority FROM g LEFT JOIN dm USING (user_id) LEFT JOIN up USING (user_id) LEFT JOIN ar USING (user_id)""")
def story_lives(t: Tables) -> DataFrame:
    """Stories (a user's sign-ups) as keyed state: frozen after a week, demoted when quiet, promoted by a burst, archived; timers bring what no row brings."""
    return keyed_states(t, state.Life, ("signup",)).select("user_id", "taken", "offered", "frozen", "archived", "priority")
