"""Matching of new rows to existing groups: emerging groups, an ordered chain of gates, links of posts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronlake.functions import text, vector
from heronlake.operators import blocks, similarity, vector_index
from heronlake.operators.graph import components
from heronlake.sources.storage import store


def sharing(rows: DataFrame, group: str, key: str, tokens: str, least: float) -> DataFrame:
    """Values of *group* in which two rows' token sets have a Jaccard of *least* or more.

    Sets that overlap so much share one of each other's first (rarest) tokens: all but the
    last ceil(*least* * size) - 1.  Within a group only rows that share such a token meet.
    """
    sets = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), F.array_distinct(tokens).alias("s")).where(F.size("s") > 0)
    cells = sets.select("g", "k", F.explode("s").alias("token"))
    ranked = cells.join(cells.groupBy("g", "token").agg(F.count("*").alias("df")), ["g", "token"]).where("df > 1")
    # tokens of one row only can't be shared, but they count in its size
    ordered = ranked.groupBy("g", "k").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o")).join(sets, ["g", "k"])
    first = F.size("o") - F.greatest(F.lit(0), F.ceil(least * F.size("s") - 1e-9).cast("int") - 1)
    prefix = ordered.where(first > 0).select("g", "k", "s", F.explode(F.slice("o", F.lit(1), first)).alias("c")).select("g", "k", "s", "c.token")
    met = prefix.alias("x").join(prefix.alias("y"), ["g", "token"]).where("x.k < y.k")
    return met.where(text.jaccard(F.col("x.s"), F.col("y.s")) >= least).select(F.col("g").alias(group)).distinct()


def emerging(rows: DataFrame, cosine: float = 0.65, jaccard: float = 0.35) -> DataFrame:
    """``article_id`` and ``component`` of the rows that form a group of their own.

    *rows* has ``article_id``, ``embedding``, ``tokens``, ``quotes``, ``numbers`` and ``theatres``.
    Vectors with a cosine of *cosine* or more link, unless both name theatres and none in
    common; a component stays if two of its rows share a quotation, a number or enough tokens.

    Rows of equal vectors and theatres link the same others and one another, so only the
    least of them meets others.
    """
    solid = rows.where(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v) > 0.01)
    solid = store(solid.select("article_id", "embedding", "tokens", "quotes", "numbers", F.array_sort("theatres").alias("theatres")), "emerging-rows")
    alike = solid.groupBy("embedding", "theatres").agg(F.min("article_id").alias("first"))
    same = solid.join(alike, ["embedding", "theatres"]).where("article_id <> first").select(F.col("first").alias("a"), F.col("article_id").alias("b"))
    alike = store(alike, "emerging-vectors")
    side = lambda x: alike.select(F.col("first").alias(x), F.col("theatres").alias(f"t{x}"))
    near = vector_index.near_pairs(alike, "first", "embedding", cosine).join(side("a"), "a").join(side("b"), "b").where(~text.conflict(F.col("ta"), F.col("tb"))).select("a", "b")
    root = store(components(near.unionByName(same)), "emerging-components")
    member = solid.join(root.withColumnRenamed("node", "article_id").withColumnRenamed("root", "component"), "article_id")
    said = lambda c: member.select("component", "article_id", F.explode(F.array_distinct(c)).alias("v")).groupBy("component", "v").agg(F.count("*").alias("n")).where("n > 1").select("component")
    kept = said("quotes").unionByName(said("numbers")).unionByName(sharing(member, "component", "article_id", "tokens", jaccard)).distinct()
    return member.join(kept, "component", "left_semi").select("article_id", "component")


@dataclass(frozen=True)
class Gates:
    """Thresholds of the matcher; times in days."""

    reject: float = 0.63
    reject_age: float = 7
    auto: float = 0.85
    auto_age: float = 2
    auto_jaccard: float = 0.35
    small: float = 0.45
    small_count: int = 10
    small_jaccard: float = 0.15
    fresh: float = 0.40
    aged: float = 0.55
    aged_age: float = 2
    near_freeze: float = 0.65
    near_freeze_age: float = 5
    generic: float = 0.15


def generic_tokens(groups: DataFrame, tokens: str, share: float) -> DataFrame:
    """One row with the array ``generic`` of the tokens that *share* of *groups* hold.

    Token sets have few members, so there are at most their mean size / *share* of these.
    """
    n = groups.agg(F.count("*").alias("n"))
    df = groups.select(F.explode(F.array_distinct(tokens)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return df.join(F.broadcast(n)).where(F.col("df") >= share * F.col("n")).agg(F.collect_list("token").alias("generic"))


def judged(pair: dict[str, Column], gates: Gates) -> Column:
    """``auto``, ``candidate`` or null for a pair of row and group that isn't rejected by memory.

    *pair* has score, age, count, trust, the theatres, tokens, quotes and numbers of both
    (a_ and b_) and the generic tokens.  Gates in order: score or age, theatres, automatic
    match, tier, shared anchor.
    """
    score, age = pair["score"], pair["age"]
    factor = 1 / F.greatest(pair["trust"], F.lit(0.5))
    overlap = text.jaccard(pair["a_tokens"], pair["b_tokens"])
    concrete = F.arrays_overlap(pair["a_quotes"], pair["b_quotes"]) | F.arrays_overlap(pair["a_numbers"], pair["b_numbers"])
    small = pair["count"] < gates.small_count
    tier = F.when(small, gates.small).when(age >= gates.near_freeze_age, gates.near_freeze).when(age > gates.aged_age, gates.aged).otherwise(gates.fresh)
    special = F.array_except(F.array_intersect(pair["a_tokens"], pair["b_tokens"]), pair["generic"])
    anchor = F.when(small, overlap >= gates.small_jaccard).otherwise(F.size(special) > 0) | concrete
    return (
        F.when((score < gates.reject) | (age > gates.reject_age) | text.conflict(pair["a_theatres"], pair["b_theatres"]), None)
        .when((score >= F.least(gates.auto * factor, F.lit(0.99))) & (age <= gates.auto_age) & ((overlap >= gates.auto_jaccard) | concrete), "auto")
        .when((score >= F.least(tier * factor, F.lit(0.95))) & anchor, "candidate")
    )


SIGNALS = ("tokens", "quotes", "numbers", "theatres")


def matched(rows: DataFrame, groups: DataFrame, rejected: DataFrame, reserved: DataFrame, gates: Gates | None = None) -> DataFrame:
    """One row per row of *rows*: ``article_id``, ``decision``, ``story_id`` and ``candidates``.

    *rows* has ``article_id``, ``embedding``, ``trust`` and the SIGNALS; *groups* has ``story_id``,
    ``centroid``, ``age`` (days since the last article), ``article_count`` and the SIGNALS;
    *rejected* has pairs that readers have refused, *reserved* the rows of emerging groups.
    Groups are tried from the youngest on and the first automatic match ends the search;
    without one, what passes the tiers is left to confirm, in that order (``candidates``).

    Only pairs within the rejecting cosine are ever made (:mod:`heronlake.operators.vector_index`).
    """
    gates = gates or Gates()
    free = rows.join(reserved.select("article_id"), "article_id", "left_anti")
    near = vector_index.near(free, "article_id", "embedding", groups, "story_id", "centroid", gates.reject)
    near = near.select(F.col("a").alias("article_id"), F.col("b").alias("story_id"), "score").join(rejected.select("article_id", "story_id"), ["article_id", "story_id"], "left_anti")
    side = lambda df, key, name, *more: df.select(key, *more, *(F.col(s).alias(f"{name}_{s}") for s in SIGNALS))
    pairs = near.join(side(free, "article_id", "a", "trust"), "article_id").join(side(groups, "story_id", "b", "age", "article_count"), "story_id").join(F.broadcast(generic_tokens(groups, "tokens", gates.generic)))
    known = {c: F.col(c) for c in ("score", "age", "trust", "generic", *(f"{x}_{s}" for x in "ab" for s in SIGNALS))} | {"count": F.col("article_count")}
    verdict = pairs.select("article_id", "story_id", "age", judged(known, gates).alias("v")).where("v IS NOT NULL")
    order = F.struct("age", "story_id")
    found = verdict.groupBy("article_id").agg(F.min(F.when(F.col("v") == "auto", order)).alias("auto"), F.array_sort(F.collect_list(F.when(F.col("v") == "candidate", order))).alias("some"))
    out = rows.select("article_id", "embedding").join(reserved.select("article_id", F.lit(True).alias("reserved")), "article_id", "left").join(found, "article_id", "left")
    usable = F.coalesce(F.size("embedding") > 0, F.lit(False)) & F.coalesce(F.exists("embedding", lambda x: x != 0), F.lit(False))
    decision = F.when(F.col("reserved"), "reserved").when(~usable, "no vector").when(F.col("auto").isNotNull(), "auto").when(F.size("some") > 0, "candidates").otherwise("new")
    return out.select("article_id", decision.alias("decision"), F.col("auto.story_id").alias("story_id"), F.when(decision == "candidates", F.transform("some", lambda s: s["story_id"])).otherwise(F.array()).alias("candidates"))


def best_targets(posts: DataFrame, stories: DataFrame, members: DataFrame, least: float, block: int | None = None) -> DataFrame:
    """``post``, ``story_id``, ``score`` and ``via`` (centroid or member) of each post's best story (ties: least id), if it scores *least* or more.

    A story's score is the greater of its centroid's cosine and its best member's; at equal
    cosines the centroid counts.  *posts* has ``post`` and ``vec``, *stories* ``story_id`` and ``vec``,
    *members* ``story_id`` and ``vec`` of any number of members.  Posts meet targets in blocks, and one row for a post leaves a task.
    """
    sound = F.col("vec").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x))
    row = lambda k, story, centre: [F.col(k).cast("long").alias("k"), F.size("vec").cast("long").alias("cell"), F.col("vec").cast("array<double>").alias("v"), story.cast("long").alias("story"), F.lit(centre).alias("centre")]
    asked = posts.where(sound & F.col("post").isNotNull()).select(*row("post", F.lit(0), 0))
    own = F.col("story_id")
    targets = stories.where(sound).select(*row("story_id", own, 1)).unionByName(members.where(sound).select(*row("story_id", own, 0)))
    # keys only deal rows into blocks: members of a story may lie in several
    targets = targets.withColumn("k", F.xxhash64("k", "v"))

    def run(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        y = y.sort_by([("story", "ascending"), ("centre", "descending")])
        v, keys = blocks.Angles(x.column("v"), y.column("v")), blocks.keys_of(x)
        story, centre = (np.asarray(blocks.whole(y.column(c))) for c in ("story", "centre"))
        for lo, hi in blocks.tiles(x, y):
            s = v.cosines(lo, hi)
            i, j = np.nonzero(s >= np.maximum(s.max(axis=1, keepdims=True), least) - blocks.EDGE)
            score = v.exact(lo + i, j)
            order = np.lexsort((j, -score, i))
            order = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
            order = order[score[order] >= least]
            yield pa.RecordBatch.from_arrays([pa.array(z) for z in (keys[lo + i[order]], story[j[order]], score[order], centre[j[order]])], ["post", "story_id", "score", "centre"])

    met = blocks.meet(asked, targets, run, "post long, story_id long, score double, centre int", block)
    best = met.groupBy("post").agg(F.max(F.struct("score", -F.col("story_id"), "centre", "story_id")).alias("m"))
    return best.select("post", "m.story_id", "m.score", F.when(F.col("m.centre") == 1, "centroid").otherwise("member").alias("via"))


def linked(posts: DataFrame, addresses: DataFrame, stories: DataFrame, members: DataFrame, threshold: float = 0.35, aged: float = 0.10, aged_days: float = 2, rescue: float = 0.50, broad: int = 12) -> DataFrame:
    """One row per row of *posts*: ``post``, ``story_id``, ``way`` and ``score``.

    First the first cited address that *addresses* (``url``, ``story_id``) knows, as it stands or by host and
    path; then the best story by vector (:func:`best_targets`; ties: least id), if it reaches
    *threshold*, *aged* more if it is older than *aged_days*; by a member only from
    *rescue* on, and only of stories with at most *broad* members in *members*.

    *posts* has ``post``, ``vec`` and ``urls`` (array); *stories* has ``story_id``, ``vec`` and ``age``.
    """
    known = addresses.where("url IS NOT NULL AND story_id IS NOT NULL")
    exact = known.groupBy("url").agg(F.min("story_id").alias("story_id"))
    path = known.select(text.host_path(F.col("url")).alias("url"), "story_id").groupBy("url").agg(F.min("story_id").alias("story_id"))
    cited = store(posts.select("post", F.posexplode("urls").alias("i", "url")), "cited")
    hits = cited.join(exact, "url").select("post", "i", F.lit(0).alias("how"), "story_id").unionByName(cited.withColumn("url", text.host_path(F.col("url"))).join(path, "url").select("post", "i", F.lit(1).alias("how"), "story_id"))
    by_url = store(hits.groupBy("post").agg(F.min_by("story_id", F.struct("i", "how")).alias("story_id")), "by-url")
    narrow = members.groupBy("story_id").agg(F.count("*").alias("n")).where(F.col("n") <= broad).select("story_id")
    left = posts.join(by_url, "post", "left_anti")
    best = best_targets(left, stories, members.join(narrow, "story_id", "left_semi"), threshold).join(stories.select("story_id", "age"), "story_id")
    floor = F.lit(threshold) + F.when(F.col("age") > aged_days, aged).otherwise(0.0)
    floor = F.when(F.col("via") == "member", F.greatest(floor, F.lit(rescue))).otherwise(floor)
    by_vector = best.where(F.col("score") >= floor).select("post", "story_id", F.when(F.col("via") == "member", "rescue").otherwise("vector").alias("way"), "score")
    found = by_url.select("post", "story_id", F.lit("url").alias("way"), F.lit(None).cast("double").alias("score")).unionByName(by_vector)
    return posts.select("post").join(found, "post", "left").select("post", "story_id", F.coalesce("way", F.lit("none")).alias("way"), "score")


def reassigned(posts: DataFrame, stories: DataFrame, members: DataFrame, gap: float = 0.08, least: float = 0.40) -> DataFrame:
    """``post``, ``story_id``, ``to_story`` and ``gain``: posts that fit another story better by *gap*, and by *least* at all.

    *posts* has ``post``, ``vec`` and ``story_id``; a post's own story's score is 0 if the story isn't in *stories*.
    """
    best = best_targets(posts, stories, members, least).select("post", F.col("story_id").alias("to_story"), "score")
    moved = store(best.join(posts.select("post", "vec", "story_id"), "post").where("to_story <> story_id"), "fitting-elsewhere")
    own = stories.select("story_id", F.col("vec").alias("t")).unionByName(members.join(stories.select("story_id"), "story_id", "left_semi").select("story_id", F.col("vec").alias("t")))
    current = moved.join(own, "story_id").groupBy("post").agg(F.max(vector.cosine(F.col("vec").cast("array<double>"), F.col("t").cast("array<double>"))).alias("own"))
    both = moved.join(current, "post", "left").withColumn("gain", F.col("score") - F.greatest(F.coalesce("own", F.lit(0.0)), F.lit(0.0)))
    return both.where(F.col("gain") >= gap).select("post", "story_id", "to_story", "gain")


def shifted(moves: DataFrame) -> DataFrame:
    """``story_id`` and ``change`` of the stories whose number of posts changes with *moves*: their cached analysis is stale."""
    ends = F.explode(F.array(F.struct(F.col("story_id"), F.lit(-1).alias("d")), F.struct(F.col("to_story").alias("story_id"), F.lit(1).alias("d")))).alias("e")
    return moves.select(ends).groupBy("e.story_id").agg(F.sum("e.d").alias("change")).where("change <> 0")


def rehomed(orphans: DataFrame, rejected: DataFrame, stories: DataFrame, least: float = 0.40) -> DataFrame:
    """``article_id``, ``story_id`` and ``score``: articles that readers took out of a story with the nearest story that nobody
    rejected for them (ties: least id); null where none reaches *least*.

    *orphans* has ``article_id`` and ``vec``, *rejected* pairs of ``article_id`` and ``story_id``, *stories* ``story_id`` and ``vec``.
    """
    near = vector_index.near(orphans, "article_id", "vec", stories, "story_id", "vec", least).select(F.col("a").alias("article_id"), F.col("b").alias("story_id"), "score")
    allowed = near.join(rejected.select("article_id", "story_id").distinct(), ["article_id", "story_id"], "left_anti")
    best = allowed.groupBy("article_id").agg(F.max(F.struct("score", -F.col("story_id"), "story_id")).alias("m"))
    return orphans.select("article_id").join(best, "article_id", "left").select("article_id", "m.story_id", "m.score")


def merged_labels(groups: DataFrame, stories: DataFrame, overlap: float = 0.5) -> DataFrame:
    """One row per group of equal labels: ``label``, ``fate`` (merged, new or single) and ``into``, the title of the story it joins.

    *groups* has ``label`` (lower case, not empty), ``place`` (whole, distinct) and ``n`` articles, *stories* ``place`` (distinct,
    below all groups') and ``title``.  As if groups came one after another: a group joins the first story (by place) whose title holds
    its label, is held by it, or shares over *overlap* of the shorter one's words; a group of two or more that joins none becomes a story,
    placed behind all others, which later groups may join.

    Pairs meet on words and on the rarest three letters of the shorter text, never all with all.  A group is decided once
    all stories before it that it could join are: the rounds are as many as the longest chain of such groups.
    """
    titles = stories.select("place", F.lower("title").alias("text"), F.lit(2).alias("n"), F.lit(False).alias("group")).unionByName(groups.select("place", F.col("label").alias("text"), "n", F.lit(True).alias("group")))
    texts = store(titles.where("text <> ''"), "label-texts")
    words = F.array_distinct(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    grams = F.when(F.length("text") >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("text") - 2), lambda i: F.substring(F.col("text"), i, F.lit(3))))).otherwise(F.array("text"))
    held = texts.select("place", F.explode(grams).alias("g"))
    rarest = held.join(held.groupBy("g").agg(F.count("*").alias("df")), "g").groupBy("place").agg(F.min_by("g", F.struct("df", "g")).alias("g"))
    # the shorter text's rarest letters occur in the longer one; texts under three letters are looked for in all grams
    short = rarest.where(F.length("g") < 3).select(F.col("place").alias("s"), "g")
    longer = held.select(F.col("place").alias("l"), "g")
    meet = lambda x, y, by: similarity.meetings(x, y, by).select("x", "y")
    inside = meet(rarest.where(F.length("g") >= 3).select(F.col("place").alias("x"), "g"), longer.withColumnRenamed("l", "y"), "g").toDF("s", "l")
    pieces = longer.select("l", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.length("g")), lambda i: F.array(F.substring(F.col("g"), i, F.lit(1)), F.substring(F.col("g"), i, F.lit(2)))))).alias("g")).distinct()
    inside = inside.unionByName(meet(short.withColumnRenamed("s", "x"), pieces.withColumnRenamed("l", "y"), "g").toDF("s", "l"))
    said = texts.select("place", F.explode(words).alias("w"))
    shared = meet(said.withColumnRenamed("place", "x"), said.withColumnRenamed("place", "y"), "w").where("x < y").toDF("a", "b")
    met = inside.select(F.least("s", "l").alias("a"), F.greatest("s", "l").alias("b")).where("a < b").unionByName(shared).distinct()
    side = lambda x: texts.select(F.col("place").alias(x), F.col("text").alias(f"t{x}"), words.alias(f"w{x}"), F.col("n").alias(f"n{x}"), F.col("group").alias(f"g{x}"))
    pair = met.join(side("a"), "a").join(side("b").where("gb"), "b").where("NOT ga OR na >= 2")
    alike = F.col("ta").contains(F.col("tb")) | F.col("tb").contains(F.col("ta")) | (F.size(F.array_intersect("wa", "wb")) > overlap * F.least(F.size("wa"), F.size("wb")))
    edges = store(pair.where(alike).select("a", "b", "ga"), "label-edges")

    open_ = groups.select(F.col("place").alias("b"), "n")
    done = None
    story = stories.select(F.col("place").alias("a"))
    while True:
        # the first earlier text that is a story, and the first that is still open
        state = edges.join(story.withColumn("is", F.lit(True)), "a", "left").join(open_.select(F.col("b").alias("a"), F.lit(True).alias("wait")), "a", "left")
        first = state.groupBy("b").agg(F.min(F.when(F.col("is"), F.col("a"))).alias("into"), F.min(F.when(F.col("wait"), F.col("a"))).alias("wait"))
        now = store(open_.join(first, "b", "left"), "label-round")
        sure = now.where("wait IS NULL OR coalesce(into < wait, false)").select("b", F.when(F.col("into").isNotNull(), "merged").when(F.col("n") >= 2, "new").otherwise("single").alias("fate"), "into")
        done = sure if done is None else done.unionByName(sure)
        story = store(story.unionByName(sure.where("fate = 'new'").select(F.col("b").alias("a"))), "label-stories")
        open_ = now.where("wait IS NOT NULL AND NOT coalesce(into < wait, false)").select("b", "n")
        if open_.isEmpty():
            joined = done.join(texts.select(F.col("place").alias("into"), F.col("text").alias("title")), "into", "left")
            return groups.join(joined.withColumnRenamed("b", "place"), "place").select("label", "fate", F.col("title").alias("into"))
