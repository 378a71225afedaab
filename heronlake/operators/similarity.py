"""Similarity joins without cross joins: by shared tokens, by time band, against a bounded side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.functions import vector
from heronlake.operators import vector_index
from heronlake.sources.storage import store


#: Rows of a value that meet in one block, on either side, and pairs of one task.
SIDE, PAIRS = 1024, 1 << 21


def meetings(left: DataFrame, right: DataFrame, *by: str) -> DataFrame:
    """Rows of *left* (``x`` and *by*) and *right* (``y`` and *by*) that are equal in *by*: the inner join.

    The pairs of a value are as many as the product of its rows, whatever its bytes: so lists are counted first, long ones
    are cut into blocks of SIDE that meet each other, and blocks are dealt to a task per PAIRS pairs.
    """
    left, right = store(left, "meeting-left"), store(right, "meeting-right")
    n = left.groupBy(*by).agg(F.count("*").alias("_l")).join(right.groupBy(*by).agg(F.count("*").alias("_r")), [*by])
    n = store(n, "meeting-counts")
    tasks = n.agg(F.coalesce(F.sum(F.col("_l").cast("double") * F.col("_r")), F.lit(0.0))).first()[0] // PAIRS + 1
    parts = lambda c: F.ceil(F.col(c) / SIDE).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    place = lambda k, c: F.pmod(F.xxhash64(k), parts(c)).cast("int")
    rest = lambda df, k: [c for c in df.columns if c not in (k, *by)]
    a = left.join(n, [*by]).select(*by, "x", *rest(left, "x"), place("x", "_l").alias("_i"), spread("_r").alias("_j"))
    b = right.join(n, [*by]).select(*by, "y", *rest(right, "y"), place("y", "_r").alias("_j"), spread("_l").alias("_i"))
    keys = [*by, "_i", "_j"]
    # a stated number of partitions, which isn't reduced to fit the bytes read
    tasks = int(max(tasks, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return a.repartition(tasks, *keys).hint("shuffle_hash").join(b.repartition(tasks, *keys), keys).drop("_i", "_j")


def shared_token_pairs(df: DataFrame, key: str, tokens: str, least: int = 2) -> DataFrame:
    """Pairs ``a`` < ``b`` of *key* whose token sets share *least* or more, with ``shared``.

    Tokens of a row are ordered by rarity; two sets that share *least* tokens meet in the
    prefixes that leave out each set's *least* - 1 most frequent tokens, so only prefixes
    are joined.  Pairs are verified on whole sets.
    """
    rows = df.select(F.col(key).alias("k"), F.array_distinct(tokens).alias("set")).where(F.size("set") >= least)
    cells = rows.select("k", F.explode("set").alias("token"))
    ranked = cells.join(cells.groupBy("token").agg(F.count("*").alias("df")), "token")
    ordered = ranked.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
    prefix = ordered.select("k", F.explode(F.slice("o", F.lit(1), F.size("o") - (least - 1))).alias("c")).select("k", "c.token")
    prefix = store(prefix, "prefixes")
    pairs = meetings(prefix.select(F.col("k").alias("x"), "token"), prefix.select(F.col("k").alias("y"), "token"), "token").where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()
    both = pairs.join(rows.select(F.col("k").alias("a"), F.col("set").alias("sa")), "a").join(rows.select(F.col("k").alias("b"), F.col("set").alias("sb")), "b")
    return both.select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("shared")).where(F.col("shared") >= least)


def shared_pair_links(df: DataFrame, key: str, tokens: str) -> DataFrame:
    """Links ``a``, ``b`` that connect the keys whose token sets share two tokens or more, directly or through others.

    Two sets share two tokens if they hold the same pair of tokens, and all that hold a pair are linked to the least of them: links
    are at most the pairs of tokens within sets (titles hold few), not the pairs of rows.
    """
    sets = df.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(tokens)).alias("w")).where(F.size("w") >= 2)
    first = sets.select("k", "w", F.posexplode("w").alias("i", "x"))
    held = first.select("k", "x", F.explode(F.slice("w", F.col("i") + 2, F.size("w"))).alias("y"))
    held = store(held, "token-pairs")
    least = held.groupBy("x", "y").agg(F.min("k").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return held.join(least, ["x", "y"]).where("k <> b").select(F.col("k").alias("a"), "b").distinct()


def band_pairs(df: DataFrame, key: str, equal: str, seconds: str, within: int) -> DataFrame:
    """Pairs ``a`` < ``b`` with the same *equal* whose *seconds* (long) differ by at most *within*.

    Times fall into buckets of the band's width; each row meets its own bucket and the next.
    """
    rows = df.select(F.col(key).alias("k"), F.col(equal).alias("e"), F.col(seconds).alias("s")).withColumn("bucket", F.floor(F.col("s") / within))
    left = rows.select(F.col("k").alias("x"), "e", F.col("s").alias("sx"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    right = rows.select(F.col("k").alias("y"), "e", F.col("s").alias("sy"), "bucket")
    # in one bucket keep one order; to the next bucket every pair comes once
    met = meetings(left, right, "e", "bucket").where((F.abs(F.col("sx") - F.col("sy")) <= within) & (F.col("x") != F.col("y")))
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def scored_blocks(rows: DataFrame, vec: str, targets: DataFrame, target: str, target_vec: str, bound: int = 10_000) -> list[DataFrame]:
    """*rows* with *target* and ``score`` (cosine) for every target, one table per block of targets.

    The targets are a stated set, counted first: up to *bound* of them are broadcast, more
    are met in blocks of about *bound*, so no more than a block is ever held.
    """
    targets = store(targets.select(target, target_vec), "targets")
    blocks = max(1, -(-targets.count() // bound))
    out = []
    for block in range(blocks):
        some = targets if blocks == 1 else targets.where(F.pmod(F.xxhash64(target), F.lit(blocks)) == block)
        met = rows.join(F.broadcast(some.select(F.col(target).alias("_t"), F.col(target_vec).alias("_v"))))
        out.append(met.withColumn("score", vector.cosine(F.col(vec), F.col("_v"))).drop("_v").withColumnRenamed("_t", target))
    return out


def scored(rows: DataFrame, key: str, vec: str, targets: DataFrame, target: str, target_vec: str, least: float, bound: int = 10_000) -> DataFrame:
    """*key*, *target* and ``score`` of the pairs with a cosine of *least* or more.

    Up to *bound* targets, counted first, are broadcast; with more of them rows meet only the cells
    that can hold such a target (:mod:`heronlake.operators.vector_index`).
    """
    targets = store(targets.select(target, target_vec), "targets")
    if targets.count() > bound:
        return vector_index.near(rows, key, vec, targets, target, target_vec, least).select(F.col("a").alias(key), F.col("b").alias(target), "score")
    met = rows.select(key, vec).join(F.broadcast(targets.select(F.col(target).alias("_t"), F.col(target_vec).alias("_v"))))
    return met.select(key, F.col("_t").alias(target), vector.cosine(F.col(vec), F.col("_v")).alias("score")).where(F.col("score") >= least)


def best_match(rows: DataFrame, key: str, vec: str, targets: DataFrame, target: str, target_vec: str, least: float, bound: int = 10_000) -> DataFrame:
    """*key*, *target*, ``score``: the target of greatest cosine, if it is *least* or more (ties: least target)."""
    found = scored(rows, key, vec, targets, target, target_vec, least, bound)
    return found.groupBy(key).agg(F.max(F.struct("score", -F.col(target), F.col(target))).alias("m")).select(key, F.col(f"m.{target}").alias(target), "m.score")


def placed(wishes: DataFrame, key: str, target: str, score: str, capacity: int) -> DataFrame:
    """*key*, *target*: each key in the target it likes best of those with room left, as if keys
    came one after another in their order.

    Deferred acceptance: each round every unplaced key asks its best target that hasn't turned
    it away, and each target holds on to the *capacity* first keys that ever asked it.  Targets
    agree on the order of keys, so this is the result of the serial rule, in rounds that run on
    all keys at once (their number is bounded by the targets' number, not the keys').
    """
    best = Window.partitionBy(key).orderBy(F.desc(score), target)
    ranked = store(wishes.select(key, target, F.row_number().over(best).alias("_k")), "wishes")
    held = ranked.where("_k = 1")
    while True:
        first = Window.partitionBy(target).orderBy(key)
        asked = store(held.withColumn("_p", F.row_number().over(first)), "asked")
        gone = asked.where(F.col("_p") > capacity)
        if gone.isEmpty():
            return asked.select(key, target)
        onward = gone.select(key, (F.col("_k") + 1).alias("_k")).join(ranked, [key, "_k"])
        held = asked.where(F.col("_p") <= capacity).drop("_p").unionByName(onward.select(key, target, "_k"))
