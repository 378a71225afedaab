"""Links between texts that share at least 0.8 of their five-word shingles.

Such texts differ in about ten of the 64 bits of a SimHash, so no number of shared bytes is
guaranteed and the index of :mod:`heronlake.llm.simhash` can't find them.  This module puts
the same steps (positional bytes, lists intersected before pairing, count filter,
verification) on bytes that do have a minimum: byte p of a sketch is drawn from the least
shingle hash under salt p, so two texts share a byte with the probability of their
similarity.

* texts of equal shingle sets are one node from the start;
* the 64 bytes form 16 blocks of 4; nodes are posted under each block.  Texts of similarity
  0.8 share a block with probability 1 - (1 - 0.8^4)^16 = 0.9998;
* in lists of at most ``LIGHT`` nodes all pairs are candidates.  Nodes of longer lists are
  posted again under the 120 pairs of blocks, where texts are alike in 8 bytes: there, lists
  of more than ``PAIRED`` nodes give each node one candidate, the member whose hash is the
  least.  The lists of a group of near copies have the same few such members, so the group is
  linked by rows that stay linear in its size;
* candidates of fewer than ``MATCHES`` shared positional bytes are dropped (similarity 0.8
  has 51 of 64 on average; fewer than 38 once in 50,000), the rest verified exactly: first
  one candidate per node, then those that two steps of such links don't connect;
* a long list of the first posting that these links don't connect (a crowd of texts a
  little below 0.8, whose stars are rejected) is finished exactly: its nodes meet under
  their rarest shingles, as many as two texts of the least similarity can't both lack,
  bounded by length and place (:func:`crowded`).  Only texts that no chain connects are compared;
  long lists are split over tasks.

No list is capped.  The shares above are probabilities, not promises; a pair that shares a
long list of one block is found for certain (but for equal 64-bit hashes within a text).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import chunks, few, forget, mapped, store
from heronlake.operators.graph import components

WORDS, SIMILARITY, SEED = 5, 0.8, 42
#: Positional bytes of a sketch, bytes of a block, shared bytes that a candidate needs.
POSITIONS, BLOCK, MATCHES = 64, 4, 38
#: Lists of more nodes are intersected further instead of paired; of those, lists up to PAIRED are paired.
LIGHT, PAIRED = 24, 4
#: Posted members of a shingle's list that one task compares with the rest of the list.
SPLIT = 1024
#: Shingles before one under which two texts meet that are looked at for an earlier meeting.
BEFORE = 16
_SALTS = np.random.default_rng(SEED).integers(1 << 63, size=(2, POSITIONS), dtype=np.uint64) | np.uint64(1)


def shingles(text: str, words: int = WORDS) -> set[bytes]:
    """Runs of *words* words, A-Z lower-cased (fewer words: the whole sequence; none: no shingle)."""
    w = text.encode().lower().split()
    if len(w) < words:
        return {b" ".join(w)} if w else set()
    return set(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))


def sketch(text: str, words: int = WORDS) -> tuple[bytes, bytes, int] | tuple[None, None, int]:
    """Digest of the set of shingles, its positional bytes and its size; (None, None, 0) without words."""
    found = shingles(text, words)
    if not found:
        return None, None, 0
    h = np.sort(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in found), np.uint64, len(found)))
    least = np.full(POSITIONS, ~np.uint64(0))
    with np.errstate(over="ignore"):
        for start in range(0, len(h), 4096):
            np.minimum(least, (h[start : start + 4096, None] * _SALTS[0] + _SALTS[1]).min(axis=0), out=least)
        drawn = ((least * _SALTS[1][0]) >> np.uint64(56)).astype(np.uint8)
    return xxhash.xxh128_digest(h.tobytes()), drawn.tobytes(), len(found)


def sketches(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """``row``, ``digest``, ``sketch`` (positional bytes, eight to a long) and ``size`` (distinct shingles) of *rows* (``row`` long, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            digest, drawn, size = zip(*(sketch(x, words) for x in texts), strict=True)
            longs = [d and np.frombuffer(d, ">i8").astype(np.int64) for d in drawn]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(digest, pa.binary()), pa.array(longs, pa.list_(pa.int64())), pa.array(size, pa.int64())], ["row", "digest", "sketch", "size"])

    return mapped(rows.select("row", "text"), run, "row long, digest binary, sketch array<long>, size long")


def postings(nodes: DataFrame, per_list: int) -> DataFrame:
    """``node`` under each choice of *per_list* blocks (``posting``) that another node shares,
    with the size ``n`` of that list and its member of the least hash, ``star``."""
    # a block with its number before it: equal only at the same place
    block = lambda i: F.shiftrightunsigned(F.col("sketch")[i // 2], 32 * (1 - i % 2)).bitwiseAND(F.lit((1 << 32) - 1)) + F.lit(i << 32)
    choices = combinations(range(POSITIONS // BLOCK), per_list)
    lists = [block(*c) if per_list == 1 else F.xxhash64(*map(block, c)) for c in choices]
    posted = nodes.select("node", F.explode(F.array(*lists)).alias("posting"))
    sizes = posted.groupBy("posting").agg(F.count("*").alias("n"), F.min_by("node", F.xxhash64("node")).alias("star")).where("n > 1")
    # lists of one are nearly all: they end here
    held = store(sizes, "block-sizes")
    out = store(posted.join(few(held), "posting"), "block-postings")
    forget(held)
    return out


def paired(lists: DataFrame) -> DataFrame:
    return lists.alias("l").join(lists.alias("r"), "posting").where("l.node < r.node").select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))


def candidates(nodes: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a`` < ``b`` of *nodes* (``node``, ``sketch``, ``size``) that share enough positional bytes and
    are near enough in size, and the long lists (``posting``, ``node``), not all of whose pairs were formed."""
    first = postings(nodes, 1)
    long = first.where(F.col("n") > LIGHT).select("posting", "node")
    heavy = nodes.join(long.select("node").distinct(), "node")
    second = postings(heavy, 2)
    starred = second.where((F.col("n") > PAIRED) & (F.col("node") != F.col("star"))).select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b"))
    pairs = paired(first.where(F.col("n") <= LIGHT)).unionByName(paired(second.where(F.col("n") <= PAIRED))).unionByName(starred).distinct()
    side = lambda name: nodes.select(F.col("node").alias(name), F.col("sketch").alias(f"of_{name}"), F.col("size").alias(f"size_{name}"))
    near = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * similarity - 1e-9
    same = [F.col("of_a")[i].bitwiseXOR(F.col("of_b")[i]) for i in range(POSITIONS // 8)]
    tally = sum((F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int") for x in same for i in range(8))
    return store(pairs.join(side("a"), "a").join(side("b"), "b").where(near & (tally >= MATCHES)).select("a", "b"), "candidates"), long


def unconnected(long: DataFrame, roots: DataFrame) -> DataFrame:
    """``node``, ``root`` of the members of lists (``posting``, ``node``) of more than one root."""
    placed = long.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("posting").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("posting")
    return store(placed.join(several, "posting").select("node", "root").distinct(), "crowd")


def grams(texts: DataFrame, words: int) -> DataFrame:
    """``node``, ``root``, ``size`` (distinct shingles) and one of their hashes ``h``, of *texts* (``node``, ``root``, ``text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in chunks(batches, "text", 300_000):
            h = [np.unique(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles(x, words)), np.uint64)) for x in some]
            n = np.array([len(x) for x in h], np.int64)
            node, root = (np.repeat(part.column(i).to_numpy(), n) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, root, np.repeat(n, n), np.concatenate(h).view(np.int64))], ["node", "root", "size", "h"])

    return mapped(texts.select("node", "root", "text"), run, "node long, root long, size long, h long")


def crowded(crowd: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Pairs ``a`` < ``b`` of *crowd* (``node``, ``root``) of different roots, among them all that
    are similar enough.

    Texts x and y, y not the longer, share at least s / (1 + s) (|x| + |y|) shingles, so in
    any common order the first shared one is among the first |x| - s |x| + 1 of x and the
    first |y| - 2 s / (1 + s) |y| + 1 of y.  The order is by how many texts of the crowd hold
    a shingle.  y is posted under its part, x asks with its own, and as many shingles as the
    pair has to share must follow in both.
    """
    share, slack = similarity / (1 + similarity), 1e-9
    held = store(grams(texts.withColumnRenamed("row", "node").join(crowd, "node"), words), "grams")
    shared = held.join(store(held.groupBy("h").agg(F.count("*").alias("c")).where("c > 1"), "gram-counts"), "h")
    # shingles of one text come first in the order and meet nothing: they only take places
    ordered = shared.groupBy("node", "root", "size").agg(F.array_sort(F.collect_list(F.struct("c", "h"))).alias("grams"))
    ordered = ordered.withColumn("alone", F.col("size") - F.size("grams"))
    asks = (F.col("size") - F.ceil(F.col("size") * similarity - slack) + 1 - F.col("alone")).cast("int")
    marks = ordered.select("node", "root", "size", "alone", "grams", F.posexplode(F.slice("grams", F.lit(1), F.greatest(asks, F.lit(0)))).alias("at", "g"))
    some = F.slice("grams", F.greatest(F.lit(1), F.col("at") - (BEFORE - 1)), F.least(F.col("at"), F.lit(BEFORE)))
    marks = marks.withColumn("before", F.transform(some, lambda g: g["h"]))
    # rest: shingles from this one on; before: those just before it
    marks = marks.select("node", "root", "size", (F.col("size") - F.col("alone") - F.col("at")).alias("rest"), "g.h", "before")
    marks = store(marks.withColumn("posted", F.col("rest") >= F.ceil(F.col("size") * 2 * share - slack)), "marks")
    lists = marks.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count_if("posted").alias("n")).where("lo <> hi AND n > 0")
    lists = store(lists.select("h", F.ceil(F.col("n") / SPLIT).cast("int").alias("parts")), "gram-lists")
    listed = marks.join(lists, "h")
    posted = listed.where("posted").withColumn("part", F.pmod(F.xxhash64("root"), "parts").cast("int"))
    asking = listed.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # roots meet before their members, so that a list is not paired within one root
    only = F.when(F.count("*") == 1, F.first("before")).otherwise(F.array().cast("array<long>")).alias("before")
    extent = lambda x: x.groupBy("h", "part", "root").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.max("rest").alias("rest"), only)
    y, x = extent(posted).alias("y"), extent(asking).alias("x")
    near = (F.col("y.root") != F.col("x.root")) & (F.col("y.most") >= F.col("x.least") * similarity - slack)
    near &= F.least("y.rest", "x.rest") >= (F.col("y.least") + F.col("x.least")) * share - slack
    # two single texts that share a shingle just before this one have met there
    met = y.join(x, ["h", "part"]).where(near & ~F.arrays_overlap("y.before", "x.before")).select("h", "part", F.col("y.root").alias("of_y"), F.col("x.root").alias("of_x"))
    side = lambda rows, name: rows.select("h", "part", F.col("root").alias(f"of_{name}"), *(F.col(c).alias(f"{c}_{name}") for c in ("node", "size", "rest", "before")))
    pairs = met.join(side(posted, "y"), ["h", "part", "of_y"]).join(side(asking, "x"), ["h", "part", "of_x"])
    pairs = pairs.where(F.struct("size_y", "node_y") < F.struct("size_x", "node_x")).where(F.col("size_y") >= F.col("size_x") * similarity - slack)
    pairs = pairs.where(F.least("rest_y", "rest_x") >= (F.col("size_y") + F.col("size_x")) * share - slack)
    pairs = pairs.where(~F.arrays_overlap("before_y", "before_x"))
    return pairs.select(F.least("node_y", "node_x").alias("a"), F.greatest("node_y", "node_x").alias("b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """The *pairs* whose texts (``row``, ``text``) are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = shingles(x.as_py() or "", words), shingles(y.as_py() or "", words)
                both = len(x & y)
                alike.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    side = lambda name: texts.select(F.col("row").alias(name), F.col("text").alias(f"of_{name}"))
    # few pairs find their first text where it lies; ``b`` has few partners, ``a`` may be the star of a large group
    whole = side("b").join(few(pairs), "b").join(side("a"), "a").select("a", "b", "of_a", "of_b")
    return store(mapped(whole, run, "a long, b long"), "verified")


def links(rows: DataFrame, words: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Edges ``a``, ``b`` that connect *rows* (``row``: unique long, ``text``) of similar texts.

    Texts without words (empty, null) have no link here; repeated texts link to the first.
    *rows* is read twice and has to be the same each time, as a stored table is.
    """
    held = store(sketches(rows, words), "sketches")
    nodes = store(held.where("sketch IS NOT NULL").groupBy("digest").agg(F.min("row").alias("node"), F.first("sketch").alias("sketch"), F.first("size").alias("size")), "sketch-nodes")
    same = held.join(nodes.select("digest", "node"), "digest").where("row <> node").select(F.col("row").alias("a"), F.col("node").alias("b"))
    found, long = candidates(nodes, similarity)
    # texts of candidates and long lists only: most texts have none
    ends = store(found.select(F.explode(F.array("a", "b")).alias("row")).unionByName(long.select(F.col("node").alias("row"))).distinct(), "ends")
    texts = store(rows.select("row", "text").join(few(ends), "row"), "candidate-texts")
    tried = store(found.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "tried")
    near = verified(tried, texts, words, similarity)
    # a node's first similar text, or that one's: what this leaves apart is tried pair by pair
    up = near.select(F.col("b").alias("node"), F.col("a").alias("root"))
    roots = store(up.join(up.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root")), "near-roots")
    root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    apart = found.join(tried, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    apart = store(apart.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "apart")
    near = near.unionByName(verified(apart, texts, words, similarity))
    forget(tried, roots, apart, ends)
    if not long.isEmpty():
        grouped = store(components(near), "crowd-roots")
        crowd = unconnected(long, grouped)
        if not crowd.isEmpty():
            pairs = store(crowded(crowd, texts, words, similarity), "crowd-pairs")
            near = near.unionByName(verified(pairs, texts, words, similarity))
            forget(pairs)
        forget(grouped, crowd)
    forget(found, texts)
    return same.unionByName(near)
