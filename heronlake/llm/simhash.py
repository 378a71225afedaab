"""SimHash near-duplicates through an inverted index on byte positions.

A fingerprint of 64 bits has 8 bytes.  Fingerprints that differ in at most ``BITS``
(2) bits differ in at most 2 bytes, so they share at least 6 positional bytes: the
guaranteed minimum.  A posting list for one byte would hold a 256th of all
fingerprints, and its pairs would grow with the square of the corpus; so the index
intersects lists before anything is paired:

* the 8 positions form 4 blocks of 2 bytes; a pair that shares 6 positions shares 2
  whole blocks at least, so each fingerprint is posted under the 6 pairs of blocks;
* in lists of at most ``LIGHT`` fingerprints, pairs are formed, their shared
  positional bytes tallied, pairs of fewer than 6 dropped, and the rest verified;
* longer lists (large groups of near copies) form no pairs.  Their members are posted
  again under all 28 choices of 6 positions: sharing such a list *is* reaching the
  minimum.  Verification works per list too: members name the values of the 2 free
  bytes within one bit of their own, and those that name the same value are at most 2
  bits apart; each is linked to the least one of them.  A pair at distance 2 always
  meets at the value between them, so no link is lost and rows stay linear.

Equal fingerprints are one node from the start.  Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm import resemblance
from heronlake.llm.common import chunks, few, forget, mapped, store
from heronlake.operators.graph import components

WORDS, SEED, BITS, SHARED = 3, 42, 2, 6
#: Postings of more fingerprints are intersected further instead of paired.
LIGHT = 24


def fingerprint(text: str, words: int = WORDS) -> int:
    """SimHash of a text, unsigned: bit set where over half the shingle hashes have it."""
    w = text.encode().lower().split()
    if not w:
        return 0
    shingles = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else [b" ".join(w)]
    h = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for start in range(0, len(h), 65_536):
        part = h[start : start + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """*key* and ``fp`` (the fingerprint as a signed long), one row per row of *docs*.

    Null and wordless texts have fingerprint zero; other columns are not read.
    """
    source = docs.select(F.col(key), F.col(text).alias("text"))
    schema = T.StructType([source.schema[key], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            fp = np.array([fingerprint(x, words) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], [key, "fp"])

    return mapped(source, run, schema)


def byte(fp: str, position: int) -> Column:
    """Byte *position* (0: the highest) of a long."""
    return F.shiftrightunsigned(F.col(fp), 56 - 8 * position).bitwiseAND(F.lit(255))


def mask(positions: tuple[int, ...]) -> int:
    m = sum(255 << (56 - 8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def postings(nodes: DataFrame, choices: list[tuple[int, ...]]) -> DataFrame:
    """``fp`` under each choice of positions: ``slot`` says which, ``posting`` holds their bytes."""
    lists = [F.struct(F.lit(i).alias("slot"), F.col("fp").bitwiseAND(F.lit(mask(c))).alias("posting")) for i, c in enumerate(choices)]
    return nodes.select("fp", F.explode(F.array(*lists)).alias("p")).select("fp", "p.slot", "p.posting")


BLOCK_PAIRS = [(2 * a, 2 * a + 1, 2 * b, 2 * b + 1) for a, b in combinations(range(4), 2)]
SIX_OF_EIGHT = list(combinations(range(8), SHARED))


def links(nodes: DataFrame) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints *nodes* (``fp``), enough to connect
    all that a chain of steps of at most two bits connects."""
    first = postings(nodes, BLOCK_PAIRS)
    sizes = first.groupBy("slot", "posting").agg(F.count("*").alias("n")).where("n > 1")
    # members of lists of one are nearly all rows: they end here
    held = store(first.join(few(store(sizes, "posting-sizes")), ["slot", "posting"]), "postings")

    light = held.where(F.col("n") <= LIGHT)
    pairs = light.alias("l").join(light.alias("r"), ["slot", "posting"]).where("l.fp < r.fp").select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))
    tally = sum((byte("a", p) == byte("b", p)).cast("int") for p in range(8))
    paired = pairs.where(tally >= SHARED).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)

    heavy = postings(held.where(F.col("n") > LIGHT).select("fp").distinct(), SIX_OF_EIGHT)
    flips = [[1 << (56 - 8 * p + i) for p in range(8) if p not in c for i in range(8)] for c in SIX_OF_EIGHT]
    signed = [[x - (1 << 64) if x >> 63 else x for x in row] for row in flips]
    named = heavy.withColumn("flips", F.element_at(F.array(*(F.array(F.lit(0).cast("long"), *(F.lit(x).cast("long") for x in row)) for row in signed)), F.col("slot") + 1))
    named = named.select("fp", "slot", F.explode("flips").alias("flip")).select("fp", "slot", F.col("fp").bitwiseXOR(F.col("flip")).alias("meet"))
    least = store(named.groupBy("slot", "meet").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n"), "meets")
    starred = named.join(least, ["slot", "meet"]).where("fp <> a").select("a", F.col("fp").alias("b"))
    return paired.unionByName(starred).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """*key*, ``fp``, ``component_id``: the least key among all documents that a chain of
    fingerprints, each within two bits of the next, connects with this one.

    One row per row of *docs*; null texts count as empty, texts without words link with
    each other, null keys are never a component's id unless it has no other.
    """
    prints = store(fingerprints(docs, key, text), "fingerprints")
    nodes = store(prints.groupBy("fp").agg(F.min(key).alias("first")), "nodes")
    joined = components(links(nodes.select("fp")))
    rooted = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = store(rooted, "rooted")
    low = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = store(rooted.join(low, "root").select("fp", "component_id"), "classes")
    out = prints.join(classes, "fp").select(key, "fp", "component_id")
    forget(rooted)
    return out


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """*docs* with one row of each group of near-duplicates: that of the least key, of
    repeated keys the first in the table.  Columns stay as they are, whatever their names.

    Documents are linked by fingerprints (:func:`near_duplicates`) and by a similarity of
    0.8 of their five-word shingles (:mod:`heronlake.llm.resemblance`).  Rows are numbered
    once and stored: how files are dealt out to tasks may differ from read to read.
    """
    row = "_heron_row"
    while row in docs.columns:
        row += "_"
    numbered = store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    texts = numbered.select(F.col(row).alias("row"), F.col(text).alias("text"))
    prints = store(fingerprints(texts, "row"), "fingerprints")
    nodes = store(prints.groupBy("fp").agg(F.min("row").alias("first")), "nodes")
    # equal fingerprints meet at their first row, near ones through their first rows
    same = prints.join(nodes, "fp").where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    first_of = lambda end: nodes.select(F.col("fp").alias(end), F.col("first").alias(f"row_{end}"))
    near = links(nodes.select("fp")).join(first_of("a"), "a").join(first_of("b"), "b").select(F.col("row_a").alias("a"), F.col("row_b").alias("b"))
    joined = components(same.unionByName(near).unionByName(resemblance.links(texts)))
    rank = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), F.col(row).alias("at"))
    member = store(numbered.select(F.col(row).alias("node"), rank.alias("k")).join(joined, "node").select("root", "k"), "members")
    first = member.groupBy("root").agg(F.min("k").alias("first"))
    losers = store(member.join(first, "root").where("k <> first").select(F.col("k.at").alias(row)), "losers")
    forget(prints, nodes, member)
    return numbered.join(few(losers), row, "left_anti").drop(row)
