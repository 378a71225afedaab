"""Language-model scoring with a log-frequency Bloom filter.

Counts are quantised to levels, ``1 + floor(log2 count)``, and an n-gram of level q is
entered once for each level 1..q.  A count is read by probing level after level until a
membership probe fails; the levels passed give the quantised count back.

* n-grams are the tokens of the training texts and their pairs, *all* of them, by 64-bit
  hash (equal hashes count as one n-gram);
* the filter has ``BITS_PER_ENTRY`` bits for each entry, so it grows with the corpus.  It is
  made of blocks of ``BLOCK`` bits; a key's probes, of whatever level, fall into one block, so
  blocks are filled by the tasks that hold their keys;
* a filter of at most ``BROADCAST_BYTES`` is broadcast in parts.  A larger one stays a table: texts are
  cut into chunks, whose distinct keys go to the regions of the filter that hold them, eight bytes
  each; one byte comes back for each, its level, to where the chunk's tokens, as numbers of its
  distinct words, have gone.  Texts stay where they are, and take turns.  Both ways probe the same bits, so scores
  don't depend on the way;
* *head*: the most frequent words, at most ``HEAD``, broadcast with exact counts for the exact
  base score.  Words that the filter doesn't hold have count 0; the few others get their
  exact count by a join.  The model's score takes counts from the filter alone.

The model: P(w) = (c(w) + 1) / (N + V + 1), and P(w | v) = (c(v w) + MU P(w)) / (c(v) + MU),
all counts as read from the filter (the middle of their level).  A text starts after an
"end".  The score is the sum of log10 P(w | v) over words and end.

Null texts are empty (one token, the end); repeated rows are scored alike; with no training
rows every count is 0.  Only key and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import BATCH_BYTES, chunks, forget, mapped, store, tidy

HEAD, MU = 1 << 19, 200.0
#: Bits of a block, a power of two of at most 2^21: a 64-bit hash gives PROBES places in it.
BLOCK, PROBES = 1 << 18, 3
#: With PROBES probes, about 3 % of absent entries seem present.
BITS_PER_ENTRY = 8
BROADCAST_BYTES, PART = 128 << 20, 8 << 20
#: Tokens that a task holds before it counts them.
FLUSH = 1_000_000
#: Bits of a region, the part of a large filter that one task holds, and keys that it probes at once.
REGION, PROBED = 1 << 24, 1 << 18
#: Turns in which texts ask a large filter, so that a fourth of their keys is on disk at a time.
TURNS = 4
END = xxhash.xxh64_intdigest(b"")


def level(count: np.ndarray) -> np.ndarray:
    return np.frexp(np.maximum(count, 0).astype(float))[1]


def middle(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for: the middle of the counts that have it; 0 for level 0."""
    return np.where(levels > 0, (3 * 2.0 ** (levels - 1) - 1) / 2, 0.0)


def mix(key: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of integers (multiply and shift rounds)."""
    with np.errstate(over="ignore"):
        x = key.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all tokens on end, keys of the pairs that each ends, and the texts' numbers of tokens."""
    flat, sizes = [], []
    for x in texts:
        w = x.encode().lower().split()
        flat += w
        flat.append(b"")
        sizes.append(len(w) + 1)
    word = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat))
    return word.view(np.int64), pair_keys(np.concatenate([[np.uint64(END)], word[:-1]]), word), np.array(sizes, np.int64)


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mix(mix(first, 1) ^ second, 2).view(np.int64)


def positions(key: np.ndarray, at: int, block: int) -> np.ndarray:
    """The bits of keys entered at a level, in their block of *block* bits: one row per key."""
    h, width = mix(key, 2 + at), block.bit_length() - 1
    return np.stack([(h >> np.uint64(width * i)) & np.uint64(block - 1) for i in range(PROBES)], axis=1).astype(np.int64)


def read_levels(data: np.ndarray, start: np.ndarray, key: np.ndarray, block: int) -> np.ndarray:
    """Highest level up to which all probes of each key succeed; *start*: first bit of its block in *data* (bytes)."""
    out, alive, at = np.zeros(len(key), np.int64), np.arange(len(key)), 1
    while len(alive) and at < 64:
        bit = positions(key[alive], at, block) + start[alive, None]
        alive = alive[(data[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).all(axis=1)]
        out[alive] = at
        at += 1
    return out


@dataclass
class LogBloom:
    """A broadcast filter, in parts of PART bytes, so that no more than one is held twice while it is sent."""

    parts: list[Broadcast]
    blocks: int
    block: int  # bits

    def level(self, key: np.ndarray) -> np.ndarray:
        at, out = key % self.blocks, np.zeros(len(key), np.int64)
        per = max(1, 8 * PART // self.block)
        for i, part in enumerate(self.parts):
            here = np.flatnonzero(at // per == i)
            out[here] = read_levels(part.value, at[here] % per * self.block, key[here], self.block)
        return out


@dataclass
class Head:
    """The most frequent words: sorted keys and their counts; sizes of the whole training text."""

    key: np.ndarray
    count: np.ndarray
    total: int  # N
    distinct: int  # V

    def exact(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of words, and whether the word is in the head."""
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        here = self.key[at] == key
        return np.where(here, self.count[at], 0), here


def ngram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` (or else a pair), ``key``, ``n``: how often each n-gram occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            for i in (0, 1):
                key, n = np.unique(np.concatenate([x[i] for x in held]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"word": pa.array(np.full(len(key), i == 0)), "key": pa.array(key), "n": pa.array(n.astype(np.int64))})
            held.clear()

        for _, texts in chunks(batches, "text"):
            held.append(keys(texts)[:2])
            if sum(len(x[0]) for x in held) > FLUSH:
                yield from out()
        if held:
            yield from out()

    return mapped(docs.select(F.col(text).alias("text")), run, "word boolean, key long, n long").groupBy("word", "key").agg(F.sum("n").alias("n"))


def head_of(words: DataFrame, most: int = HEAD) -> Head:
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    # how many words have a count (exact up to 4096, by power of two beyond): at most 4200 rows
    size = F.when(F.col("n") <= 4096, F.col("n")).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n"))).cast("long"))
    histogram = sorted(words.groupBy(size.alias("at")).agg(F.count("*").alias("n")).collect(), reverse=True)
    least, held = (histogram[0].at + 1 if histogram else 1), 0
    for row in histogram:
        if held + row.n > most:
            break
        least, held = row.at, held + row.n
    rows = words.where(F.col("n") >= least).select("key", "n").toArrow()
    key, n = (rows.column(i).to_numpy() for i in (0, 1))
    order = np.argsort(key)
    return Head(key[order], n[order], total, distinct)


def filter_blocks(counts: DataFrame, blocks: int, size: int) -> DataFrame:
    """``block``, ``bytes``: the filter of rows ``key``, ``n`` in blocks of *size* bits; blocks without entries are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[int, int] = {}
        data = np.zeros((16, size // 8), np.uint8)
        for batch in batches:
            block, key, n = (batch.column(i).to_numpy() for i in range(3))
            here, back = np.unique(block, return_inverse=True)
            rows = np.array([index.setdefault(b, len(index)) for b in here.tolist()], np.int64)
            while len(index) > len(data):
                data = np.concatenate([data, np.zeros_like(data)])
            start, top, flat = rows[back] * size, level(n), data.reshape(-1)
            for at in range(1, int(top.max(initial=0)) + 1):
                some = top >= at
                bit = (positions(key[some], at, size) + start[some, None]).ravel()
                np.bitwise_or.at(flat, bit >> 3, (1 << (bit & 7)).astype(np.uint8))
        for block, row in index.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "bytes": pa.array([data[row].tobytes()], pa.binary())})

    return mapped(counts.select(F.pmod("key", F.lit(blocks)).alias("block"), "key", "n").repartition("block"), run, "block long, bytes binary")


@dataclass
class Model:
    head: Broadcast
    words: DataFrame  # key, n
    blocks: int
    block: int  # bits
    table: DataFrame  # block, bytes
    bloom: LogBloom | None  # None: too large to broadcast


def fit(docs: DataFrame, text: str = "text", head: int = HEAD, broadcast_bytes: int = BROADCAST_BYTES, block: int = BLOCK) -> Model:
    """Count all of *docs* and build the filter."""
    spark = docs.sparkSession
    with tidy(spark):
        counts = store(ngram_counts(docs, text), "ngram-counts")
        entries = counts.agg(F.coalesce(F.sum(F.floor(F.log2("n")) + 1), F.lit(0))).first()[0]
        blocks = max(1, -(-entries * BITS_PER_ENTRY // block))
        table = store(filter_blocks(counts, blocks, block), "filter")
        words = store(counts.where("word").select("key", "n"), "word-counts")
    forget(counts)
    bloom = None
    if blocks * block // 8 <= broadcast_bytes:
        per, parts = max(1, 8 * PART // block), []
        for start in range(0, blocks, per):
            data = np.zeros((min(per, blocks - start), block // 8), np.uint8)
            for row in table.where((F.col("block") >= start) & (F.col("block") < start + per)).toLocalIterator():
                data[row.block - start] = np.frombuffer(bytes(row.bytes), np.uint8)
            parts.append(spark.sparkContext.broadcast(data.reshape(-1)))
        bloom = LogBloom(parts, blocks, block)
    return Model(spark.sparkContext.broadcast(head_of(words, head)), words, blocks, block, table, bloom)


RESULT = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()), T.StructField("tail_key", T.ArrayType(T.LongType())), T.StructField("tail_n", T.ArrayType(T.LongType()))]


def judged(word: np.ndarray, pair: np.ndarray, sizes: np.ndarray, head: Head, look: Callable[[np.ndarray], np.ndarray]) -> list[pa.Array]:
    """RESULT's columns for some texts of these :func:`keys`; *look* reads levels of distinct keys.  Tail: words whose exact count is missing yet."""
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    below = float(head.total + head.distinct + 1)
    distinct, at = np.unique(word, return_inverse=True)
    levels = look(distinct)
    count = middle(levels)[at]
    pairs, back = np.unique(pair, return_inverse=True)
    # every text ends with an end, so its count is that of the first text's last token
    before = np.concatenate([[count[sizes[0] - 1]], count[:-1]])
    chance = (middle(look(pairs))[back] + MU * (count + 1) / below) / (before + MU)
    exact, here = head.exact(distinct)
    settled = here | (levels == 0)
    base = np.where(settled, np.log10((exact + 1) / below), 0.0)[at]
    open_ = np.flatnonzero(~settled[at])
    row = np.repeat(np.arange(len(sizes)), sizes)
    cell, times = np.unique(row[open_] * len(distinct) + at[open_], return_counts=True)
    ends = pa.array(np.searchsorted(cell, np.arange(len(sizes) + 1) * len(distinct)).astype(np.int32))
    total = lambda x: pa.array(np.add.reduceat(x, starts))
    return [
        pa.array(sizes), total((exact > 0)[at].astype(np.int64)), total(base), total(np.log10(np.minimum(chance, 1.0))),
        pa.ListArray.from_arrays(ends, pa.array(distinct[cell % len(distinct)])), pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int64))),
    ]


def _broadcast_scores(numbered: DataFrame, key: str, model: Model, schema: T.StructType) -> DataFrame:
    head, bloom = model.head, model.bloom

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([*part.columns[:2], *judged(*keys(texts), head.value, bloom.level)], schema.names)

    return mapped(numbered.select(key, "_row", "text"), run, schema)


def _asked(word: np.ndarray, pair: np.ndarray, blocks: int, per: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's distinct keys, the region of *per* blocks of each, and their order by region."""
    distinct = np.unique(np.concatenate([word, pair]))
    region = distinct % blocks // per
    # numbers of 16 bits are sorted by digits
    return distinct, region, np.argsort(region.astype(np.uint16) if blocks <= per << 16 else region, kind="stable")


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Parts of *data* that end at *ends*, as bytes."""
    offsets = np.concatenate([[0], ends * data.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column, and where each row's end."""
    rows = column.combine_chunks()
    rows = pa.concat_arrays(rows.chunks) if isinstance(rows, pa.ChunkedArray) else rows
    ends = np.cumsum(np.asarray(pc.binary_length(rows)).astype(np.int64))
    if not len(ends):
        return np.zeros(0, np.uint8), ends
    first = int(np.frombuffer(rows.buffers()[1], np.int32)[rows.offset])
    return np.frombuffer(rows.buffers()[2], np.uint8)[first : first + int(ends[-1])] if ends[-1] else np.zeros(0, np.uint8), ends


def _routed_scores(numbered: DataFrame, key: str, model: Model, schema: T.StructType) -> DataFrame:
    """Chunks of texts ask the filter's regions for the levels of their keys.

    A chunk is one row per region (its keys there) and one with its tokens, which only passes through.  A
    chunk asks for a frequent key once, so a region gets eight bytes of it per chunk of BATCH_BYTES.
    """
    head, size, blocks, per = model.head, model.block, model.blocks, max(1, REGION // model.block)
    regions = -(-blocks // per)
    kind = schema[key].dataType.simpleString()
    tokens = f"names array<{kind}>, rows array<long>, sizes array<long>, words binary"
    fields = f"chunk long, region long, payload binary, {tokens}"

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["chunk", "region", "payload", "names", "rows", "sizes", "words"]
        for part, texts in chunks(batches, "text", BATCH_BYTES):
            names, rows = part.columns[:2]
            chunk, (word, pair, sizes) = rows[0].as_py(), keys(texts)
            asked, region, order = _asked(word, pair, blocks, per)
            asked, region = asked[order], region[order]
            ends = np.append(np.flatnonzero(np.diff(region)) + 1, len(region))
            kinds = (pa.list_(names.type), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), chunk)), pa.array(region[ends - 1]), _binary(asked, ends), *(pa.nulls(len(ends), k) for k in kinds)], columns)
            distinct, at = np.unique(word, return_inverse=True)
            at = at.astype(np.uint16 if len(distinct) <= 1 << 16 else np.uint32)
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([chunk % regions]), pa.array([at.tobytes()]), listed(names), listed(rows), listed(pa.array(sizes)), pa.array([distinct.tobytes()])], columns)

    def answer(held: pa.Table, asked: pa.Table) -> pa.Table:
        data = np.zeros(per * size // 8, np.uint8)
        for block, some in zip(held.column("block").to_pylist(), held.column("bytes"), strict=True):
            data[block % per * size // 8 :][: size // 8] = np.frombuffer(some.as_buffer(), np.uint8)
        passing = pc.is_valid(asked.column("words"))
        through, asked = asked.filter(passing), asked.filter(pc.invert(passing))
        raw, ends = _bytes(asked.column("payload"))
        wanted = np.frombuffer(raw.tobytes(), np.int64)
        levels = np.zeros(len(wanted), np.uint8)
        for i in range(0, len(wanted), PROBED):
            some = wanted[i : i + PROBED]
            levels[i : i + PROBED] = read_levels(data, some % blocks % per * size, some, size)
        found = asked.set_column(asked.schema.get_field_index("payload"), "payload", _binary(levels, ends // 8))
        return pa.concat_tables([found, through])

    def final(rows: pa.Table) -> pa.Table:
        whole = rows.filter(pc.is_valid(rows.column("words")))
        levels = rows.filter(pc.is_null(rows.column("words"))).sort_by("region")
        one = lambda c: whole.column(c)[0]
        distinct, sizes = np.frombuffer(one("words").as_buffer(), np.int64), np.asarray(one("sizes").values)
        word = distinct[np.frombuffer(one("payload").as_buffer(), np.uint16 if len(distinct) <= 1 << 16 else np.uint32)]
        pair = pair_keys(np.concatenate([[np.uint64(END)], word[:-1].view(np.uint64)]), word.view(np.uint64))
        names, _, order = _asked(word, pair, blocks, per)
        found = np.zeros(len(names), np.int64)
        found[order] = _bytes(levels.column("payload"))[0]
        columns = judged(word, pair, sizes, head.value, lambda k: found[np.searchsorted(names, k)])
        return pa.Table.from_arrays([one("names").values, one("rows").values, *columns], schema.names)

    asks = mapped(numbered.select(key, "_row", "text"), ask, fields)
    table = model.table.withColumn("region", F.floor(F.col("block") / per).cast("long"))
    levels = table.groupBy("region").cogroup(asks.groupBy("region")).applyInArrow(answer, fields)
    return levels.groupBy("chunk").applyInArrow(final, schema)


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """*key*, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` (exact add-one unigrams)
    and ``score`` (the model), one row per row of *docs*."""
    source = docs.select(F.col(key), F.col(text).alias("text"))
    schema = T.StructType([source.schema[key], T.StructField("_row", T.LongType()), *RESULT])
    number = F.monotonically_increasing_id()
    if model.bloom is None:
        turn, passed = F.pmod(F.xxhash64(key, F.octet_length("text")), F.lit(TURNS)), None
        for i in range(TURNS):
            with tidy(docs.sparkSession):
                some = store(_routed_scores(source.where(turn == i).withColumn("_row", number * TURNS + i), key, model, schema), "scored")
            passed = some if passed is None else passed.unionByName(some)
    else:
        passed = store(_broadcast_scores(source.withColumn("_row", number), key, model, schema), "scored")
    below = float(model.head.value.total + model.head.value.distinct + 1)
    tail = passed.where(F.size("tail_key") > 0).select("_row", F.explode(F.arrays_zip("tail_key", "tail_n")).alias("t")).select("_row", F.col("t.tail_key").alias("key"), F.col("t.tail_n").alias("times"))
    counted = tail.join(model.words, "key", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tails = counted.groupBy("_row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("t_known"),
        F.sum(F.col("times") * F.log10((F.col("n") + 1) / below)).alias("t_base"),
    )
    none: Callable[[str], Column] = lambda c: F.coalesce(c, F.lit(0))
    return passed.drop("tail_key", "tail_n").join(tails, "_row", "left").select(
        key, "n_tokens", (F.col("n_known") + none("t_known")).alias("n_known"), F.lit(model.head.value.total).cast("long").alias("train_tokens"),
        (F.col("base") + none("t_base")).alias("base_score"), "score",
    )
