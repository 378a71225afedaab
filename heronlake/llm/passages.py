"""Substring deduplication by automata of recurring passages.

A window is a run of ``words`` consecutive words.  Each word is removed that a window covers
which also starts in a document of a smaller key.

1. *Confirm.*  Every window holds the least hash of its runs of ANCHOR words; windows of equal
   words share it.  Spark counts in which documents each of these anchors occurs (about one
   for five words), and of windows with a recurring anchor only it finds the first document,
   by 96 bits of hash.  A window of the first document's text that occurs later, too, is
   confirmed.
2. *Compile.*  Documents are dealt to shards of about SHARD_BYTES.  A shard gets the windows
   confirmed for its documents; their maximal runs, cut to PIECE windows, are the passages, and
   each different passage is entered once into the shard's Aho-Corasick automaton, over words.
3. *Stream.*  All documents of the shard run through its automaton; wherever a passage ends, those of its
   windows that a smaller document holds are removed.

So an automaton is bounded by its shard, and each document is streamed once.  A passage that
a third of all documents hold is one row per shard before it is shuffled.

Windows are judged on the input.  Null texts have no words; a null key is larger than all others
and equal to other nulls; rows of equal keys are one document for the comparison and a row each
in the result; an empty table gives an empty table.  Only key and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import mapped, spans, store, tidy

ANCHOR = 5
#: Bytes of text in a shard of documents, and windows in a passage of its automaton.
SHARD_BYTES, PIECE = 4 << 20, 52
LAST = 2**63 - 1


def constants(n: int, seed: int) -> np.ndarray:
    """Odd factors, one per place in a run of *n* words."""
    return np.array([xxhash.xxh64_intdigest(f"{seed}:{i}".encode()) | 1 for i in range(n)], np.uint64)


@cache
def _bytes(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A random number for each place (of 64) and byte, and powers of a random odd number for each 64 places: 1 for the first ones."""
    draw = np.random.default_rng(seed)
    table, powers = draw.integers(0, 1 << 64, (64, 256), np.uint64), np.full(1 << 16, int(draw.integers(0, 1 << 62)) * 2 + 1, np.uint64)
    powers[0] = 1
    return table, np.multiply.accumulate(powers)


def word_hashes(words: pa.StringArray, seed: int) -> np.ndarray:
    """Tabulation hash of each word: the sum of the numbers of its bytes at their places, mixed with its length."""
    if not len(words):
        return np.zeros(0, np.uint64)
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data, sizes = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], np.diff(offsets)
    at = np.arange(len(data)) - np.repeat(offsets[:-1] - offsets[0], sizes)
    table, powers = _bytes(seed)
    values = table[at & 63, data]
    if int(sizes.max()) > 64:  # places repeat, each time under another factor
        values = values * powers[(at >> 6) & 0xFFFF] + (at >> 22).astype(np.uint64)
    return mixed(np.add.reduceat(values, offsets[:-1] - offsets[0]) + sizes.astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of several texts: ids by first occurrence, hashes, and to which text each belongs."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts, "")))
        words = lists.flatten()
        filled = np.asarray(pc.binary_length(words)) > 0
        owner = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists)))[filled]
        self.words = words.filter(pa.array(filled))
        coded = self.words.dictionary_encode()
        self.ids, self.vocabulary = np.asarray(coded.indices), coded.dictionary
        self.counts = np.bincount(owner, minlength=len(texts))
        self.text_of = owner
        self.ends = np.cumsum(self.counts)

    def runs(self, n: int, seed: int) -> np.ndarray:
        """Hash of the run of *n* words from each word on (those at the end reach over texts)."""
        h = word_hashes(self.vocabulary, seed)[self.ids] if len(self.ids) else np.zeros(0, np.uint64)
        out = np.zeros(max(0, len(h) - n + 1), np.uint64)
        for i, c in enumerate(constants(n, seed)):
            out += h[i : i + len(out)] * c
        return mixed(out)

    def windows(self, n: int) -> np.ndarray:
        """Where windows of *n* words of one text begin."""
        if len(self.ids) < n:
            return np.zeros(0, np.int64)
        return np.flatnonzero(self.text_of[: len(self.ids) - n + 1] == self.text_of[n - 1 :])

    def anchors(self, n: int) -> np.ndarray:
        """The least hash of ANCHOR words in the window of *n* words from each word on."""
        short = min(ANCHOR, n)
        least, width, want = self.runs(short, 1), 1, n - short + 1
        while width < want:
            step = min(width, want - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        return least


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def half(h: np.ndarray) -> pa.Array:
    return pa.array(h.astype(np.uint32).view(np.int32))


def summed(keys: list[np.ndarray], docs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each different key with its least and its largest document."""
    order = np.lexsort((docs, *keys[::-1]))
    keys, docs = [k[order] for k in keys], docs[order]
    first = np.ones(len(docs), bool)
    first[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    starts = np.flatnonzero(first)
    stops = np.append(starts[1:], len(docs)) - 1
    return [k[starts] for k in keys], docs[starts], docs[stops] if len(docs) else docs


def sharded(docs: DataFrame, key: str, text: str, shard_bytes: int) -> DataFrame:
    """*key*, ``doc`` (its place in the order), ``text`` and ``shard``."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    n = max(1, math.ceil(total / shard_bytes))
    doc = F.coalesce(F.col(key).cast("long"), F.lit(LAST))
    return docs.select(F.col(key), doc.alias("doc"), F.col(text).alias("text"), F.pmod(F.xxhash64(doc, F.octet_length(F.col(text))), F.lit(n)).cast("int").alias("shard"))


def anchors(rows: DataFrame, words: int) -> DataFrame:
    """``shard`` and ``anchor``: the anchors of its documents that other documents hold, too.

    An anchor has at most one row per shard and Arrow batch, so none is hot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_pylist()
            for start, stop in spans(sizes):
                part = batch.slice(start, stop - start)
                w = Words(part.column(2))
                at = w.windows(words)
                least = w.anchors(words)[at]
                new = np.ones(len(at), bool)
                new[1:] = (least[1:] != least[:-1]) | (w.text_of[at][1:] != w.text_of[at][:-1])
                text = w.text_of[at][new]
                (shard, h), lo, hi = summed([np.asarray(part.column(3))[text], least[new]], np.asarray(part.column(1))[text])
                yield pa.RecordBatch.from_arrays([pa.array(shard), signed(h), pa.array(lo < hi)], ["shard", "anchor", "several"])

    w = Window.partitionBy("anchor")
    found = mapped(rows, run, "shard int, anchor long, several boolean").withColumns({"n": F.count("*").over(w), "any": F.max("several").over(w)})
    return found.where("n > 1 OR any").select("shard", "anchor").distinct()


def confirmed(rows: DataFrame, words: int) -> DataFrame:
    """``shard``, ``h1``, ``h2`` and ``owner``: windows of its documents that a smaller document holds, too.

    A window has one row per shard, so none is hot.
    """

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        found = [np.zeros(0, np.uint64)] * 2, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(docs) and len(known):
            w = Words(docs.column(2).chunk(0))
            at = w.windows(words)
            held = np.isin(w.anchors(words)[at].view(np.int64), np.asarray(known.column("anchor")))
            at = at[held]
            found = summed([w.runs(words, 1)[at], w.runs(words, 2)[at] >> np.uint64(32)], np.asarray(docs.column(1))[w.text_of[at]])
        (h1, h2), lo, hi = found
        shard = docs.column(3)[0].as_py() if len(docs) else 0
        return pa.table({"shard": pa.array(np.full(len(lo), shard, np.int32)), "h1": signed(h1), "h2": half(h2), "lo": pa.array(lo), "several": pa.array(lo < hi)})

    with tidy(rows.sparkSession):
        known = store(anchors(rows, words), "recurring-anchors")
    found = rows.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(run, "shard int, h1 long, h2 int, lo long, several boolean")
    found = found.withColumn("owner", F.min("lo").over(Window.partitionBy("h1", "h2")))
    return found.where("owner < lo OR several").select("shard", "h1", "h2", "owner")


def looked_up(w: Words, at: np.ndarray, known: pa.Table, words: int) -> np.ndarray:
    """The owner of each window from *at*, LAST if it isn't confirmed."""
    out = np.full(len(at), LAST, np.int64)
    if not len(known) or not len(at):
        return out
    h1, h2, owner = (np.asarray(known.column(c)) for c in ("h1", "h2", "owner"))
    order = np.argsort(h1, kind="stable")
    h1, h2, owner = h1[order], h2[order], owner[order]
    a, b = w.runs(words, 1)[at].view(np.int64), (w.runs(words, 2)[at] >> np.uint64(32)).astype(np.uint32).view(np.int32)
    place = np.searchsorted(h1, a)
    open_ = np.flatnonzero(place < len(h1))
    while len(open_ := open_[h1[place[open_]] == a[open_]]):  # one round, but for hashes that are half equal
        hit = h2[place[open_]] == b[open_]
        out[open_[hit]] = owner[place[open_[hit]]]
        open_ = open_[~hit]
        place[open_] += 1
        open_ = open_[place[open_] < len(h1)]
    return out


Passage = tuple[int, int, int, np.ndarray]


def compiled(w: Words, at: np.ndarray, owner: np.ndarray, words: int, piece: int = PIECE) -> tuple[ahocorasick.Automaton | None, list[Passage]]:
    """The automaton of all different passages; of each its length, its windows' least and largest owner, and all of them."""
    machine = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    seen: dict[bytes, int] = {}
    passages: list[Passage] = []
    ok = np.flatnonzero(owner < LAST)
    breaks = np.flatnonzero((np.diff(at[ok]) != 1) | (np.diff(w.text_of[at[ok]]) != 0)) + 1
    for run in np.split(ok, breaks) if len(ok) else []:
        for i in range(0, len(run), piece):
            part = run[i : i + piece]
            ids = w.ids[at[part[0]] : at[part[-1]] + words]
            if seen.setdefault(ids.tobytes(), len(passages)) == len(passages):
                machine.add_word(tuple(ids.tolist()), len(passages))
                passages.append((len(ids), int(owner[part].min()), int(owner[part].max()), owner[part]))
    if passages:
        machine.make_automaton()
    return (machine if passages else None), passages


def covered(machine: ahocorasick.Automaton, passages: list[Passage], ids: np.ndarray, doc: int, words: int) -> np.ndarray:
    """Which words of a document windows cover that a smaller document holds."""
    gone = np.zeros(len(ids), bool)
    for end, p in machine.iter(tuple(ids.tolist())):
        n, least, largest, owner = passages[p]
        if largest < doc:
            gone[end - n + 1 : end + 1] = True
        elif least < doc:
            for start in (end - n + 1 + np.flatnonzero(owner < doc)).tolist():
                gone[start : start + words] = True
    return gone


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 13, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """*key*, ``n_words``, ``n_removed`` and ``kept``, the other words joined by one space: one row per row of *docs*."""
    rows = sharded(docs, key, text, shard_bytes)
    known = confirmed(rows, words)
    with tidy(docs.sparkSession):
        known = store(known, "confirmed-windows")
    schema = T.StructType([rows.schema[0], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        docs = docs.combine_chunks()
        if not len(docs):
            return pa.Table.from_arrays([docs.column(0), *(pa.array([], kind) for kind in (pa.int64(), pa.int64(), pa.string()))], schema.names)
        w = Words(docs.column(2).chunk(0))
        at = w.windows(words)
        machine, passages = compiled(w, at, looked_up(w, at, known, words), words)
        gone = np.zeros(len(w.ids), bool)
        for doc, stop, n in zip(docs.column(1).to_pylist(), w.ends.tolist(), w.counts.tolist(), strict=True):
            if machine and n >= words:
                gone[stop - n : stop] = covered(machine, passages, w.ids[stop - n : stop], doc, words)
        left = np.bincount(w.text_of[~gone], minlength=len(docs))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(left)), pa.int32()), w.words.filter(pa.array(~gone)))
        return pa.Table.from_arrays([docs.column(0), pa.array(w.counts), pa.array(w.counts - left), pc.binary_join(lists, " ")], schema.names)

    return rows.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(run, schema)
