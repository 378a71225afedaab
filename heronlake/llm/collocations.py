"""Phrase collocations by compressed position bitmaps.

Texts are cut into pieces at punctuation and line ends, and pieces into words.  Each task packs
the pieces it reads into shards of about SHARD_TOKENS tokens of one language, with one
free position between pieces.  In a shard every word has a bitmap of its positions, of which
only the parts with bits are kept.  Shifting a phrase's bitmap by one and ANDing it with a
word's gives the bitmap of the longer phrase, and its popcount the occurrences; the free
positions keep phrases within their pieces.

Popcounts are summed over shards once for each length: of words, of pairs of frequent words, of
triples of frequent pairs, and so on.  What is frequent goes back only to the shards that hold it; other words
become gaps of the shard's stream before pairs are counted.  A phrase is counted a few times
per shard, however frequent it is.

Frequent words and phrases are numbered, so a pair is known by its words' numbers and a longer
phrase by those of the phrase before its last word and of that word: exactly, by one 64-bit key.  A shard sends its
counts as ascending lists of such keys, one list for each part of the keys; a part is summed
by one task, and there are as many as the tokens ask for.  Words travel likewise, as lists of the words themselves.

Null texts are empty, a null language is ``und``; repeated rows count each; texts of any
length are packed whole (a text stays in one shard); an empty table gives an empty result.
Only the columns named are read.
"""

from __future__ import annotations

import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronlake.llm.common import chunks, forget, mapped, store, tidy

SHARD_TOKENS = 2_000_000
#: Positions of a part of a bitmap, and parts that one AND takes at once.
WIDTH, STEP = 8, 1 << 16
MIN_COUNT, LONGEST, TOP = 100, 5, 2000
#: Tokens for which there is one part of the keys, bytes of the shards' words for which there is one of the words, and fewest parts.
PART_TOKENS, PART_BYTES, PARTS = 2_000_000, 16 << 20, 16
#: Lower case of A-Z; tabs become spaces, characters that end a piece line feeds.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz " + b"\n" * 9)


class Packer:
    """Words by id and the stream of ids; 0 ends a piece, 1 is nothing (between two spaces)."""

    def __init__(self):
        self.ids: defaultdict = defaultdict(None, {b"\n": 0, b"": 1})
        self.ids.default_factory = self.ids.__len__
        self.stream = array("i")

    def add(self, text: str) -> None:
        tokens = text.encode().translate(FOLD).replace(b"\n", b" \n ").split(b" ")
        self.stream.extend(map(self.ids.__getitem__, tokens))
        self.stream.append(0)

    def packed(self) -> tuple[list[str], np.ndarray, bytes]:
        stream = np.frombuffer(self.stream, np.int32)
        stream = stream[stream != 1] - 2
        stream[stream < 0] = -1
        return packed(stream, [x.decode() for x in self.ids][2:])


def packed(stream: np.ndarray, words: list[str]) -> tuple[list[str], np.ndarray, bytes]:
    """Words and counts, most frequent first, and the *stream* (-1 for gaps) by rank from 1 on, 0 for gaps: four planes of
    bytes, of which the upper ones compress to little."""
    counts = np.bincount(stream[stream >= 0], minlength=len(words))
    order = np.argsort(-counts, kind="stable")
    rank = np.zeros(len(order) + 1, np.uint32)  # the last one is for gaps
    rank[order] = np.arange(1, len(order) + 1)
    return [words[i] for i in order.tolist()], counts[order], rank[stream].view(np.uint8).reshape(-1, 4).T.tobytes()


def unpacked(planes: bytes) -> np.ndarray:
    """Word ids in order, -1 for gaps."""
    return np.frombuffer(planes, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int32) - 1


def shards(docs: DataFrame, text: str = "text", lang: str = "lang", limit: int = SHARD_TOKENS) -> DataFrame:
    """``shard``, ``lang``, ``words``, ``counts`` and ``stream`` (of :func:`packed`)."""
    names = ["shard", "lang", "words", "counts", "stream"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        packs: defaultdict[str, Packer] = defaultdict(Packer)

        def out(of: str) -> pa.RecordBatch:
            nonlocal number
            words, counts, planes = packs.pop(of).packed()
            number += 1
            row = [pa.array([number]), pa.array([of]), pa.array([words], pa.list_(pa.string())), pa.array([counts], pa.list_(pa.int64())), pa.array([planes])]
            return pa.RecordBatch.from_arrays(row, names)

        for part, texts in chunks(batches, "text"):
            for of, x in zip(part.column(0).to_pylist(), texts, strict=True):
                packs[of].add(x)
                if len(packs[of].stream) >= limit:
                    yield out(of)
            if sum(len(p.stream) for p in packs.values()) >= limit:  # many languages
                yield out(max(packs, key=lambda of: len(packs[of].stream)))
        for of in list(packs):
            yield out(of)

    source = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    return mapped(source, run, "shard long, lang string, words array<string>, counts array<long>, stream binary")


@dataclass
class Bitmaps:
    """Position bitmaps of several words or phrases without their empty parts.

    Row i says that of bitmap ``owner[i]`` the part ``part[i]`` (WIDTH positions) holds ``bits[i]``.
    """

    owner: np.ndarray
    part: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, owner: np.ndarray, at: np.ndarray) -> Bitmaps:
        """From positions: bitmap *owner* has bit *at*."""
        order = np.lexsort((at, owner))
        owner, part, bits = owner[order], at[order] // WIDTH, np.uint32(1) << (at[order] % WIDTH).astype(np.uint32)
        first = np.ones(len(owner), bool)
        first[1:] = (owner[1:] != owner[:-1]) | (part[1:] != part[:-1])
        starts = np.flatnonzero(first)
        return cls(owner[starts], part[starts], np.bitwise_or.reduceat(bits, starts) if len(starts) else bits)

    def __len__(self) -> int:
        return len(self.owner)

    def take(self, rows: np.ndarray) -> Bitmaps:
        return Bitmaps(self.owner[rows], self.part[rows], self.bits[rows])

    def shifted(self) -> Bitmaps:
        """Every bit one position on; bits that leave their part go to the next one."""
        bits = self.bits << np.uint32(1)
        low, high = bits & np.uint32((1 << WIDTH) - 1), bits >> np.uint32(WIDTH)
        a, b = low > 0, high > 0
        return Bitmaps(np.concatenate([self.owner[a], self.owner[b]]), np.concatenate([self.part[a], self.part[b] + 1]), np.concatenate([low[a], high[b]]))

    def counts(self, n: int) -> np.ndarray:
        return np.bincount(self.owner, np.bitwise_count(self.bits), n).astype(np.int64)


def meet(left: Bitmaps, left_key: np.ndarray, right: Bitmaps, right_key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """AND of the parts of *left* with those of *right* (sorted by *right_key*) of equal key:
    rows of both and the bits, where any are left, at most about STEP rows of *left* at once."""
    for i in range(0, len(left), STEP):
        key = left_key[i : i + STEP]
        lo, hi = np.searchsorted(right_key, key), np.searchsorted(right_key, key, "right")
        n = hi - lo
        a = np.repeat(np.arange(len(key)), n)
        b = np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        bits = left.bits[i + a] & right.bits[b]
        some = bits > 0
        yield i + a[some], b[some], bits[some]


def word_bitmaps(stream: np.ndarray) -> Bitmaps:
    at = np.flatnonzero(stream >= 0)
    return Bitmaps.of(stream[at].astype(np.int64), at)


def sorted_by(bits: Bitmaps, key: np.ndarray) -> Bitmaps:
    return bits.take(np.lexsort((bits.part, key)))


def pair_parts(words: Bitmaps, n: int, wanted: np.ndarray | None = None) -> Bitmaps:
    """Bitmaps, in no order, of where pairs end (*wanted* ones, ascending, else all); a pair's number is first word * *n* + second word."""
    right = words.take(np.argsort(words.part, kind="stable"))
    left = words.shifted()
    left = left.take(np.argsort(left.part, kind="stable"))
    owner, part, bits = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for a, b, found in meet(left, left.part, right, right.part):
        pair = left.owner[a] * n + right.owner[b]
        if wanted is not None:
            at = np.minimum(np.searchsorted(wanted, pair), len(wanted) - 1)
            some = wanted[at] == pair
            pair, b, found = pair[some], b[some], found[some]
        owner.append(pair)
        part.append(right.part[b])
        bits.append(found)
    return Bitmaps(np.concatenate(owner), np.concatenate(part), np.concatenate(bits))


def pair_bitmaps(words: Bitmaps, n: int, wanted: np.ndarray | None = None) -> Bitmaps:
    """The same, pair by pair."""
    found = pair_parts(words, n, wanted)
    return sorted_by(found, found.owner)


class Grams:
    """Frequent runs of k words in a shard with the bitmaps of where they end.

    *names* has their words (a row each); *head* and *tail* number their first and last k - 1 words.
    """

    def __init__(self, bits: Bitmaps, names: np.ndarray):
        self.names = names
        ends = np.concatenate([names[:, :-1], names[:, 1:]]) if len(names) else np.zeros((0, 1), np.int64)
        number = np.unique(ends, axis=0, return_inverse=True)[1].ravel()
        self.head, self.tail = number[: len(names)], number[len(names) :]
        self.bits, self.span = sorted_by(bits, self.head[bits.owner]), int(bits.part.max(initial=0)) + 2
        self.key = self.head[self.bits.owner] * self.span + self.bits.part

    def longer(self, longest: int) -> Iterator[tuple[np.ndarray, Bitmaps]]:
        """Phrases of k + 1 to *longest* words made of these runs, depth-first: their words and bitmaps.  A phrase may come in parts."""
        order = np.lexsort((self.bits.part, self.bits.owner))
        edges = np.searchsorted(self.bits.owner[order], np.arange(len(self.names) + 1))
        i = 0
        while i < len(self.names):  # as many runs at once as have about STEP parts
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + STEP, "right")) - 1)
            some = self.bits.take(order[edges[i] : edges[j]])
            yield from self._grow(Bitmaps(some.owner - i, some.part, some.bits), self.names[i:j], self.tail[i:j], longest)
            i = j

    def _grow(self, ends: Bitmaps, names: np.ndarray, tail: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, Bitmaps]]:
        if names.shape[1] >= longest:
            return
        left, n = ends.shifted(), len(self.names)
        for a, b, bits in meet(left, tail[left.owner] * self.span + left.part, self.bits, self.key):
            found, number = np.unique(left.owner[a] * n + self.bits.owner[b], return_inverse=True)
            if len(found):
                gram = found % n
                here = Bitmaps(number, self.bits.part[b], bits)
                words = np.column_stack([names[found // n], self.names[gram, -1]])
                yield words, here
                yield from self._grow(here, words, self.tail[gram], longest)


def values(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    for batch in batches:
        for row in range(len(batch)):
            yield [c[row].as_py() for c in batch.columns]


def thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shards of their ``known`` words alone (with their ids), other words being gaps; ``numbers`` are those of all shards' words."""
    for shard, planes, known in values(batches):
        stream, ids = unpacked(planes), np.concatenate([np.cumsum(spread(x["ids"])) for x in known])
        to = np.full(max(int(stream.max(initial=-1)), int(ids.max())) + 2, -1, np.int32)
        to[ids] = np.arange(len(ids))
        numbers, _, planes = packed(to[stream], np.concatenate([spread(x["numbers"]) for x in known]).tolist())
        yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([numbers], pa.list_(pa.int64())), pa.array([planes])], ["shard", "numbers", "stream"])


def squeezed(numbers: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, of which the upper ones compress to little."""
    return zlib.compress(np.ascontiguousarray(numbers, np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def spread(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(8, -1).T.copy().view(np.int64).ravel()


def steps(ascending: np.ndarray) -> bytes:
    return squeezed(np.diff(ascending, prepend=0))


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, ascending, and the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def joined(words: list[bytes]) -> bytes:
    """Words, which hold no space."""
    return zlib.compress(b" ".join(words), 1)


def split(data: bytes) -> pa.Array:
    return pa.array(zlib.decompress(data).split(b" "), pa.binary())


def dealt(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """``part``, ``shard``, ``lang``, ``words``, ``ids`` and ``counts``: a shard's words by the remainder of a checksum."""
    for shard, lang, words, counts in values(batches):
        words, counts = [x.encode() for x in words], np.array(counts, np.int64)
        of = np.array([zlib.crc32(x) for x in words], np.int64) % parts
        order = np.argsort(of, kind="stable")
        some, starts = np.unique(of[order], return_index=True)
        ids = [order[i:j] for i, j in pairwise([*starts.tolist(), len(order)])] if len(order) else []
        lists = [pa.array(x, pa.binary()) for x in ([joined([words[i] for i in x.tolist()]) for x in ids], [steps(x) for x in ids], [squeezed(counts[x]) for x in ids])]
        row = [pa.array(some, pa.int64()), pa.array(np.full(len(some), shard), pa.int64()), pa.array([lang] * len(some), pa.string()), *lists]
        yield pa.RecordBatch.from_arrays(row, ["part", "shard", "lang", "words", "ids", "counts"])


def often_words(table: pa.Table, least: int, parts: int) -> pa.Table:
    """Of a part's words those with *least* or more occurrences in their language, numbered: for each shard the ``ids`` of those
    that it holds and their ``numbers``, and, as shard -1, each language's ``words`` with their ``numbers`` and counts (``f``)."""
    part, out, total = table["part"][0].as_py(), [], 0
    for lang in table["lang"].unique().to_pylist():
        rows = table.filter(pc.equal(table["lang"], lang))
        lists = [split(x.as_py()) for x in rows["words"]]
        every = pa.concat_arrays(lists).dictionary_encode()
        at, counts = every.indices.to_numpy(), np.concatenate([spread(x.as_py()) for x in rows["counts"]])
        f = np.zeros(len(every.dictionary), np.int64)
        np.add.at(f, at, counts)
        some = np.flatnonzero(f >= least)
        if not len(some):
            continue
        numbers = np.full(len(f), -1)
        numbers[some] = (total + np.arange(len(some))) * parts + part
        total += len(some)
        out.append((-1, lang, joined(every.dictionary.take(pa.array(some)).to_pylist()), None, squeezed(numbers[some]), squeezed(f[some])))
        edges = np.cumsum([0, *map(len, lists)]).tolist()
        for shard, ids, (i, j) in zip(rows["shard"].to_pylist(), rows["ids"], pairwise(edges), strict=True):
            found = numbers[at[i:j]]
            if (found >= 0).any():
                out.append((shard, lang, None, steps(np.cumsum(spread(ids.as_py()))[found >= 0]), squeezed(found[found >= 0]), None))
    types = (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], ["shard", "lang", "words", "ids", "numbers", "f"])


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``phrase`` (language, line feed, word), ``f`` and ``number`` of all the frequent words."""
    for lang, words, numbers, f in values(batches):
        phrases = [f"{lang}\n{x.decode()}" for x in split(words).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.string()), pa.array(spread(f)), pa.array(spread(numbers))], ["phrase", "f", "number"])


def counted(shard: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """``part``, ``shard``, ``keys`` and ``counts``: a shard's counts by the remainder of their keys, which is left out of them."""
    keys, counts = summed(keys, counts)
    part = keys % parts
    order = np.argsort(part, kind="stable")
    keys, counts = keys[order] // parts, counts[order]
    some, starts = np.unique(part[order], return_index=True)
    edges = [*starts.tolist(), len(keys)]
    lists = [(steps(keys[i:j]), squeezed(counts[i:j])) for i, j in pairwise(edges)] if len(keys) else []
    row = [pa.array(some, pa.int64()), pa.array(np.full(len(some), shard)), pa.array([x for x, _ in lists], pa.binary()), pa.array([x for _, x in lists], pa.binary())]
    return pa.RecordBatch.from_arrays(row, ["part", "shard", "keys", "counts"])


def often(table: pa.Table, least: int) -> pa.Table:
    """Of a part's counts the keys with *least* or more in all: for each shard those that it holds with their numbers in the
    part (``shard``, ``keys``, ``numbers``), and, as shard -1, all of them with their counts."""
    lists = [np.cumsum(spread(x.as_py())) for x in table["keys"]]
    found, f = summed(np.concatenate(lists), np.concatenate([spread(x.as_py()) for x in table["counts"]]))
    found, f = found[f >= least], f[f >= least]
    out = [(-1, steps(found), squeezed(f))] if len(found) else []
    for shard, keys in zip(table["shard"].to_pylist(), lists, strict=True):
        at = np.searchsorted(found, keys)
        at = at[found[np.minimum(at, len(found) - 1)] == keys] if len(found) else at[:0]
        if len(at):
            out.append((shard, steps(found[at]), steps(at)))
    columns = [pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]
    part = pa.array(np.full(len(out), table["part"][0].as_py()), pa.int64())
    return pa.Table.from_arrays([part, *columns], ["part", "shard", "keys", "numbers"])


def named(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """``key``, ``number`` and ``f`` of all the frequent keys."""
    for part, keys, f in values(batches):
        keys = np.cumsum(spread(keys))
        row = [pa.array(x) for x in (keys * parts + part, np.arange(len(keys)) * parts + part, spread(f))]
        yield pa.RecordBatch.from_arrays(row, ["key", "number", "f"])


def held(known: list[dict], parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's frequent keys and their numbers."""
    keys, numbers = ([np.cumsum(spread(x[of])) * parts + x["part"] for x in known] for of in ("keys", "numbers"))
    return np.concatenate(keys), np.concatenate(numbers)


def places(numbers: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where in *numbers*, all different, those *wanted* are."""
    order = np.argsort(numbers)
    return order[np.searchsorted(numbers, wanted, sorter=order)]


def ranks(names: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Which of *names* (ascending rows of numbers below *n*) each of *rows* is, -1 if none."""
    if not len(names):
        return np.full(len(rows), -1)
    code, of, some = names[:, 0], rows[:, 0], np.ones(len(rows), bool)
    for i in range(names.shape[1]):
        heads = np.unique(code)
        at = np.minimum(np.searchsorted(heads, of), len(heads) - 1)
        some &= heads[at] == of
        if i + 1 < names.shape[1]:
            code, of = np.searchsorted(heads, code) * n + names[:, i + 1], at * n + rows[:, i + 1]
    return np.where(some, at, -1)


def known_only(shorter: Grams, names: np.ndarray, n: int) -> Grams:
    """The phrases *names* (ascending) of one word more than *shorter* with their bitmaps."""
    k = shorter.names.shape[1] + 1
    names = np.asarray(names, np.int64).reshape(-1, k)
    parts = [Bitmaps(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))]
    for of, bits in shorter.longer(k):
        to = ranks(names, of, n)[bits.owner]
        parts.append(Bitmaps(to, bits.part, bits.bits).take(np.flatnonzero(to >= 0)))
    return Grams(Bitmaps(*(np.concatenate([getattr(x, f) for x in parts]) for f in ("owner", "part", "bits"))), names)


def grams_of(planes: bytes, names: np.ndarray, n: int) -> Grams:
    """The phrases *names* (ascending) of a thinned shard with their bitmaps, made from pair to pair."""

    def runs(k: int) -> np.ndarray:
        return np.unique(np.concatenate([names[:, i : i + k] for i in range(names.shape[1] - k + 1)]), axis=0)

    pairs = runs(2)
    wanted = pairs[:, 0] * n + pairs[:, 1]
    found = pair_bitmaps(word_bitmaps(unpacked(planes)), n, wanted)
    grams = Grams(Bitmaps(np.searchsorted(wanted, found.owner), found.part, found.bits), pairs)
    for k in range(3, names.shape[1] + 1):
        grams = known_only(grams, runs(k), n)
    return grams


def known_phrases(known: list[dict], numbers: np.ndarray, length: int, size: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's ``known`` phrases of *length* words: these by their places, ascending, and the phrases' numbers."""
    names, of = np.arange(len(numbers))[:, None], numbers
    for k in range(2, length + 1):
        keys, found = held([x for x in known if x["length"] == k], parts)
        names = np.column_stack([names[places(of, keys // size)], places(numbers, keys % size)])
        of = found
    order = np.lexsort(names.T[::-1])
    return names[order], of[order]


def paired(batches: Iterator[pa.RecordBatch], size: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs of a thinned shard's words; a pair's key is the first word's number * *size* + the second one's."""
    for shard, numbers, planes in values(batches):
        n, numbers = len(numbers), np.array(numbers, np.int64)
        pairs = pair_parts(word_bitmaps(unpacked(planes)), n)
        yield counted(shard, numbers[pairs.owner // n] * size + numbers[pairs.owner % n], np.bitwise_count(pairs.bits).astype(np.int64), parts)


def extended(batches: Iterator[pa.RecordBatch], length: int, size: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of one word more that a shard's ``known`` phrases of *length* words make; a phrase's key is the number
    of its first *length* words * *size* + the last word's."""
    for shard, numbers, planes, known in values(batches):
        if not any(x["length"] == length for x in known):
            continue
        n, numbers = len(numbers), np.array(numbers, np.int64)
        names, of = known_phrases(known, numbers, length, size, parts)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for words, bits in grams_of(planes, names, n).longer(length + 1):
            found.append((of[ranks(names, words[:, :-1], n)] * size + numbers[words[:, -1]], bits.counts(len(words))))
        yield counted(shard, *(np.concatenate(x) for x in zip(*found, strict=True)), parts)


def frequent(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, longest: int = LONGEST, limit: int = SHARD_TOKENS) -> tuple[DataFrame, DataFrame]:
    """``lang``, ``phrase``, ``size`` and ``f`` of the phrases of 1 to *longest* words that occur *min_count* times
    or more; and ``lang`` and ``n``, the occurrences of all words.  Both are stored tables."""
    all_ = store(shards(docs, text, lang, limit), "phrase-shards")
    schema = "part long, shard long, keys binary, counts binary"
    word = F.substring_index("phrase", "\n", -1)

    def passing(counts: DataFrame) -> DataFrame:
        return store(counts.groupBy("part").applyInArrow(lambda table: often(table, min_count), "part long, shard long, keys binary, numbers binary"), "frequent-keys")

    def again(shards: DataFrame, known: list[DataFrame]) -> DataFrame:
        """Shards with the frequent keys that they hold, by the *known* phrases' lengths from 2 on."""
        rows = reduce(DataFrame.unionByName, [x.where("shard >= 0").withColumn("length", F.lit(i)) for i, x in enumerate(known, 2)])
        return shards.join(rows.groupBy("shard").agg(F.collect_list(F.struct("length", "part", "keys", "numbers")).alias("known")), "shard")

    def all_of(known: DataFrame) -> DataFrame:
        """``number``, ``f``, ``head`` and ``last`` (the key's halves)."""
        found = mapped(known.where("shard < 0").select("part", "keys", "numbers"), lambda batches: named(batches, parts), "key long, number long, f long")
        return found.select("number", "f", F.expr(f"key div {size}").alias("head"), (F.col("key") % size).alias("last"))

    with tidy(docs.sparkSession):
        totals = store(all_.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"), F.sum(F.octet_length(F.array_join("words", " "))).alias("size")), "phrase-totals")
        n, n_bytes = (x or 0 for x in totals.agg(F.sum("n"), F.sum("size")).first())
        parts, word_parts = max(PARTS, -(-n // PART_TOKENS)), max(PARTS, -(-n_bytes // PART_BYTES))
        totals = totals.select("lang", "n")
        lists = mapped(all_.select("shard", "lang", "words", "counts"), lambda batches: dealt(batches, word_parts), "part long, shard long, lang string, words binary, ids binary, counts binary")
        words = store(lists.groupBy("part").applyInArrow(lambda table: often_words(table, min_count, word_parts), "shard long, lang string, words binary, ids binary, numbers binary, f binary"), "frequent-words")
        ids = store(mapped(words.where("shard < 0").select("lang", "words", "numbers", "f"), numbered, "phrase string, f long, number long"), "word-numbers")
        size = (ids.agg(F.max("number")).first()[0] or 0) + 1
        # the shards' many rare words stay where they are
        kept = words.where("shard >= 0").groupBy("shard").agg(F.collect_list(F.struct("ids", "numbers")).alias("known"))
        thin = mapped(all_.select("shard", "stream").join(kept, "shard"), thinned, "shard long, numbers array<long>, stream binary")
        thin = store(thin, "thinned-shards")
        forget(all_, words)
        thin_rows = thin.select("shard", "numbers", "stream")
        known = [passing(mapped(thin_rows, lambda batches: paired(batches, size, parts), schema))]
        for k in range(2, longest):
            known.append(passing(mapped(again(thin_rows, known), lambda batches, k=k: extended(batches, k, size, parts), schema)))
        last, phrases = ids.select(F.col("number").alias("last"), word.alias("word")), [ids]
        for keys in known:
            head = phrases[-1].select(F.col("number").alias("head"), "phrase")
            phrases.append(store(all_of(keys).join(head, "head").join(last, "last").select("number", "f", F.concat_ws(" ", "phrase", "word").alias("phrase")), "frequent-phrases"))
        found = reduce(DataFrame.unionByName, [x.select("phrase", "f") for x in phrases])
        # a language may hold line feeds, a phrase doesn't
        phrase, words_of = F.substring_index("phrase", "\n", -1), F.split(F.substring_index("phrase", "\n", -1), " ", -1)
        of = F.substring(F.col("phrase"), F.lit(1), F.length("phrase") - F.length(phrase) - 1)
        found = store(found.select(of.alias("lang"), phrase.alias("phrase"), F.size(words_of).alias("size"), "f", words_of.alias("words")).where(F.col("size") <= longest), "phrase-counts")
        forget(thin, *known, *phrases)
    return found, totals


def part(first: int | F.Column, n: int | F.Column) -> F.Column:
    return F.array_join(F.slice("words", first, n), " ")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", min_count: int = MIN_COUNT, percent: int = 100, longest: int = LONGEST, top: int = TOP, limit: int = SHARD_TOKENS) -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n`` and ``score``: each language's *top* phrases.

    A phrase of 2 words or more with *a* occurrences scores floor(1000 a n / (l r)) at the cut where that
    is least, *l* and *r* being the occurrences of the parts; phrases inside a longer one that occurs
    at least *percent* / 100 times as often are left out.  Products have 38 digits.
    """
    found, totals = frequent(docs, text, lang, min_count, longest, limit)
    counts = found.select("lang", F.col("phrase").alias("part"), F.col("f").alias("n_part"))
    longs = found.where("size > 1")

    inside = longs.where("size > 2").select("lang", "f", F.explode(F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> array_join(slice(words, i, k), ' '))))")).alias("phrase"))
    covers = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = longs.join(covers, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < percent * F.col("f").cast("decimal(20,0)")))

    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", "size", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    cuts = cuts.join(counts.select("lang", F.col("part").alias("first"), F.col("n_part").alias("l")), ["lang", "first"]).join(counts.select("lang", F.col("part").alias("rest"), F.col("n_part").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    score = F.expr("(CAST(1000 AS DECIMAL(38,0)) * a * n) div (CAST(l AS DECIMAL(38,0)) * r)")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # each language is ranked in parts first, so that one with most phrases isn't sorted in one task
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order))).where(F.col("rank") <= top)
    ranked = ranked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
