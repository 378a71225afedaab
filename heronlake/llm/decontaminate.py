"""Benchmark decontamination: a prefix-filtered join of documents with benchmark windows.

An item's windows are its runs of ``WINDOW`` (13) words; an item of fewer words, but not
none, is one window of its own size.  A window is the set of its shingles of ``SHINGLE``
(3) words with their places (a shorter window is one shingle).  A document holds a window
only if it holds *all* its shingles, so by the prefix filter one shingle per window is
enough to find it: the rarest, by how often it occurs over all documents.

1. count, over all documents, the shingles that occur in windows;
2. order each window's shingles by that count (ties: first place) and keep the first;
3. join documents with these prefix tokens on the shingle; the token's place in the
   window fixes where the window would begin: drop it if that is before the document's
   first word (positional bound) or if it would end after the last one (length bound);
4. verify the rest word by word over the window's size.

Tokens and windows are broadcast only where ``BROADCAST_WORDS`` bounds their words (about
64 MB in a worker); otherwise steps 1 and 3 are shuffle joins on the shingle's hash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import chunks, few, forget, mapped, store

WINDOW, SHINGLE = 13, 3
#: Benchmark words up to which prefix tokens and windows are broadcast.
BROADCAST_WORDS = 400_000
#: What separates words in a text that is not lower-cased yet.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: str) -> list[bytes]:
    """Words: runs of bytes that are no ASCII separators, A-Z lower-cased."""
    return text.encode().translate(_FOLD).split()


def windows(w: list[bytes], size: int = WINDOW) -> Iterator[tuple[bytes, ...]]:
    if w:
        for i in range(max(1, len(w) - size + 1)):
            yield tuple(w[i : i + size])


def shingles(w: list[bytes] | tuple[bytes, ...], n: int) -> list[bytes]:
    return w if n == 1 else list(map(b" ".join, zip(*(w[i:] for i in range(n)), strict=False)))


def width(window: tuple[bytes, ...]) -> int:
    return min(SHINGLE, len(window))


def code(shingle: bytes) -> int:
    h = xxhash.xxh64_intdigest(shingle, 42)
    return h - (1 << 64) if h >> 63 else h


class Index:
    """Prefix tokens with their windows, small enough to broadcast."""

    def __init__(self, items: dict[tuple[bytes, ...], set], counts: dict[tuple[int, bytes], int]):
        self.items = items
        self.tokens: dict[int, dict[bytes, list[tuple[int, tuple[bytes, ...]]]]] = {}
        for window in items:
            n = width(window)
            _, place, token = min((counts.get((n, s), 0), i, s) for i, s in enumerate(shingles(window, n)))
            self.tokens.setdefault(n, {}).setdefault(token, []).append((place, window))

    def find(self, w: list[bytes]) -> tuple[int, list]:
        """Number of words inside occurring windows, and the items with occurring windows."""
        hit, found = bytearray(len(w)), set()
        for n, tokens in self.tokens.items():
            grams = shingles(w, n)
            if tokens.keys().isdisjoint(grams):
                continue
            for at, gram in enumerate(grams):
                for place, window in tokens.get(gram, ()):
                    start, size = at - place, len(window)
                    if start >= 0 and start + size <= len(w) and tuple(w[start : start + size]) == window:
                        hit[start : start + size] = b"\1" * size
                        found |= self.items[window]
        return sum(hit), sorted(found, key=str)


RESULT = [T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType()))]


def _benchmark(benchmark: DataFrame, item: str, text: str, size: int) -> dict[tuple[bytes, ...], set]:
    items: dict[tuple[bytes, ...], set] = {}
    for row in benchmark.select(F.col(item).cast("string"), text).toLocalIterator():
        for window in windows(words(row[1] or ""), size):
            items.setdefault(window, set()).add(row[0] if row[0] is not None else "")
    return items


def shingle_counts(docs: DataFrame, wanted: dict[int, set[bytes]], text: str = "text") -> dict[tuple[int, bytes], int]:
    """How often each wanted shingle occurs in all documents; at most as many as the benchmark has."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for _, texts in chunks(batches, "text"):
            for x in texts:
                w = words(x)
                for n, those in shared.value.items():
                    grams = shingles(w, n)
                    if not those.isdisjoint(grams):
                        total.update((n, g) for g in grams if g in those)
        yield pa.RecordBatch.from_pydict({"n": pa.array([k[0] for k in total], pa.int32()), "shingle": pa.array([k[1] for k in total], pa.binary()), "c": pa.array(list(total.values()), pa.int64())})

    parts = mapped(docs.select(F.col(text).alias("text")), run, "n int, shingle binary, c long")
    return {(r.n, bytes(r.shingle)): r.c for r in parts.groupBy("n", "shingle").agg(F.sum("c").alias("c")).toLocalIterator()}


def contamination(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, bound: int = BROADCAST_WORDS) -> DataFrame:
    """*key*, ``n_words``, ``n_hit`` and ``items`` (as strings, sorted), one row per row of *docs*.

    Null texts have no words; items without words have no window; a null item id is the
    empty string; repeated items and rows are each judged by themselves.
    """
    source = docs.select(F.col(key), F.col(text).alias("text"))
    total = benchmark.agg(F.coalesce(F.sum(F.size(F.split(F.coalesce(F.col(item_text), F.lit("")), SEPARATORS))), F.lit(0))).first()[0]
    longest = benchmark.agg(F.coalesce(F.max(F.length(item_text)), F.lit(0))).first()[0]
    if total > bound or longest > 16 * bound:
        return _shuffled(source, benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text")), key, window)
    items = _benchmark(benchmark, item, item_text, window)
    wanted: dict[int, set[bytes]] = {}
    for w in items:
        wanted.setdefault(width(w), set()).update(shingles(w, width(w)))
    index = docs.sparkSession.sparkContext.broadcast(Index(items, shingle_counts(docs, wanted, text)))
    schema = T.StructType([source.schema[key], *RESULT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            split = [words(x) for x in texts]
            found = [index.value.find(w) for w in split]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(w) for w in split], pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.string()))], [key, "n_words", "n_hit", "items"])

    return mapped(source, run, schema)


def _grams(widths: list[int]):
    """A step that turns (row, text) into one row per shingle occurrence: hash, width, row, place, words in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text", 300_000):
            rows = part.column(0).to_pylist()
            for row, x in zip(rows, texts, strict=True):
                w = words(x)
                for n in widths:
                    h = [code(g) for g in shingles(w, n)]
                    if h:
                        yield pa.RecordBatch.from_pydict({"h": pa.array(h, pa.int64()), "n": pa.array([n] * len(h), pa.int32()), "row": pa.array([row] * len(h), pa.int64()), "place": pa.array(range(len(h)), pa.int64()), "size": pa.array([len(w)] * len(h), pa.int64())})

    return run


def _shuffled(source: DataFrame, benchmark: DataFrame, key: str, window: int) -> DataFrame:
    """The same join for benchmarks too large to broadcast."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text", 300_000):
            for name, x in zip(part.column(0).to_pylist(), texts, strict=True):
                w = words(x)
                some = list(windows(w, window))
                for start in range(0, len(some), 4096):
                    these = some[start : start + 4096]
                    yield pa.RecordBatch.from_pydict({"item": pa.array([name] * len(these)), "words": pa.array([b" ".join(y) for y in these], pa.binary()), "length": pa.array([len(y) for y in these], pa.int64()), "codes": pa.array([[code(s) for s in shingles(y, width(y))] for y in these], pa.list_(pa.int64()))})

    spark = source.sparkSession
    cuts = store(mapped(benchmark, cut, "item string, words binary, length long, codes array<long>"), "windows")
    kinds = store(cuts.groupBy("words").agg(F.min("length").alias("length"), F.min("codes").alias("codes")).withColumn("window", F.monotonically_increasing_id()), "window-kinds")
    # stored: how files are dealt out to tasks may differ from read to read
    numbered = store(source.select(F.col(key).alias("key"), "text", F.monotonically_increasing_id().alias("row")), "numbered")
    widths = [r[0] for r in kinds.select(F.least("length", F.lit(SHINGLE)).cast("int")).distinct().collect()]
    grams = mapped(numbered.select("row", "text"), _grams(widths), "h long, n int, row long, place long, size long")
    places = kinds.select("window", "length", F.least("length", F.lit(SHINGLE)).cast("int").alias("n"), F.posexplode("codes").alias("at", "h"))
    wanted = store(places.select("h", "n").distinct(), "wanted")
    hits = store(grams.join(wanted, ["h", "n"], "left_semi"), "gram-hits")
    counts = hits.groupBy("h", "n").agg(F.count("*").alias("c"))
    prefix = places.join(counts, ["h", "n"], "left").groupBy("window").agg(F.min(F.struct(F.coalesce("c", F.lit(0)).alias("c"), "at", "h", "n", "length")).alias("p")).select("window", "p.*")
    candidates = hits.join(store(prefix.where("c > 0"), "prefix"), ["h", "n"]).withColumn("start", F.col("place") - F.col("at"))
    candidates = candidates.where("start >= 0 AND start + length <= size").select("row", "start", "length", "window")
    # verification needs the document's words from start on; they travel with the row id only
    spans = store(candidates.join(kinds.select("window", "words"), "window"), "candidates")

    def verify(left, right):
        import pandas as pd

        out = []
        for row, text in zip(left["row"], left["text"], strict=True):
            w, hit, found = words(text or ""), None, set()
            hit = bytearray(len(w))
            for start, length, wanted_words, win in zip(right["start"], right["length"], right["words"], right["window"], strict=True):
                if b" ".join(w[start : start + length]) == bytes(wanted_words):
                    hit[start : start + length] = b"\1" * length
                    found.add(win)
            out += [(row, sum(hit), sorted(found))]
        return pd.DataFrame(out, columns=["row", "n_hit", "kinds"])

    checked = store(numbered.select("row", "text").groupBy("row").cogroup(spans.groupBy("row")).applyInPandas(verify, "row long, n_hit long, kinds array<long>"), "checked")
    named = checked.select("row", F.explode("kinds").alias("window")).join(kinds.select("window", "words"), "window").join(cuts.select("words", "item").distinct(), "words")
    items = named.groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    forget(wanted)
    size = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), SEPARATORS), lambda x: x != "")).cast("long")
    return (
        numbered.select("key", "row", size.alias("n_words"))
        .join(checked.select("row", "n_hit"), "row", "left")
        .join(items, "row", "left")
        .select(F.col("key").alias(key), "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
    )


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """The contract's columns from :func:`contamination`'s."""
    return found.select(
        key, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """*docs* without contaminated rows (``n_hit > 0`` and ``20 * n_hit >= n_words``); columns stay as they are,
    whatever their names.  Repeated rows are judged alike; null and empty texts stay; an empty table gives an empty table."""
    row = "_heron_row"
    while row in docs.columns:
        row += "_"
    numbered = store(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    bad = contamination(numbered.select(F.col(row), F.col(text)), benchmark, row, text).where("n_hit > 0 AND 20 * n_hit >= n_words").select(row)
    return numbered.join(few(store(bad, "contaminated")), row, "left_anti").drop(row)
