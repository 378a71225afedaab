"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

The leaves of the tree are the positions of a piece's symbols; leaf ``i`` holds
``rank * width + i`` for the pair (symbol i, next symbol), or NONE.  The root, the
minimum of all leaves, is therefore the leftmost pair of the lowest rank.  A merge
changes three leaves, each repaired on the way to the root, until the root is NONE.

Short pieces are merged together, one tree per row of a numpy matrix; a long piece
has a tree of its own.  A bounded memo keeps what frequent pieces encode to.

Null text counts as empty and encodes to no ids.  Repeated rows encode alike.  Only
the key and text columns are read, so clashing names of other columns don't matter.
"""

from __future__ import annotations

import contextlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import chunks, mapped, spans

#: Fixed value: how the vocabulary's byte-level pre-tokenizer splits text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that the vocabulary's library (Unicode 16) takes for neither letters
#: nor numbers, though later Unicode tables do.
LATER = (
    r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1"
    r"\uab6c-\uab6d\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a"
    r"\U00011db0-\U00011ddb\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686"
    r"\U00016ea0-\U00016eb8\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda"
    r"\U00018d09-\U00018d20\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128"
    r"\U0001b168\U0001d6a6\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff"
    r"\U0001e6c0-\U0001e6de\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4"
    r"\U0001e6fe-\U0001e6ff\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479"
    r"\U0003d000-\U0003fc3f"
)
#: The same split where a text holds some of these.
PINNED = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[\p{{L}}--[{LATER}]]+| ?[\p{{N}}--[{LATER}]]+| ?[[^\s\p{{L}}\p{{N}}]||[{LATER}]]+|\s+(?!\S)|\s+"
#: Pieces of more bytes get a tree of their own.
LONG = 64
#: Pieces whose ids a worker remembers at least; at most twice as many and a step's.
MEMO = 160_000
#: Bytes of text encoded at once.
STEP = 700_000
NONE = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabulary files: printable
    bytes stand for themselves, the rest are numbered from 256 on, in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class BytePairCodec:
    """Encode and decode with the vocabulary in a ``tokenizers`` JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab = byte_letters(), spec["model"]["vocab"]
        raw = {token: bytes(letters[c] for c in token) for token in vocab if all(c in letters for c in token)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, data in raw.items():
            self.bytes_of[vocab[token]] = data
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.first = np.zeros(256, np.int64)
        for token, data in raw.items():
            if len(data) == 1:
                self.first[data[0]] = vocab[token]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        code = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        self._slots(code)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.rank_of = dict(zip(code.tolist(), range(len(merges)), strict=True))
        self.split, self.pinned, self.later = regex.compile(PIECES), regex.compile(PINNED, regex.V1), regex.compile(f"[{LATER}]")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        # ids of pieces, as the bytes of 32-bit integers: joining these makes an array of ids
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return (self.split if text.isascii() or not self.later.search(text) else self.pinned).findall(text)

    # one tree per piece -------------------------------------------------
    def merge_long(self, data: bytes) -> bytes:
        """Ids of one piece of any length: a merge costs a logarithmic number of steps."""
        n = len(data)
        width = 1 << max(1, (n - 1).bit_length())
        symbol, after, before = self.first[np.frombuffer(data, np.uint8)].tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank_of, none, made = self.rank_of, int(NONE), self.made

        def leaf(i: int) -> int:
            if i < 0 or after[i] >= n:
                return none
            rank = rank_of.get(symbol[i] << 32 | symbol[after[i]])
            return none if rank is None else rank * width + i

        tree = [none] * width + [leaf(i) for i in range(n)] + [none] * (width - n)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int, key: int) -> None:
            i += width
            tree[i] = key
            while i > 1:
                i >>= 1
                low = min(tree[2 * i], tree[2 * i + 1])
                if tree[i] == low:
                    break
                tree[i] = low

        while (root := tree[1]) != none:
            i = root % width
            j = after[i]
            symbol[i], after[i] = int(made[root // width]), after[j]
            if after[i] < n:
                before[after[i]] = i
            symbol[j] = -1
            put(j, none)
            put(i, leaf(i))
            if before[i] >= 0:
                put(before[i], leaf(before[i]))
        return np.array([x for x in symbol if x >= 0], np.int32).tobytes()

    # many trees at once -------------------------------------------------
    def _slots(self, code: np.ndarray) -> None:
        """A hash table of pair codes for numpy: a pair is at most ``self.steps`` slots after its own."""
        self.shift = np.uint64(64 - 19)
        self.codes, self.ranks, self.steps = np.full(1 << 19, -1, np.int64), np.zeros(1 << 19, np.int64), 0
        rest, at = np.arange(len(code)), self._slot(code)
        while len(rest):
            self.steps += 1
            free = self.codes[at] < 0
            self.codes[at[free]] = code[rest[free]]
            put = self.codes[at] == code[rest]
            self.ranks[at[put]] = rest[put]
            rest, at = rest[~put], (at[~put] + 1) & (len(self.codes) - 1)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _keys(self, left: np.ndarray, right: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
        """Leaf values for pairs; right < 0 means there is no next symbol."""
        code = np.where(right >= 0, left << 32 | right, -2)
        slot = self._slot(code)
        out = np.where(self.codes[slot] == code, self.ranks[slot] * width + at, NONE)
        open_ = np.flatnonzero((out == NONE) & (self.codes[slot] >= 0) & (code >= 0))
        for _ in range(self.steps - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (len(self.codes) - 1)
            there = self.codes[slot[open_]]
            hit = open_[there == code[open_]]
            out[hit] = self.ranks[slot[hit]] * width + at[hit]
            open_ = open_[(there >= 0) & (there != code[open_])]
        return out

    def merge_rows(self, pieces: list[bytes], width: int) -> list[bytes]:
        """Ids of pieces of at most *width* bytes each (a power of two): row r of the matrix is piece r's tree."""
        count = len(pieces)
        data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(count, width)
        size = np.fromiter(map(len, pieces), np.int64, count)
        at = np.broadcast_to(np.arange(width), (count, width))
        symbols = np.where(at < size[:, None], self.first[data], -1)
        following = np.full((count, width), -1, np.int64)
        following[:, :-1] = symbols[:, 1:]
        trees = np.full((count, 2 * width), NONE, np.int64)
        trees[:, width:] = self._keys(symbols.ravel(), np.where(symbols >= 0, following, -1).ravel(), at.ravel(), width).reshape(count, width)
        level = width
        while level > 1:
            level >>= 1
            trees[:, level : 2 * level] = np.minimum(trees[:, 2 * level : 4 * level : 2], trees[:, 2 * level + 1 : 4 * level : 2])
        # flat views: cell (row, i) of a matrix is at row * width + i
        symbol, tree = symbols.ravel(), trees.ravel()
        after, before = (at + 1).ravel(), (at - 1).ravel()
        levels = width.bit_length() - 1

        def repair(base: np.ndarray, leaf: np.ndarray) -> None:
            leaf = leaf + width
            for _ in range(levels):
                leaf = leaf >> 1
                low = base + 2 * leaf
                tree[base + leaf] = np.minimum(tree[low], tree[low + 1])

        rows = np.flatnonzero(trees[:, 1] != NONE)
        while len(rows):
            own, base, n = rows * width, rows * (2 * width), size[rows]
            root = tree[base + 1]
            i = root % width
            j = after[own + i]
            k = after[own + j]
            made = self.made[root // width]
            symbol[own + i], symbol[own + j], after[own + i] = made, -1, k
            inside = k < n
            before[(own + k)[inside]] = i[inside]
            tree[base + width + j] = NONE
            tree[base + width + i] = self._keys(made, np.where(inside, symbol[own + np.minimum(k, width - 1)], -1), i, width)
            h = before[own + i]
            left = np.maximum(h, 0)
            some = h >= 0
            tree[(base + width + left)[some]] = self._keys(symbol[own + left], np.where(some, made, -1), left, width)[some]
            # where no symbol is on the left, its path is repaired in vain
            repair(np.concatenate([base, base, base]), np.concatenate([j, i, left]))
            rows = rows[tree[base + 1] != NONE]
        live = symbols >= 0
        flat, ends = symbols[live].astype(np.int32).tobytes(), (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that aren't in the memo."""
        ids: dict[str, bytes] = {}
        widths: dict[int, tuple[list[str], list[bytes]]] = {}
        for piece in pieces:
            data = piece.encode()
            if len(data) > LONG:
                ids[piece] = self.merge_long(data)
            else:
                names, group = widths.setdefault(1 << max(1, (len(data) - 1).bit_length()), ([], []))
                names.append(piece)
                group.append(data)
        for width, (names, group) in widths.items():
            for start in range(0, len(group), 4096):
                ids.update(zip(names[start : start + 4096], self.merge_rows(group[start : start + 4096], width), strict=True))
        return ids

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, list[int]]:
        """Ids of all texts on end, and where each text's end; a special token's string becomes its id."""
        keys: list[str] = []
        ends: list[int] = []
        marks: list[tuple[int, int]] = []
        for text in texts:
            for i, part in enumerate(self.cut.split(text) if self.cut else [text]):
                if i % 2:
                    marks.append((len(keys), self.special[part]))
                    keys.append("")
                elif part:
                    keys += self.pieces(part)
            ends.append(len(keys))
        found = list(map(self.memo.get, keys))
        for at, token in marks:
            found[at] = np.int32(token).tobytes()
        missing, at = [], -1
        with contextlib.suppress(ValueError):  # where there is none left
            while True:
                missing.append(at := found.index(None, at + 1))
        if missing:
            wanted = {keys[i] for i in missing}
            fresh = {k: self.old[k] for k in wanted & self.old.keys()}
            fresh |= self.learn(wanted - fresh.keys())
            for i in missing:
                found[i] = fresh[keys[i]]
            self.memo.update((k, x) for k, x in fresh.items() if len(k) <= LONG)
            if len(self.memo) > MEMO:  # what isn't asked for until the next MEMO pieces are known is forgotten
                self.old, self.memo = self.memo, {}
        sizes = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
        return np.frombuffer(b"".join(found), np.int32), [int(sizes[e - 1]) if e else 0 for e in ends]

    def encode_many(self, texts: list[str]) -> list[list[int]]:
        flat, ends = self.encode_flat(texts)
        return [flat[a:b].tolist() for a, b in zip([0, *ends], ends, strict=False)]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def decode_flat(self, flat: np.ndarray, ends: list[int]) -> list[str]:
        """Texts of ids on end, *ends* telling where each text's end."""
        return [self.decode(flat[a:b].tolist()) for a, b in zip([0, *ends], ends, strict=False)]


@lru_cache(maxsize=2)
def codec(path: str) -> BytePairCodec:
    return BytePairCodec(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: *key*, ``ids`` array<int>.  *path* must exist on every worker."""
    return _coded(docs, path, key, text, ())


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """*key*, ``ids`` and ``decoded``, what :func:`decode` makes of the ids, in one pass of one worker."""
    return _coded(docs, path, key, text, ("decoded",))


def _coded(docs: DataFrame, path: str, key: str, text: str, more: tuple[str, ...]) -> DataFrame:
    source = docs.select(F.col(key), F.col(text).alias("text"))
    schema = T.StructType([source.schema[key], T.StructField("ids", T.ArrayType(T.IntegerType(), False)), *(T.StructField(c, T.StringType()) for c in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for part, texts in chunks(batches, "text", STEP):
            flat, ends = tool.encode_flat(texts)
            ids = pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pa.array(flat))
            decoded = [pa.array(tool.decode_flat(flat, ends), pa.string())] if more else []
            yield pa.RecordBatch.from_arrays([part.column(0), ids, *decoded], [key, "ids", *more])

    return mapped(source, run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """*encoded* with a column *out*: the text of its ids; null ids give the empty text."""
    if out in encoded.columns:
        raise ValueError(f"column {out} exists already")
    schema = T.StructType([*encoded.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            for start, stop in spans(pc.fill_null(pc.list_value_length(column), 0).to_pylist(), STEP // 4):
                part = batch.slice(start, stop - start)
                some = part.column(part.schema.get_field_index(ids))
                ends = np.cumsum(pc.fill_null(pc.list_value_length(some), 0).to_numpy(zero_copy_only=False)).tolist()
                texts = tool.decode_flat(some.flatten().to_numpy(), ends)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [f.name for f in schema.fields])

    return mapped(encoded, run, schema)
