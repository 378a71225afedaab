"""Quality classifier: a linear-chain conditional random field over the lines of a text.

Each line is labelled good (1) or bad (0).  Features of a line are its own measurements
and those of the lines before and after it; transition weights tie neighbours together.
A document's quality is the mean of its lines' forward-backward marginals for "good",
weighted by length.  Training is weakly supervised (a document's label stands for each
of its lines) and maximises the conditional likelihood on the driver, over a sample of
at most ``SAMPLE`` labelled documents of at most ``SAMPLE_LINES`` lines.

Labels, language, source and keys are never features.  Null texts count as empty: one
empty line.  Without labelled rows of both kinds every score is 0.5.  Repeated rows score
alike; very long texts are scored whole (steps are bounded by bytes); an empty table gives
an empty table; only key and text are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.llm.common import chunks, mapped, positional

#: The bounds of the training sample.
SAMPLE, SAMPLE_LINES = 3000, 120
_UPPER, _DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MARKS = b"#*$%&|<>{}[]=~^_\\@"
OWN = 14
WIDTH = 1 + 3 * OWN


def line_features(line: bytes, seen: set) -> list[float]:
    """OWN measurements of one line."""
    w = line.split()
    n, size = len(w), len(line)
    if not n:
        return [0.0] * (OWN - 1) + [1.0]
    letters = max(1, size - n + 1)
    count = lambda chars: size - len(line.translate(None, chars))
    pairs = len(set(zip(w, w[1:], strict=False)))
    again = float(line in seen)
    seen.add(line)
    return [
        math.log1p(n) / 5, min(1.0, count(_MARKS) / n), count(_UPPER) / letters, count(_DIGIT) / letters,
        1 - len(set(w)) / n, (1 - pairs / (n - 1)) if n > 1 else 0.0, letters / n / 10, min(1.0, count(b"!?") / n),
        float(line.rstrip()[-1:] in b".!?:;\""), min(1.0, count(b"|") / n), min(1.0, count(b".,;") / n), again, float(n < 5), 0.0,
    ]


def text_features(text: str) -> tuple[list[list[float]], list[int]]:
    """Features of all lines, neighbours' included, and the lines' weights (their lengths, at least 1)."""
    seen: set = set()
    lines = text.encode().split(b"\n")
    own = [line_features(x, seen) for x in lines]
    none = [0.0] * OWN
    before, after = [none, *own[:-1]], [*own[1:], none]
    return [[1.0, *a, *b, *c] for a, b, c in zip(own, before, after, strict=True)], [max(1, len(x)) for x in lines]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # WIDTH: log-odds of good from the features
    stay: np.ndarray  # 2 x 2: transition scores

    def score(self, texts: list[str]) -> list[float]:
        rows, sizes, out = [], [], []
        for x in texts:
            f, n = text_features(x)
            rows.extend(f)
            sizes.append(n)
        odds = np.exp(np.clip(np.array(rows) @ self.weights, -30, 30)).tolist()
        (a00, a01), (a10, a11) = np.exp(self.stay).tolist()
        at = 0
        for n in sizes:
            e = odds[at : at + len(n)]
            at += len(n)
            # forward: share of "good" among both states' forward weights
            p, forward = 0.5, []
            for i, o in enumerate(e):
                bad, good = (1.0, o) if i == 0 else ((1 - p) * a00 + p * a10, ((1 - p) * a01 + p * a11) * o)
                p = good / (bad + good)
                forward.append(p)
            b0 = b1 = 1.0
            total = 0.0
            for i in range(len(e) - 1, -1, -1):
                good, bad = forward[i] * b1, (1 - forward[i]) * b0
                total += n[i] * (good / (good + bad) if good + bad else 0.5)
                b0, b1 = a00 * b0 + a01 * e[i] * b1, a10 * b0 + a11 * e[i] * b1
                scale = b0 + b1
                b0, b1 = b0 / scale, b1 / scale
            out.append(min(1.0, max(0.0, total / sum(n))))
        return out


def train(sequences: list[np.ndarray], labels: list[int], steps: int = 150, rate: float = 0.15, l2: float = 1e-3) -> Model:
    """Maximise the regularised conditional likelihood of "every line has its document's label" (Adam)."""
    theta = np.zeros(WIDTH + 4)
    if len(set(labels)) < 2:
        return Model(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))
    order = np.argsort([len(s) for s in sequences], kind="stable")
    groups = []
    for start in range(0, len(order), 256):  # sequences of similar length, padded together
        ids = order[start : start + 256]
        longest = max(len(sequences[i]) for i in ids)
        x = np.zeros((len(ids), longest, WIDTH))
        for k, i in enumerate(ids):
            x[k, : len(sequences[i])] = sequences[i]
        groups.append((x, np.array([len(sequences[i]) for i in ids]), np.array([labels[i] for i in ids])))
    lines = sum(len(s) for s in sequences)
    mean, spread = np.zeros(WIDTH + 4), np.zeros(WIDTH + 4)
    for step in range(1, steps + 1):
        slope = np.zeros(WIDTH + 4)
        a = theta[WIDTH:].reshape(2, 2)
        for x, size, y in groups:
            count, longest, _ = x.shape
            emit = np.zeros((count, longest, 2))
            emit[:, :, 1] = x @ theta[:WIDTH]
            inside = np.arange(longest) < size[:, None]
            forward, backward = np.zeros((count, longest, 2)), np.zeros((count, longest, 2))
            forward[:, 0] = emit[:, 0]
            for t in range(1, longest):
                forward[:, t] = np.logaddexp.reduce(forward[:, t - 1, :, None] + a, axis=1) + emit[:, t]
            for t in range(longest - 2, -1, -1):
                b = np.logaddexp.reduce(a + (emit[:, t + 1] + backward[:, t + 1])[:, None, :], axis=2)
                backward[:, t] = np.where(inside[:, t + 1, None], b, 0.0)
            z = np.logaddexp.reduce(forward[np.arange(count), size - 1], axis=1)
            good = np.exp(forward[:, :, 1] + backward[:, :, 1] - z[:, None]) * inside
            slope[:WIDTH] += np.einsum("dtf,dt->f", x, (y[:, None] - good) * inside)
            if longest > 1:
                both = np.exp(forward[:, :-1, :, None] + a + (emit[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * inside[:, 1:, None, None]
                seen = np.zeros((2, 2))
                np.add.at(seen, (y, y), size - 1)
                slope[WIDTH:] += (seen - both.sum(axis=(0, 1))).ravel()
        slope = slope / lines - l2 * theta
        mean, spread = 0.9 * mean + 0.1 * slope, 0.999 * spread + 0.001 * slope**2
        theta = theta + rate * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.999**step)) + 1e-8)
    return Model(theta[:WIDTH], theta[WIDTH:].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, sample_lines: int = SAMPLE_LINES) -> Model:
    """Train on *labels* (*key*, *label* 0 or 1; several rows of a key: the least label) of rows in *docs*.

    The sample is the *sample* keys of least hash (of rows that repeat a key the greatest
    text); of those, texts of more lines than *sample_lines* are left out whole.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("k")).agg(F.min(label).cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("text")).join(F.broadcast(chosen), "k")
    # of repeated keys one row, so that the sample doesn't depend on the order of rows
    rows = rows.groupBy("k").agg(F.first("y").alias("y"), F.max(F.coalesce("text", F.lit(""))).alias("text")).select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            short = [(y, x) for y, x in zip(part.column(0).to_pylist(), texts, strict=True) if x.count("\n") < sample_lines]
            data = [np.array(text_features(x)[0], np.float32).tobytes() for _, x in short]
            yield pa.RecordBatch.from_pydict({"y": pa.array([y for y, _ in short], pa.int32()), "x": pa.array(data, pa.binary())})

    found = sorted((r.y, bytes(r.x)) for r in mapped(rows, run, "y int, x binary").collect())
    return train([np.frombuffer(x, np.float32).reshape(-1, WIDTH).astype(float) for _, x in found], [y for y, _ in found])


def scores(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """*key* and ``score`` (0 to 1), one row per row of *docs*."""
    source = docs.select(F.col(key), F.col(text).alias("text"))
    schema = T.StructType([source.schema[key], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(texts), pa.float64())], [key, "score"])

    return mapped(source, run, schema)


def keep(docs: DataFrame, model: Model, text: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of *docs* that score *least* or more; columns stay as they are, whatever their names."""
    plain, (column,) = positional(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, column):
            yield part.filter(pa.array([s >= least for s in model.score(texts)], pa.bool_()))

    return mapped(plain, run, plain.schema).toDF(*docs.columns)
