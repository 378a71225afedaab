"""Joins of vectors by angle, through cells around pivots.

A bounded sample of the right side's vectors are *pivots*; each right vector lives in the cell
of its nearest pivot.  A left vector visits only the cells that can hold a neighbour: by the
triangle inequality of angles, cells whose members' angles to the pivot come within the
threshold of its own, and whose pivot is at most twice the threshold farther than its
nearest one.  So the join is exact; how much it saves depends on how far the vectors cluster
(vectors without any structure visit most cells, in blocks).  With ``probes`` only the nearest
cells are visited: faster, and the recall is to be measured.

Cells are met in blocks of about BLOCK rows on either side, so no task holds more than
two blocks, however full a cell is.  Zero vectors, nulls and vectors of another length than
most of the right side's have no neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.functions import vector

PIVOTS, BLOCK = 256, 2048
#: Copies of left vectors that a task makes at once.
VISITS = 8192
#: Slack of angles, for rounding.
SLACK = 1e-6


def usable(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """``k`` (long) and ``v`` (unit vector as array of double)."""
    return rows.select(F.col(key).cast("long").alias("k"), vector.unit(F.col(vec).cast("array<double>")).alias("v")).where("k IS NOT NULL AND v IS NOT NULL")


def pivots(rows: DataFrame, n: int, width: int) -> np.ndarray:
    """*n* different vectors of *rows* of *width* components at most: those of least hash."""
    found = rows.where(F.size("v") == width).select("v").distinct().orderBy(F.xxhash64("v")).limit(n).collect()
    return np.array([r.v for r in found]).reshape(-1, width)


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have *width* components, and those rows as a matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    fits = np.asarray(lists.value_lengths()) == width
    lists = lists.filter(pa.array(fits))
    return np.flatnonzero(fits), np.asarray(lists.flatten()).reshape(-1, width)


def angles(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ centres.T, -1.0, 1.0))


def _at_home(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, m = matrix(batch.column(1), centres.shape[1])
            a = angles(m, centres)
            cell = a.argmin(axis=1)
            b = batch.take(pa.array(kept))
            yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(a[np.arange(len(cell)), cell]), b.column(0), b.column(1)], ["cell", "angle", "k", "v"])

    return rows.mapInArrow(run, "cell int, angle double, k long, v array<double>")


def _visits(rows: DataFrame, centres: np.ndarray, low: np.ndarray, high: np.ndarray, theta: float, probes: int | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, m = matrix(batch.column(1), centres.shape[1])
            a = angles(m, centres)
            near = (a <= high + theta + SLACK) & (a >= low - theta - SLACK) & (a <= a.min(axis=1)[:, None] + 2 * theta + SLACK)
            if probes is not None and probes < len(centres):
                a = np.where(near, a, np.inf)
                near &= a <= np.partition(a, probes - 1, axis=1)[:, probes - 1 : probes]
            row, cell = np.nonzero(near)
            # a row may visit all cells: copies are made a few at a time
            for i in range(0, len(row), VISITS):
                b = batch.take(pa.array(kept[row[i : i + VISITS]]))
                yield pa.RecordBatch.from_arrays([pa.array(cell[i : i + VISITS].astype(np.int32)), b.column(0), b.column(1)], ["cell", "k", "v"])

    return rows.mapInArrow(run, "cell int, k long, v array<double>")


def near(left: DataFrame, left_key: str, left_vec: str, right: DataFrame, right_key: str, right_vec: str, cosine: float, most: int = PIVOTS, block: int = BLOCK, probes: int | None = None) -> DataFrame:
    """``a`` (of *left*), ``b`` (of *right*) and ``score`` of the pairs with a cosine of *cosine* or more.

    Keys are whole numbers.  At most *most* pivots are used, the root of *right*'s rows if that is less.
    """
    spark, x, y = left.sparkSession, usable(left, left_key, left_vec), usable(right, right_key, right_vec)
    # a row per length of vector: the commonest counts
    common = y.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").first()
    n_left = x.count()
    if not n_left or not common:
        return spark.createDataFrame([], "a long, b long, score double")
    centres = pivots(y, min(most, max(1, math.isqrt(common.n))), common.width)
    home = _at_home(y, centres)
    low, high, chunks = np.full(len(centres), np.inf), np.full(len(centres), -np.inf), [1] * len(centres)
    for r in home.groupBy("cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count("*").alias("n")).collect():  # a row per pivot
        low[r.cell], high[r.cell], chunks[r.cell] = r.low, r.high, -(-r.n // block)
    visits, width = _visits(x, centres, low, high, math.acos(max(-1.0, min(1.0, cosine))), probes), centres.shape[1]

    # a cell's rows are parted into blocks; every block of one side meets every one of the other
    parts, turns = F.element_at(F.array(*map(F.lit, chunks)), F.col("cell") + 1), -(-n_left // block)
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    home = home.select("cell", F.pmod(F.xxhash64("k"), parts).cast("int").alias("h"), spread(F.lit(turns)).alias("w"), "k", "v")
    visits = visits.select("cell", spread(parts).alias("h"), F.pmod(F.xxhash64("k"), F.lit(turns)).cast("int").alias("w"), "k", "v")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        i = j = np.zeros(0, np.int64)
        score = np.zeros(0)
        if len(a) and len(b):
            found = matrix(a.column("v"), width)[1] @ matrix(b.column("v"), width)[1].T
            i, j = np.nonzero(found >= cosine)
            score = found[i, j]
        return pa.table({"a": np.asarray(a.column("k"))[i] if len(a) else i, "b": np.asarray(b.column("k"))[j] if len(b) else j, "score": score}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())]))

    keys = ["cell", "h", "w"]
    return visits.groupBy(*keys).cogroup(home.groupBy(*keys)).applyInArrow(meet, "a long, b long, score double")


def near_pairs(rows: DataFrame, key: str, vec: str, cosine: float, **bounds: int | None) -> DataFrame:
    """``a`` < ``b`` and ``score``: pairs of *rows* with a cosine of *cosine* or more.

    Many equal vectors give the square of their number: collapse them first where links will do.
    """
    return near(rows, key, vec, rows, key, vec, cosine, **bounds).where("a < b")


def best(found: DataFrame) -> DataFrame:
    """For each ``a`` of :func:`near` the ``b`` of greatest score (ties: the least)."""
    return found.groupBy("a").agg(F.max_by("b", F.struct("score", -F.col("b"))).alias("b"), F.max("score").alias("score"))
