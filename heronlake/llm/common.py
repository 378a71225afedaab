"""Helpers shared by the training-data operators: tables, Arrow batches, hashed folds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.sources.storage import forget, new_path, scratch, shared_dir, store, table, tidy  # noqa: F401

#: Characters of text that one Python step holds at once.
STEP_CHARS = 1_500_000
#: Bytes of an Arrow batch: rows may hold texts of any length.
BATCH_BYTES = 4 << 20
#: Rows of keys up to which a side is broadcast (about 32 MB as Spark holds them).
BROADCAST_KEYS = 1_000_000


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text (null: empty text) modulo *n*."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % n


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` over batches of bounded bytes.

    Spark's default bound is 64 MB a batch, held on both sides of each task; where the session
    doesn't set ``spark.sql.execution.arrow.maxBytesPerBatch``, it is set to BATCH_BYTES.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in conf.getAll:
        conf.set(name, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def quoted(name: str) -> Column:
    """The column of this very name, also if it holds dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def positional(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """*df* with columns named by place, and what those of *names* are called there: so that no name clashes
    with a helper's or reads as a path.  ``toDF(*df.columns)`` gives the names back."""
    plain = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*plain), [plain[df.columns.index(n)] for n in names]


def few(keys: DataFrame) -> DataFrame:
    """*keys* (a stored table, or a cheap plan over one), marked for broadcast where it is counted
    to have at most BROADCAST_KEYS rows."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def spans(sizes: list[int], limit: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Cut rows of these sizes into runs of about *limit*: first row and the row after the last."""
    start = total = 0
    for i, n in enumerate(sizes):
        total += n
        if total >= limit or i + 1 == len(sizes):
            yield start, i + 1
            start, total = i + 1, 0


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = STEP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut Arrow batches into runs of rows with about *limit* bytes of text; null texts become empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        for start, stop in spans(pc.fill_null(pc.binary_length(column), 0).to_pylist(), limit):
            yield batch.slice(start, stop - start), [x or "" for x in column.slice(start, stop - start).to_pylist()]
