"""Boundaries to outside models: embedding, translation, scoring, text generation.

A provider is a picklable function from a list of texts to a list of results (None where
it fails).  It runs in Arrow batches inside tasks; results are never zeros for failures.
``stub_embedding`` and ``stub_scores`` are deterministic stand-ins for tests.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Provider = Callable[[list[str]], list]


def apply_provider(df: DataFrame, text: str, out: str, kind: T.DataType, provider: Provider, batch: int = 100) -> DataFrame:
    """*df* with *out*: the provider's results for *text*, asked in batches; null or blank text gives null."""
    if out in df.columns:
        raise ValueError(f"column {out} exists already")
    schema, position = T.StructType([*df.schema.fields, T.StructField(out, kind)]), df.columns.index(text)
    arrow = {"string": pa.string(), "array<float>": pa.list_(pa.float32())}[kind.simpleString()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                texts = part.column(position).to_pylist()
                asked = [i for i, x in enumerate(texts) if x and x.strip()]
                found: list = [None] * len(texts)
                for i, r in zip(asked, provider([texts[i] for i in asked]) if asked else [], strict=True):
                    found[i] = r
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, arrow)], schema.names)

    return df.mapInArrow(run, schema)


def stub_embedding(texts: list[str], size: int = 16) -> list[list[float]]:
    return [[b / 255 - 0.5 for b in hashlib.sha256(x.encode()).digest()[:size]] for x in texts]


def stub_scores(texts: list[str]) -> list[str]:
    """JSON like a scoring model's: a tone from -1 to 1 and labels."""
    return [json.dumps({"tone": round(2 * hashlib.md5(x.encode()).digest()[0] / 255 - 1, 3), "labels": ["conflict"] if "!" in x else []}) for x in texts]
