"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size: it starts at
a hashed offset and steps by a hashed skip, which visits every slot once because the size
is prime.  Shards take turns (as often as their weights say) and claim their most
preferred free slot until the table is full, so slots are shared out evenly and most
keep their shard when a shard joins or leaves.  A row's slot is its key's hash modulo the
size; its shard is one look-up in the broadcast table, whose rows are bounded by the size.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.llm.common import positional, quoted

#: A prime; at least a hundred times the number of shards keeps shares within about 1 %.
SIZE = 65_537


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def _hash(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{purpose}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: dict[str, float] | list[str], size: int = SIZE) -> np.ndarray:
    """For each slot the position of its shard in *shards* (names, or weights over 0 by name)."""
    names = list(shards)
    weights = [float(shards[n]) for n in names] if isinstance(shards, dict) else [1.0] * len(names)
    if not names or len(set(names)) < len(names) or min(weights) <= 0:
        raise ValueError("shards need distinct names and weights over 0")
    if not is_prime(size) or size < len(names):
        raise ValueError("size must be a prime not below the number of shards")
    offset = [_hash(n, "offset") % size for n in names]
    skip = [_hash(n, "skip") % (size - 1) + 1 for n in names]
    top, credit = max(weights), [0.0] * len(names)
    table, free = np.full(size, -1, np.int64), size
    while free:
        for i in range(len(names)):
            credit[i] += weights[i] / top
            if credit[i] < 1 or not free:
                continue
            credit[i] -= 1
            while table[offset[i]] >= 0:
                offset[i] = (offset[i] + skip[i]) % size
            table[offset[i]] = i
            free -= 1
    return table


def place(df: DataFrame, key: str | list[str], shards: dict[str, float] | list[str], size: int = SIZE, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """*df* with columns *slot* and *shard*.

    Equal keys share a shard; a null key has the slot of "no key".  Give several columns
    as *key* to spread a hot one.  Repeated rows share a shard, an empty table gives an empty
    table.  Raises if *slot* or *shard* exists already.
    """
    if clash := {slot, shard} & set(df.columns):
        raise ValueError(f"columns exist already: {sorted(clash)}")
    spark, names = df.sparkSession, list(shards)
    table = lookup_table(shards, size)
    import pandas as pd

    known = spark.createDataFrame(pd.DataFrame({"slot": np.arange(size), "shard": [names[i] for i in table]}), "slot int, shard string")
    plain, keys = positional(df, *([key] if isinstance(key, str) else key))
    slots = plain.withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int"))
    return slots.join(F.broadcast(known), "slot").select(*plain.columns, "slot", "shard").toDF(*df.columns, slot, shard)


def write_shards(placed: DataFrame, path: str, shard: str = "shard", files_per_shard: int = 8) -> None:
    """One folder per shard.  Rows of a large shard are spread over several tasks and files."""
    spread = F.pmod(F.xxhash64(*(quoted(c) for c in placed.columns if c != shard)), F.lit(files_per_shard))
    placed.repartition(F.col(shard), spread).write.partitionBy(shard).parquet(path)
