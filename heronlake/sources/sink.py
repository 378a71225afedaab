"""A keyed table that batches are added to exactly once.

``data/<batch>`` holds a batch's rows as Parquet, ``ledger/<batch>`` one small file with its
counts, created once the rows are whole.  Readers take only batches of the ledger, so a
batch that died half-way is invisible and is written anew; a batch that is in the ledger is
never written again.  Both folders lie in shared storage and are reached through Hadoop's
file systems only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heronlake.sources.storage import new_path


class KeyedTable:
    """Rows with distinct, non-null *key*; the first one that comes stays."""

    def __init__(self, spark: SparkSession, schema: str | T.StructType, key: str, path: str | None = None):
        self.spark, self.key = spark, key
        self.schema = spark.createDataFrame([], schema).schema
        self.path = path or new_path(spark, "keyed")

    def _file(self, *parts: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def batches(self) -> list[str]:
        """Batches whose rows are whole."""
        files, where = self._file("ledger")
        return sorted(x.getPath().getName() for x in files.listStatus(where)) if files.exists(where) else []

    def read(self) -> DataFrame:
        paths = [f"{self.path}/data/{b}" for b in self.batches()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def batch(self, batch: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{batch}")

    def counts(self, batch: str) -> dict[str, int]:
        files, where = self._file("ledger", batch)
        stream = files.open(where)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def insert(self, rows: DataFrame, batch: str, order: str | None = None) -> dict[str, int]:
        """Add the *rows* whose key isn't there yet, of equal ones the first by *order*: what came and what was new.

        Rows without key are dropped.  A *batch* that is whole already is left as it is.
        """
        if batch in self.batches():
            return self.counts(batch)
        came, added = Observation(), Observation()
        rows = rows.select(*self.schema.names).observe(came, F.count("*").alias("rows"), F.count(self.key).alias("keyed"))
        keep = F.struct(*self.schema.names)
        one = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(F.min_by(keep, F.col(order) if order else keep).alias("_row")).select("_row.*")
        fresh = one.join(self.read().select(self.key), self.key, "left_anti").select(*self.schema.names).observe(added, F.count("*").alias("new"))
        fresh.write.mode("overwrite").parquet(f"{self.path}/data/{batch}")
        found = {"rows": came.get["rows"], "keyed": came.get["keyed"], "new": added.get["new"]}
        self.publish(batch, found)
        return found

    def publish(self, batch: str, counts: dict[str, int]) -> None:
        """Make a batch visible: the one step that can't be half done."""
        files, where = self._file("ledger", batch)
        out = files.create(where, False)
        out.write(json.dumps(counts).encode())
        out.close()
