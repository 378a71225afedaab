"""Tables in shared storage: reading, cutting lineage, deleting."""

from __future__ import annotations

import contextlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session, else the one
    given to ``setCheckpointDir``.

    With neither, a local master gets a local folder of its own; a cluster has no folder that
    could be guessed, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = f"file:///tmp/checkpoints/heronlake-{uuid.uuid4().hex[:8]}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Paths of the tables stored meanwhile; those still listed at the end are deleted, so take out what is kept."""
    paths: list[str] = []
    _scratch.append(paths)
    try:
        yield paths
    finally:
        _scratch.remove(paths)
        for path in paths:
            _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


#: Whether Spark deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries that run meanwhile leave no shuffle files behind: for steps whose shuffles no later step can use."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write *df* into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    for paths in _scratch[-1:]:
        paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete the files under tables made by :func:`store` that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            _delete(spark, path)
