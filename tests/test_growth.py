"""Steps whose tasks must not grow with the square of a list, or with what a row visits."""

import numpy as np
from pyspark.sql import functions as F

from heronlake.operators import similarity, vector_index


def test_long_lists_meet_in_blocks(spark, monkeypatch):
    """A value's pairs go to several tasks, each once."""
    monkeypatch.setattr(similarity, "SIDE", 8)
    monkeypatch.setattr(similarity, "PAIRS", 100)
    rows = [(i, v) for v, n in (("hot", 50), ("rare", 3), ("one", 1)) for i in range(n)] + [(99, None)]
    df = spark.createDataFrame(rows, "x long, v string")
    met = similarity.meetings(df, df.withColumnRenamed("x", "y"), "v")
    found = met.withColumn("task", F.spark_partition_id()).collect()
    assert sorted((r.v, r.x, r.y) for r in found) == sorted((v, x, y) for x, v in rows for y, u in rows if u == v and v is not None)
    per_task = {t: sum(r.task == t for r in found) for t in {r.task for r in found}}
    assert len(per_task) > 5 and max(per_task.values()) < 50 * 50 / 2


def test_visits_are_copied_a_few_at_a_time(spark, monkeypatch):
    """Every vector visits all cells here, and no batch has more copies than VISITS."""
    monkeypatch.setattr(vector_index, "VISITS", 7)
    m = np.random.default_rng(1).normal(size=(40, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "k long, v array<double>").coalesce(1)
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    found = {(r.a, r.b) for r in vector_index.near_pairs(df, "k", "v", -1.0).collect()}
    assert found == {(a, b) for a in range(40) for b in range(a + 1, 40)}
    centres = unit[:5]
    visits = vector_index._visits(vector_index.usable(df, "k", "v"), centres, np.zeros(5), np.full(5, 3.2), 3.2, None)
    sizes = visits.mapInArrow(lambda batches: (b for b in batches), visits.schema).count()
    assert sizes == 200
