"""Connected components of a distributed edge list, in a logarithmic number of rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronlake.sources.storage import forget, store


def components(edges: DataFrame) -> DataFrame:
    """Columns ``node``, ``root``: each node of *edges* (``a``, ``b``: long) with the least node it reaches.

    Large-star and small-star rounds alternate: each node hands its larger (then its
    smaller) neighbours to the least neighbour it knows, until every edge points at a
    root.  Each round's edges are written to the shared folder, so nothing is collected
    and a lost executor costs one round at most.  Null ends and loops give no edge; an
    empty edge list gives an empty table.
    """
    links = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    links = store(links, "links")
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = store(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(low, "a")
            .select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        after = store(small, "links")
        forget(large)
        total = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))
        changed = links.agg(F.count("*"), total).first() != after.agg(F.count("*"), total).first()
        forget(links)
        links = after
        if not changed:
            break
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
