"""Outlet groups, sides and coverage shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The four groups in tie-breaking order, and the factions that decide them.
GROUPS = ("principlist", "reformist", "moderate_diaspora", "radical_diaspora")
INSIDE_FIRST = ("hardline", "principlist")
OUTSIDE_RADICAL = ("opposition", "monarchist", "radical")


def narrative_group(location: str = "production_location", faction: str = "factional_alignment", state: str = "state_alignment", inside: str = "inside") -> Column:
    """Which of the four groups an outlet belongs to; null attributes fall to the milder group."""
    first = F.coalesce(F.col(faction).isin(*INSIDE_FIRST), F.lit(False)) | F.coalesce(F.col(state) == "state", F.lit(False))
    return F.when(F.col(location) == inside, F.when(first, GROUPS[0]).otherwise(GROUPS[1])).when(F.col(faction).isin(*OUTSIDE_RADICAL), GROUPS[3]).otherwise(GROUPS[2])


def side(group: Column) -> Column:
    return F.when(group.isin(*GROUPS[:2]), "inside").otherwise("outside")


def largest_remainder(counts: DataFrame, key: str, item: str, n: str, order: Column, out: str = "pct") -> DataFrame:
    """Integer percentages of *n* per *key* that sum to 100 (all 0 where the total is 0).

    Each share is floored; the missing points go to the largest remainders, ties by *order*.
    Remainders are compared as integers, so no rounding decides a tie.
    """
    per = Window.partitionBy(key)
    total = F.sum(n).over(per)
    parts = counts.withColumn("_t", total).withColumn("_f", F.when(F.col("_t") > 0, F.floor(F.col(n) * 100 / F.col("_t"))).otherwise(0).cast("long"))
    parts = parts.withColumn("_r", F.when(F.col("_t") > 0, F.col(n) * 100 % F.col("_t")).otherwise(0)).withColumn("_left", F.when(F.col("_t") > 0, 100 - F.sum("_f").over(per)).otherwise(0))
    rank = F.row_number().over(per.orderBy(F.col("_r").desc(), order))
    return parts.withColumn(out, (F.col("_f") + (rank <= F.col("_left")).cast("int")).cast("long")).drop("_t", "_f", "_r", "_left")
