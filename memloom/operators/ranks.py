"""Positions within groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.staging import stage


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "position", base: int = 1) -> DataFrame:
    """``df`` with the place of each row within its ``keys`` by ``order`` (nulls first), counted from ``base``.

    ``keys`` and ``order`` together must be unique. Rows are cut into ranges of (keys, order), so a group of any size is spread
    over as many of them as it fills; each piece is numbered on its own and moved on by the size of the pieces before it, of which
    there is one row a range and group. The cut is staged: a lost executor must not cut it anew while others keep the old one.
    """
    cut = stage(df.repartitionByRange(*keys, *order).withColumn("_piece", F.spark_partition_id()))
    sizes = cut.groupBy(*keys, "_piece").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    later = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where("_before > 0").drop("_n")
    marks = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    later = later.select(*marks, F.col("_piece").alias("_p"), "_before")
    met = F.col("_piece") == F.col("_p")
    for i, k in enumerate(keys):
        met = met & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    within = cut.withColumn("_at", F.row_number().over(Window.partitionBy("_piece", *keys).orderBy(*order)))
    placed = within.join(later, met, "left")
    return placed.select(*df.columns, (F.col("_at") + F.coalesce("_before", F.lit(0)) + (base - 1)).cast("long").alias(name))
