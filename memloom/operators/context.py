"""Filling a bounded context from ranked items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def round_robin(df: DataFrame, query: str, source: str, rank: str, limit: int) -> DataFrame:
    """First items of all sources, then all second ones and so on: ``query``, ``source``, ``rank``, position; at most ``limit``."""
    per = Window.partitionBy(query, source).orderBy(rank)
    turns = df.withColumn("turn", F.row_number().over(per)).where(F.col("turn") <= limit)
    order = Window.partitionBy(query).orderBy("turn", source)
    return turns.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit)


def ranked_fit(items: Column, budget: int, most: int) -> Column:
    """Ids of the items that fit: in rank order, an item that would exceed the budget is passed over, not an end.

    ``items``: array of structs (rank, size, id), of bounded length. Separators and brackets of a JSON array count.
    """
    start = F.struct(F.lit(2).cast("long").alias("used"), F.array().cast("array<string>").alias("ids"))

    def add(acc: Column, x: Column) -> Column:
        cost = x["size"] + F.when(F.size(acc.ids) > 0, 1).otherwise(0)
        fits = (F.size(acc.ids) < most) & (acc.used + cost <= budget)
        return F.when(fits, F.struct((acc.used + cost).alias("used"), F.array_append(acc.ids, x.id).alias("ids"))).otherwise(acc)

    return F.aggregate(F.array_sort(items), start, add, lambda acc: acc.ids)
