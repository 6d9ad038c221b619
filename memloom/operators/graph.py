"""Typed edges, and paths of one or two hops over them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators.ranks import positions


def half_edges(edges: DataFrame) -> DataFrame:
    """Each edge seen from either end: here, there, uuid, name, forward, valid_at."""
    out = edges.select(F.col("source").alias("here"), F.col("target").alias("there"), "uuid", "name", F.lit(True).alias("forward"), "valid_at")
    back = edges.select(F.col("target").alias("here"), F.col("source").alias("there"), "uuid", "name", F.lit(False).alias("forward"), "valid_at")
    return out.unionByName(back)


def typed_paths(edges: DataFrame, anchors: DataFrame, steps: Sequence[tuple[str, bool]], until: str | None = None) -> DataFrame:
    """Paths from ``anchors`` (anchor) along ``steps`` (edge name, forward): anchor, nodes, edges (arrays in order).

    The edges of a path differ. ``until`` keeps edges without a time or not after it. Each step is an equi-join on the
    node, on half-edges of the wanted name and direction only.
    """
    paths = anchors.select("anchor", F.col("anchor").alias("at"), F.array("anchor").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    for name, forward in steps:
        way = edges.where(F.col("name") == name)
        if until is not None:
            way = way.where(F.col("valid_at").isNull() | (F.col("valid_at") <= F.lit(until).cast("timestamp")))
        way = way.select(F.col("source" if forward else "target").alias("at"), F.col("target" if forward else "source").alias("there"), "uuid")
        paths = paths.join(way, "at").where(~F.array_contains("edges", F.col("uuid"))).select("anchor", F.col("there").alias("at"), F.array_append("nodes", F.col("there")).alias("nodes"), F.array_append("edges", F.col("uuid")).alias("edges"))
    return paths.select("anchor", "nodes", "edges")


def explore(edges: DataFrame, anchors: DataFrame, names: Sequence[str], scan: int = 256) -> DataFrame:
    """Simple paths of one or two hops over edges of ``names``, in either direction, at most ``scan`` an anchor.

    Shorter paths come first, then the order of edge ids; the bound is part of the operator. Columns: anchor, hops,
    nodes, edges, position.

    A node with very many edges does not multiply: an anchor with ``scan`` neighbours has no room for longer paths, and of a
    middle node only the first edges can be in an anchor's first ``scan`` paths: so many, one for the edge that led there, and as many as
    may lead straight back.
    """
    half = half_edges(edges.where(F.col("name").isin(*names)))
    near = anchors.join(half.withColumnRenamed("here", "anchor"), "anchor").select("anchor", F.col("there").alias("mid"), F.col("uuid").alias("first"))
    by_edge = Window.partitionBy("anchor").orderBy("first", "mid")
    one = near.withColumn("_n", F.row_number().over(by_edge)).where(F.col("_n") <= scan).drop("_n")
    roomy = one.groupBy("anchor").agg(F.count("*").alias("_m")).where(F.col("_m") < scan).select("anchor")
    back = half.groupBy("here", "there").agg(F.count("*").alias("_p")).groupBy("here").agg(F.max("_p").alias("_p"))
    onward = positions(half.select("here", "there", "uuid", "forward"), ["here"], ["uuid", "forward"], "_at").join(back, "here").where(F.col("_at") <= scan + 1 + F.col("_p"))
    two = one.join(roomy, "anchor").join(onward.select(F.col("here").alias("mid"), F.col("there").alias("last"), F.col("uuid").alias("second")), "mid").where("last <> anchor and second <> first")
    found = one.select("anchor", F.lit(1).alias("hops"), F.array("anchor", "mid").alias("nodes"), F.array("first").alias("edges")).unionByName(
        two.select("anchor", F.lit(2).alias("hops"), F.array("anchor", "mid", "last").alias("nodes"), F.array("first", "second").alias("edges"))
    )
    order = Window.partitionBy("anchor").orderBy("hops", "edges", "nodes")
    return found.withColumn("position", F.row_number().over(order)).where(F.col("position") <= scan)


def demote_prefixes(paths: DataFrame) -> DataFrame:
    """``paths`` (anchor, edges, position) with ``extended``: whether another path of the anchor continues this one."""
    heads = paths.where(F.size("edges") > 1).select("anchor", F.slice("edges", 1, 1).alias("edges")).distinct().withColumn("extended", F.lit(True))
    return paths.join(heads, ["anchor", "edges"], "left").withColumn("extended", F.coalesce("extended", F.lit(False)))
