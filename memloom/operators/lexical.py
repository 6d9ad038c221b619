"""BM25 over scopes: a term is looked up in its scope's postings, statistics are counted per scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.values import lexical_tokens
from memloom.staging import stage

#: Query terms that are broadcast, at most; with more of them the postings are joined by shuffles.
BROADCAST_TERMS = 200_000


def small(terms: DataFrame) -> DataFrame:
    """``terms``, to be broadcast if there are at most BROADCAST_TERMS of them."""
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


def bm25(docs: DataFrame, queries: DataFrame, k: int, scope: str = "scope", doc: str = "doc", text: str = "text", query: str = "query", k1: float = 1.2, b: float = 0.75, length: bool = False) -> DataFrame:
    """The best ``k`` documents of the query's scope: query, scope, doc, score, similarity, rank.

    ``queries`` is a stated set of (query, scope, text) rows; only postings of its terms are kept after counting.
    With ``length`` the number of its tokens comes along. Order is by (score descending, doc); a document without any query term is no hit.
    """
    asked = stage(queries.select(query, scope, lexical_tokens(text).alias("tokens")).select(query, scope, F.explode(F.array_distinct("tokens")).alias("term")))
    # A stated query set is small; then its terms meet the tokens where they are, and only postings asked for are shuffled.
    terms = small(asked.select(scope, "term").distinct())
    counted = docs.select(scope, doc, lexical_tokens(text).alias("tokens"))
    counted = counted.select(scope, doc, F.size("tokens").alias("len"), F.explode_outer("tokens").alias("term"))
    # One pass: a row a document and term asked for, and one with the length of each document.
    known = counted.join(terms.withColumn("asked", F.lit(True)), [scope, "term"], "left")
    tallied = stage(known.groupBy(scope, doc, "len", F.when(F.col("asked"), F.col("term")).alias("term")).agg(F.count("*").alias("tf")))
    lengths = tallied.groupBy(scope, doc).agg(F.first("len").alias("len"))
    sizes = lengths.groupBy(scope).agg(F.count("*").alias("n"), F.avg("len").alias("avg_len"))
    postings = tallied.where("term is not null")
    frequency = postings.groupBy(scope, "term").agg(F.count("*").alias("df"))
    known = asked.join(frequency, [scope, "term"]).join(sizes, scope)
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = postings.join(known, [scope, "term"]).groupBy(query, scope, doc).agg(F.sum(weight).alias("score"), F.first("len").alias("len"))
    best = Window.partitionBy(query).orderBy(F.desc("rounded"), doc)
    ranked = scored.withColumn("rounded", F.round("score", 9)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(query, scope, doc, F.round("score", 6).alias("score"), F.round(F.col("score") / (1 + F.col("score")), 6).alias("similarity"), "rank", *(["len"] if length else []))
