"""Ranks, cuts and detections that build on the other queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions.keys import clean_id, trimmed
from memloom.operators import lexical
from memloom.plans.filter_queries import memories, messages
from memloom.plans.registry import Registry, sql_id, sql_trim
from memloom.plans.retrieval_queries import _BM25, _documents, _positions, _POS, _questions
from memloom.providers import QuotedEvidence
from memloom.sources.tables import table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

#: Phrases that tell a question's operation and temporal view, in order of precedence.
COUNT = r"次数|数量|总数|(?:几|多少)(?:次|个|条|项|场|笔|件|份|人|本|趟)"
LISTING = "哪些|列出"
VIEWS = (("planned", "计划|打算|准备|将要|将来"), ("prior", "以前|过去|曾经|历史|去年|之前|已经完成|已经结束"), ("current", "现在|目前|如今|当前"))


@R.query(f"""select delivery_id, case when regexp_matches(text, '{COUNT}') then 'count' when regexp_matches(text, '{LISTING}') then 'list' else 'lookup' end as operation,
 case when regexp_matches(text, '{VIEWS[0][1]}') then 'planned' when regexp_matches(text, '{VIEWS[1][1]}') then 'prior' when regexp_matches(text, '{VIEWS[2][1]}') then 'current' else 'unbounded' end as temporal_view
from messages where text is not null""")
def c08_operation_and_view(spark: SparkSession, d: str) -> DataFrame:
    view = F.lit("unbounded")
    for name, words in reversed(VIEWS):
        view = F.when(F.col("text").rlike(words), name).otherwise(view)
    operation = F.when(F.col("text").rlike(COUNT), "count").when(F.col("text").rlike(LISTING), "list").otherwise("lookup")
    return messages(spark, d).where("text is not null").select("delivery_id", operation.alias("operation"), view.alias("temporal_view"))


@R.query(f"select memory_id from memories where {sql_trim('content')} <> '' and len(evidence) > 0")
def f18_supported_only(spark: SparkSession, d: str) -> DataFrame:
    """Keeps what the verifier supports; what it can't assess is dropped, not passed."""
    rows = memories(spark, d).select("memory_id", F.coalesce(trimmed("content"), F.lit("")).alias("claim"), F.coalesce(F.size("evidence"), F.lit(0)).alias("cited"))
    return rows.where(QuotedEvidence().verdict(F.col("claim"), F.col("cited")) == "supported").select("memory_id")


@R.query("""select v.vec_id, v.label, d.source, d.lang from embeddings v join documents d on d.doc_id = v.vec_id where d.lang = 'en'""")
def j01_vectors_with_records(spark: SparkSession, d: str) -> DataFrame:
    """Vectors joined with the records they stand for, under a record filter that reaches the scan."""
    records = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("vec_id"), "source", "lang")
    return table(spark, d, "embeddings").select("vec_id", "label").join(records, "vec_id")


@R.query(f"""with h as (with {_BM25} select query, doc, rank from bm where rank <= 20), s as (select h.query, h.doc, h.rank, length(d.text) n from h join documents d on d.doc_id = h.doc)
select query, doc, position from (select query, doc, row_number() over (partition by query order by n desc nulls last, rank) as position from s) where position <= 5""")
def l06_overfetch_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Four times as many candidates as wanted, reranked, then cut."""
    top = lexical.bm25(_documents(spark, d), _questions(spark, d), 20).select("query", "doc", "rank")
    sized = top.join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.length("text").alias("n")), "doc")
    order = Window.partitionBy("query").orderBy(F.desc_nulls_last("n"), "rank")
    return sized.withColumn("position", F.row_number().over(order)).where("position <= 5").select("query", "doc", "position")


@R.query("""with p as (select scope_key, kind, max(importance) best from memories group by scope_key, kind) select scope_key, round(sum(best), 6) as score, count(*) as modes from p group by scope_key""")
def u05_best_of_mode(spark: SparkSession, d: str) -> DataFrame:
    """The best of each mode, summed: a mode that brings a source twice doesn't count twice."""
    best = memories(spark, d).groupBy("scope_key", "kind").agg(F.max("importance").alias("best"))
    return best.groupBy("scope_key").agg(F.round(F.sum("best"), 6).alias("score"), F.count("*").alias("modes"))


@R.query(f"with {_POS} select delivery_id, lag(delivery_id) over w as previous, lead(delivery_id) over w as following from pos window w as (partition by scope_key, s order by o)")
def w07_previous_next(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours by their places: an equi-join on (session, place), as a window would read a session in one task."""
    pos = _positions(spark, d)
    beside = lambda k, name: pos.select("scope_key", "s", (F.col("o") + k).alias("o"), F.col("delivery_id").alias(name))
    met = pos.join(beside(1, "previous"), ["scope_key", "s", "o"], "left").join(beside(-1, "following"), ["scope_key", "s", "o"], "left")
    return met.select("delivery_id", "previous", "following")


@R.query(f"with {_BM25} select query, doc, round(1 - rank / (2.0 * count(*) over (partition by query)), 6) as score from bm where rank <= 10")
def w13_rank_score(spark: SparkSession, d: str) -> DataFrame:
    top = lexical.bm25(_documents(spark, d), _questions(spark, d), 10)
    return top.select("query", "doc", F.round(1 - F.col("rank") / (2 * F.count("*").over(Window.partitionBy("query"))), 6).alias("score"))


@R.query(f"""with e as (select scope_key, {sql_id('thread_id')} t, count(*) n from messages group by 1, 2) select scope_key, count(*) as threads, max(n) as longest from e where t is not null group by scope_key having max(n) <= 1000000""")
def l10_read_bound(spark: SparkSession, d: str) -> DataFrame:
    """A bound that raises where it is exceeded, instead of cutting."""
    sizes = messages(spark, d).select("scope_key", clean_id("thread_id").alias("t")).where("t is not null").groupBy("scope_key", "t").agg(F.count("*").alias("n"))
    whole = sizes.groupBy("scope_key").agg(F.count("*").alias("threads"), F.max("n").alias("longest"))
    return whole.withColumn("longest", F.when(F.col("longest") <= 1_000_000, F.col("longest")).otherwise(F.raise_error(F.lit("a thread is longer than the read bound")).cast("long")))
