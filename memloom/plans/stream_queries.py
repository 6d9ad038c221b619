"""Streaming queries, run over what the tables hold and then read back; and provider-backed ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.keys import clean_id, micros, trimmed
from memloom.plans.filter_queries import memories
from memloom.plans.registry import Registry, sql_id, sql_trim
from memloom.providers import EvidenceVerifier, HashEmbedding, QuotedEvidence
from memloom.staging import scratch as _folder
from memloom.streaming import ingest

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.query(f"select distinct scope_key, coalesce({sql_id('message_id')}, {sql_id('event_id')}) as id from messages where coalesce({sql_id('message_id')}, {sql_id('event_id')}) is not null")
def t08_stream_dedupe(spark: SparkSession, d: str) -> DataFrame:
    folder = _folder(spark, "t08")
    ingest.run_available(ingest.first_deliveries(ingest.stream(spark, f"{d}/messages.parquet")), folder, lambda b: b)
    return spark.read.parquet(f"{folder}/out").select("scope_key", "id")


@R.query("""select delivery_id, scope_key, epoch_us("at") as at_us from messages""")
def t05_late_arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Every row exactly once, each batch in the order of its source clock, however late it came."""
    folder = _folder(spark, "t05")
    source = ingest.stream(spark, f"{d}/messages.parquet")
    ingest.bind_checkpoint(spark, folder, "t05", 1, source.schema)
    ingest.run_available(source, folder, lambda b: b.sortWithinPartitions("at", "delivery_id").select("delivery_id", "scope_key", micros("at").alias("at_us")))
    return spark.read.parquet(f"{folder}/out").select("delivery_id", "scope_key", "at_us")


@R.query("""select scope_key, epoch_us(date_trunc('day', "at")) as day_us, count(*) as n from messages where date_trunc('day', "at") + interval 1 day <= (select max("at") from messages) - interval 1 day group by 1, 2""")
def t02_closed_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts by day, given out once a day is closed: when something a day later than its end has arrived. All that is there
    is one batch, so nothing comes too late for it."""
    folder = _folder(spark, "t02")
    source = ingest.stream(spark, f"{d}/messages.parquet", files_per_batch=1_000_000).where("at is not null")
    counts = ingest.tumbling(source, "at", "1 day", "1 day", ["scope_key"])
    flat = counts.select("scope_key", micros("window.start").alias("day_us"), "n")
    flat.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(flat.schema).parquet(f"{folder}/out")


@R.query(f"select memory_id, case when content is null or {sql_trim('content')} = '' then 'unsupported' when evidence is null or len(evidence) = 0 then 'unassessed' else 'supported' end as verdict from memories")
def x05_evidence_verdicts(spark: SparkSession, d: str) -> DataFrame:
    verifier: EvidenceVerifier = QuotedEvidence()
    rows = memories(spark, d).select("memory_id", F.coalesce(trimmed("content"), F.lit("")).alias("claim"), F.coalesce(F.size("evidence"), F.lit(0)).alias("cited"))
    return rows.select("memory_id", verifier.verdict(F.col("claim"), F.col("cited")).alias("verdict"))


@R.query()
def x01_hash_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Offline embeddings of all memories from an Arrow function behind the provider interface."""
    return HashEmbedding(16).embed(memories(spark, d).where("content is not null").select("memory_id", "content"), "memory_id", "content")


@R.query(f"select memory_id, {sql_id('source_message_id')} as source_id, version from memories where created_at > timestamptz '2026-03-01 00:00:00+00'")
def t01_forward_cursor(spark: SparkSession, d: str) -> DataFrame:
    """What lies ahead of a cursor; rows that arrive behind it later are the business of t05."""
    return memories(spark, d).where(F.col("created_at") > F.lit("2026-03-01 00:00:00").cast("timestamp")).select("memory_id", clean_id("source_message_id").alias("source_id"), "version")
