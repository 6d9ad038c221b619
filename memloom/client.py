"""The public facade: one verb a method, over DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.times import at
from memloom.operators import claims, copies, lexical, store
from memloom.operators.filters import Plan, RecordFilter, rank_score, rejection_reason


class MemoryClient:
    """Verbs over a table of memories. Nothing is executed before the caller writes or collects the result."""

    def __init__(self, memories: DataFrame):
        self.memories = memories

    def put(self, batch: DataFrame) -> DataFrame:
        return store.put(batch, self.memories)

    def get(self, keys: DataFrame) -> DataFrame:
        return self.memories.join(keys, ["scope_key", "memory_id"], "left_semi")

    def scan(self, after: tuple[Column, Column], limit: int, only: RecordFilter | None = None) -> DataFrame:
        return store.page(self.memories.where((only or RecordFilter()).column()), "scope_key", "created_at", "memory_id", after, limit)

    def recall(self, queries: DataFrame, k: int, only: RecordFilter | None = None) -> DataFrame:
        """BM25 within scopes; ``queries`` has query, scope and text."""
        docs = self.memories.where((only or RecordFilter()).column()).select(F.col("scope_key").alias("scope"), F.col("memory_id").alias("doc"), F.coalesce("content", F.lit("")).alias("text"))
        return lexical.bm25(docs, queries, k)

    def query(self, plan: Plan) -> DataFrame:
        """Records that pass the plan's gate, with their score; order by (score, effective time, id), all descending."""
        effective = F.coalesce("event_time.start", "valid_from", "created_at")
        zero = F.lit(0.0)
        return self.memories.where(rejection_reason(plan) == "").withColumns({"effective_at": effective, "score": rank_score(plan, zero, zero, zero, effective)})

    def transition(self, requests: DataFrame) -> DataFrame:
        return store.transition(self.memories, requests)

    def consolidate(self) -> DataFrame:
        return claims.consolidate(self.memories)

    def govern(self, now: str) -> DataFrame:
        return claims.govern(self.memories, at(now))

    def deduplicate(self, ids: Sequence[str] = ("idempotency_key",)) -> DataFrame:
        return copies.keep_one(self.memories, "scope_key", list(ids), "created_at", "memory_id")

    def health(self) -> DataFrame:
        return self.memories.agg(F.count("*").alias("records"), F.count_distinct("scope_key").alias("scopes"))
