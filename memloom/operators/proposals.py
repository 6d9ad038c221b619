"""From analysis to records: drafts, proposals, conflict markers, replacements, and what became of each write."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.keys import clean_id, micros
from memloom.functions.values import authority, label, normal_text, role
from memloom.operators.claims import consolidate, slots
from memloom.operators.copies import keep_first

#: Drafts of one message, at most; more of them are an error of the analyzer.
MOST_DRAFTS = 8


def event_records(messages: DataFrame) -> DataFrame:
    """A confirmed event for each message that shows text: scope_key, idempotency_key, content, actor, authority, created_at."""
    name = F.coalesce(clean_id("message_id"), clean_id("event_id"))
    said = F.trim(F.coalesce("text", F.lit("")))
    rows = messages.where(name.isNotNull() & (said != ""))
    return rows.select("delivery_id", "scope_key", F.concat(F.lit("event:"), name).alias("idempotency_key"), said.alias("content"), role("actor").alias("actor"), authority(role("actor")).alias("authority"), F.lit("confirmed").alias("state"), F.col("at").alias("created_at"))


def drafts_to_proposals(drafts: DataFrame, least: float = 0.75) -> DataFrame:
    """Drafts (delivery_id, scope_key, actor, memory_type, content, confidence) with their ``outcome``.

    A message with more than MOST_DRAFTS drafts is refused as a whole ("too_many"); then a draft under ``least`` is
    "low_confidence", one without content "empty", one whose (scope, actor, type, normal content) came before is "duplicate"; the
    rest are "proposed". The first of equal drafts is that of the least delivery_id.
    """
    marked = drafts.withColumn("fp", normal_text("content"))
    counts = marked.groupBy("delivery_id").agg(F.count("*").alias("_n"))
    whole = marked.join(counts, "delivery_id")
    outcome = F.when(F.col("_n") > MOST_DRAFTS, "too_many").when(F.col("confidence") < least, "low_confidence").when(F.col("fp") == "", "empty")
    whole = whole.withColumn("outcome", outcome)
    key = ["scope_key", "actor", "memory_type", "fp"]
    first = whole.where("outcome is null").groupBy(*key).agg(F.min("delivery_id").alias("_first"))
    met = whole.join(first, key, "left")
    return met.withColumn("outcome", F.coalesce("outcome", F.when(F.col("delivery_id") == F.col("_first"), "proposed").otherwise("duplicate"))).drop("_n", "_first")


def conflict_markers(memories: DataFrame) -> DataFrame:
    """One open marker for each slot and status whose values differ without a strictly latest revision.

    Columns: marker (hash of the sources), scope_key, topic, sources, importance (the greatest), anchor (the latest source), content.
    """
    decided = consolidate(memories).where("operation = 'conflict'").select("memory_id")
    rows = slots(memories).join(decided, "memory_id").join(memories.select("memory_id", "importance"), "memory_id")
    group = ["scope_key", "actor", "authority", "kind", "subject_", "subject_id_", "type_", "topic_", "status_"]
    found = rows.groupBy(*group).agg(
        F.count("*").alias("sources"), F.max("importance").alias("importance"), F.max_by("memory_id", F.struct("eff", "memory_id")).alias("anchor"), F.min("memory_id").alias("_a"), F.sum(F.crc32("memory_id")).alias("_c")
    )
    # A hash of all sources without gathering them: the group, their number, the sum of their checksums.
    marker = F.sha2(F.concat_ws("|", *group, F.col("sources").cast("string"), "_a", F.col("_c").cast("string")), 256)
    content = F.concat(F.lit("Unresolved personal-memory conflict in topic "), "topic_", F.lit(" across "), F.col("sources").cast("string"), F.lit(" active claims."))
    return found.select(marker.alias("marker"), "scope_key", F.col("topic_").alias("topic"), "sources", "importance", "anchor", content.alias("content"))


def decayed(memories: DataFrame, now: Column, classes: Sequence[str], days: int = 90, step: float = 0.1, floor: float = 0.1) -> DataFrame:
    """Records of ephemeral retention classes whose evidence is ``days`` old or older: memory_id, target importance."""
    retention = label(F.get_json_object("metadata", "$.retention_class"))
    anchor = F.coalesce(F.array_max(F.transform("evidence", lambda e: e["at"])), F.col("created_at"))
    target = F.round(F.greatest(F.lit(floor), F.col("importance") - step), 6)
    old = micros(now) - micros(anchor) >= days * 86_400_000_000
    rows = memories.where(F.col("state").isin("candidate", "confirmed") & retention.isin(*classes) & (F.col("importance") > floor) & old)
    return rows.withColumn("target", target).where("target < importance").select("memory_id", "target")


def replacements(memories: DataFrame, decisions: DataFrame) -> DataFrame:
    """Governed records as new rows beside their sources: memory_id, new_id, importance, state, source_state.

    ``decisions``: memory_id, operation, target. A replacement takes over its source with the target importance (archived ones
    end as expired); the source is superseded.
    """
    met = memories.join(decisions, "memory_id")
    new_id = F.concat(F.lit("gov_"), F.substring(F.sha2(F.concat_ws("|", "memory_id", F.col("version").cast("string"), "operation"), 256), 1, 24))
    return met.select(
        "memory_id", new_id.alias("new_id"), F.coalesce("target", "importance").alias("importance"), F.when(F.col("operation") == "archive", "expired").otherwise(F.col("state")).alias("state"), F.lit("superseded").alias("source_state")
    )


def write_outcomes(proposals: DataFrame, stored: DataFrame, scopes: DataFrame) -> DataFrame:
    """What becomes of each proposal (memory_id, scope_key, idempotency_key, content, created_at): memory_id, outcome.

    In this order: "rejected" without content, "scope" outside of ``scopes``, "duplicate" of a stored key or of an earlier
    proposal, else "created". One failing proposal does not touch the others.
    """
    there = keep_first(stored, "scope_key", "idempotency_key", "created_at", "memory_id").withColumnRenamed("memory_id", "_old")
    first = keep_first(proposals, "scope_key", "idempotency_key", "created_at", "memory_id").withColumnRenamed("memory_id", "_new")
    rows = proposals.select("memory_id", "scope_key", F.trim(F.coalesce("content", F.lit(""))).alias("c"), F.coalesce("scope_key", F.lit("\u0000")).alias("_s"), clean_id("idempotency_key").alias("_i"))
    met = rows.join(there, ["_s", "_i"], "left").join(first, ["_s", "_i"], "left").join(scopes.select("scope_key", F.lit(True).alias("allowed")), "scope_key", "left")
    outcome = F.when(F.col("c") == "", "rejected").when(F.col("allowed").isNull(), "scope").when(F.col("_old").isNotNull() | (F.col("_new") != F.col("memory_id")), "duplicate").otherwise("created")
    return met.select("memory_id", outcome.alias("outcome"))


def group_fingerprints(records: DataFrame, by: Sequence[str], ident: str, *values: str) -> DataFrame:
    """A fingerprint of each group's records that does not depend on their order: count, and sums of two hashes of each row."""
    row = F.sha2(F.concat_ws("|", ident, *[F.coalesce(F.col(v).cast("string"), F.lit("-")) for v in values]), 256)
    part = lambda a: F.conv(F.substring(row, a, 12), 16, 10).cast("long")
    return records.groupBy(*by).agg(F.count("*").alias("n"), F.sum(part(1)).alias("h1"), F.sum(part(13)).alias("h2"))
