"""Consolidation and governance of claims, set by set.

Decisions are rows (memory_id, operation, canonical), one for each source, so no group is gathered into a list. Every pass
takes the sources that earlier passes left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.values import ACTIVE_STATES, label, normal_text

#: Fixed values.
MUTABLE = ("fact", "state", "preference", "relationship", "plan", "commitment")
EXPIRABLE = ("state", "plan", "commitment")
SLOT = ["scope_key", "actor", "authority", "kind", "subject_", "subject_id_", "type_", "topic_"]


def slots(memories: DataFrame) -> DataFrame:
    """Active claims with their slot, normalized content and order."""
    return memories.where(F.col("state").isin(*ACTIVE_STATES) & (F.col("kind") != "memory_conflict")).select(
        "memory_id", "scope_key", "actor", "authority", "kind",
        label("subject").alias("subject_"), label("subject_id").alias("subject_id_"), label("personal_memory_type").alias("type_"), label("topic_key").alias("topic_"),
        label("event_key").alias("event_"), label("temporal_status").alias("status_"), label("revision_kind").alias("revision_"),
        normal_text("content").alias("normal"), F.trim("content").alias("exact"), F.coalesce("valid_from", "created_at").alias("eff"),
        F.col("valid_from").alias("vf"), F.col("valid_to").alias("vt"),
    )


def _latest(group: Sequence[str], rows: DataFrame) -> DataFrame:
    """Of each group its size, contents, latest row and whether that is strictly the latest."""
    by_time = rows.groupBy(*group, "eff").agg(F.count("*").alias("m"), F.max(F.struct("memory_id", "revision_", "status_")).alias("last"), F.min("normal").alias("lo"), F.max("normal").alias("hi"))
    return by_time.groupBy(*group).agg(
        F.sum("m").alias("n"),
        F.max_by("last", "eff").alias("last"),
        (F.max_by("m", "eff") == 1).alias("strict"),
        (F.min("lo") != F.max("hi")).alias("differ"),
    )


def consolidate(memories: DataFrame) -> DataFrame:
    """Decisions (memory_id, operation, canonical) over all slots: corrections, conflicts, then merges of exact repeats.

    In a slot, a historical correction or retraction that is strictly the latest retires the active value; then values of
    one status that differ are corrected by a strictly latest revision, or else conflict; then repeats among what is left
    are merged into the latest.
    """
    rows = slots(memories)
    keyed = rows.where("topic_ != ''")

    # A historical revision, where only one of current and planned has rows.
    revising = keyed.where("status_ in ('current', 'planned') or (status_ = 'historical' and revision_ in ('correction', 'retraction'))")
    kinds = revising.groupBy(*SLOT).agg(F.count_if(F.col("status_") == "current").alias("c"), F.count_if(F.col("status_") == "planned").alias("p"))
    newest = _latest(SLOT, revising).where("strict and last.status_ = 'historical' and last.revision_ in ('correction', 'retraction')")
    retiring = newest.join(kinds, SLOT).where("(c > 0) != (p > 0)").select(*SLOT, F.col("last.memory_id").alias("canonical"))
    retired = revising.join(retiring, SLOT).where("status_ != 'historical' or memory_id = canonical").select("memory_id", F.lit("correct").alias("operation"), "canonical")

    left = keyed.join(retired.select("memory_id"), "memory_id", "left_anti")
    mutable = left.where(F.col("type_").isin(*MUTABLE) & F.col("status_").isin("current", "planned"))
    group = [*SLOT, "status_"]
    differing = _latest(group, mutable).where("differ and n > 1")
    explicit = F.col("strict") & F.col("last.revision_").isin("correction", "retraction")
    verdict = differing.select(*group, F.when(explicit, "correct").otherwise("conflict").alias("operation"), F.when(explicit, F.col("last.memory_id")).alias("canonical"))
    settled = mutable.join(verdict, group).select("memory_id", "operation", "canonical")
    used = retired.unionByName(settled)

    rest = rows.join(used.select("memory_id"), "memory_id", "left_anti")
    episode = F.col("type_") == "episode"
    signature = F.when(episode & (F.col("event_") != ""), F.to_json(F.struct("event_", "exact", "status_", "revision_", "vf", "vt"))).when(~episode, F.to_json(F.struct("normal", "status_")))
    signed = rest.withColumn("signature", signature).where("signature is not null")
    same = signed.groupBy(*SLOT, "signature").agg(F.count("*").alias("n"), F.max_by("memory_id", F.struct("eff", "memory_id")).alias("canonical")).where("n > 1")
    merged = signed.join(same, [*SLOT, "signature"]).select("memory_id", F.lit("merge").alias("operation"), "canonical")
    return used.unionByName(merged)


def evidence_ids(evidence: Column, fallback: Column) -> Column:
    """Distinct evidence ids and the record's own source."""
    ids = F.transform(F.coalesce(evidence, F.array()), lambda e: F.trim(F.coalesce(e.evidence_id, F.lit(""))))
    return F.array_distinct(F.filter(F.concat(ids, F.array(F.coalesce(fallback, F.lit("")))), lambda x: x != ""))


def govern(memories: DataFrame, now: Column, threshold: int = 3, step: float = 0.1, cap: float = 0.9) -> DataFrame:
    """Archive what has ended, else reinforce what has enough evidence: memory_id, operation, target."""
    active = memories.where(F.col("state").isin(*ACTIVE_STATES))
    ended = label("personal_memory_type").isin(*EXPIRABLE) & (F.col("valid_to") < now)
    n = F.size(evidence_ids(F.col("evidence"), F.coalesce(F.nullif("source_message_id", F.lit("")), F.nullif("source_event_id", F.lit("")))))
    trusted = F.col("authority").isin("human_self", "peer_statement")
    target = F.round(F.least(F.lit(cap), F.col("importance") + step * (n - threshold + 1)), 6)
    reinforced = trusted & (n >= threshold) & (F.col("importance") < cap) & (target > F.col("importance"))
    operation = F.when(F.coalesce(ended, F.lit(False)), "archive").when(F.coalesce(reinforced, F.lit(False)), "reinforce")
    return active.select("memory_id", operation.alias("operation"), F.when(operation == "reinforce", target).alias("target")).where("operation is not null")
