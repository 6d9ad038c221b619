"""Record filters and gates as column expressions."""

from __future__ import annotations

from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.times import at, valid_at
from memloom.functions.values import ACTIVE_STATES, label, subset


@dataclass(frozen=True)
class RecordFilter:
    """Conjunctive filter. None means no restriction; an empty collection matches nothing."""

    states: Collection[str] | None = None
    include_inactive: bool = False
    kinds: Collection[str] | None = None
    actors: Collection[str] | None = None
    exclude_actors: Collection[str] = ()
    authorities: Collection[str] | None = None
    exclude_authorities: Collection[str] = ()
    tags: Sequence[str] = ()
    min_importance: float | None = None
    time_from: str | None = None
    time_to: str | None = None

    def column(self) -> Column:
        out = F.lit(True)
        if self.states is not None:
            out &= F.col("state").isin(*self.states)
        elif not self.include_inactive:
            out &= F.col("state").isin(*ACTIVE_STATES)
        for name, values in (("kind", self.kinds), ("actor", self.actors), ("authority", self.authorities)):
            if values is not None:
                out &= F.col(name).isin(*values)
        for name, values in (("actor", self.exclude_actors), ("authority", self.exclude_authorities)):
            if values:
                out &= ~F.col(name).isin(*values)
        if self.tags:
            out &= subset(self.tags, F.col("tags"))
        if self.min_importance is not None:
            out &= F.col("importance") >= self.min_importance
        if self.time_from is not None:
            out &= F.col("created_at") >= at(self.time_from)
        if self.time_to is not None:
            out &= F.col("created_at") <= at(self.time_to)
        return F.coalesce(out, F.lit(False))


@dataclass(frozen=True)
class Plan:
    """A bound query: what to look for, at which clocks."""

    subject: str = "owner"
    now: str = "2026-01-01 00:00:00"
    observed_until: str | None = None
    view: str = "current"
    memory_types: tuple[str, ...] = ()
    topic_keys: tuple[str, ...] = ()
    temporal_statuses: tuple[str, ...] = ()
    as_of: str | None = None
    time_from: str | None = None
    time_to: str | None = None

    @property
    def looks_back(self) -> bool:
        return self.view in ("prior", "as_of", "interval") or any((self.as_of, self.time_from, self.time_to))

    @property
    def states(self) -> tuple[str, ...]:
        return (*ACTIVE_STATES, "superseded", "expired") if self.looks_back else ACTIVE_STATES


def contains_text(q: str) -> Column:
    """Case-sensitive substring of the content or the metadata."""
    return F.coalesce(F.contains("content", F.lit(q)), F.lit(False)) | F.coalesce(F.contains("metadata", F.lit(q)), F.lit(False))


def eligible(plan: Plan) -> Column:
    """Visible state and authority; inactive rows only inside an explicit interval that the plan asks for."""
    inactive = F.col("state").isin("superseded", "expired")
    dated = F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull()
    if plan.view in ("prior", "interval") or plan.time_from or plan.time_to:
        inside = dated & (label("temporal_status") == "historical")
    elif plan.as_of:
        inside = dated & valid_at(at(plan.as_of), F.col("valid_from"), F.col("valid_to"))
    else:
        inside = F.lit(False)
    agent = F.coalesce(F.col("authority") == "agent_output", F.lit(False)) if plan.subject != "agent" else F.lit(False)
    return F.coalesce(F.col("state").isin(*plan.states), F.lit(False)) & ~agent & (~inactive | inside)


def rejection_reason(plan: Plan) -> Column:
    """First reason to reject a record, '' if none."""
    subject, topic, memory_type, status = label("subject"), label("topic_key"), label("personal_memory_type"), label("temporal_status")
    start, end = F.col("valid_from"), F.col("valid_to")
    has_event = F.col("event_time").isNotNull()
    event_start, event_end = F.col("event_time.start"), F.col("event_time.end")
    reasons: list[tuple[Column, str]] = [
        (~eligible(plan), "ineligible_authority_or_lifecycle"),
        (subject != plan.subject, "subject_mismatch"),
        (F.col("created_at") > at(plan.observed_until or plan.now), "not_yet_observed"),
    ]
    if plan.memory_types:
        reasons.append((~memory_type.isin(*plan.memory_types), "memory_type_mismatch"))
    if plan.topic_keys:
        reasons.append((~topic.isin(*plan.topic_keys), "topic_mismatch"))
    if plan.temporal_statuses:
        reasons.append((~status.isin(*plan.temporal_statuses), "temporal_status_mismatch"))
    if plan.as_of and "planned" not in plan.temporal_statuses:
        reasons.append((status == "planned", "planned_not_actual"))
    reasons.append((has_event & (memory_type != "episode"), "invalid_event_time"))
    for moment in [plan.now] * (plan.view == "current") + [plan.as_of] * bool(plan.as_of):
        reasons.append((start > at(moment), "not_yet_valid"))
        reasons.append((end < at(moment), "no_longer_valid"))
    if plan.time_from or plan.time_to:
        first = F.when(has_event, event_start).otherwise(F.coalesce(start, F.col("created_at")))
        point = (memory_type == "episode") | start.isNull()
        last = F.when(has_event, event_end).otherwise(F.coalesce(end, F.when(point, first)))
        known = ~has_event | event_start.isNotNull()
        outside = F.lit(False)
        if plan.time_to:
            outside |= F.coalesce(first > at(plan.time_to), F.lit(False))
        if plan.time_from:
            outside |= F.coalesce(last < at(plan.time_from), F.lit(False))
        reasons.append((known & outside, "outside_time_interval"))
    out = F.lit("")
    for test, reason in reversed(reasons):
        out = F.when(test, reason).otherwise(out)
    return out


def score_gate(lexical: Column, semantic: Column, relation: Column, least: tuple[float, float, float] = (0.25, 0.35, 0.35)) -> tuple[Column, Column, Column, Column]:
    """(keep, lexical, semantic, relation): scores under their threshold become zero; one above is enough."""
    kept = [F.when(s >= t, s).otherwise(0.0) for s, t in zip((lexical, semantic, relation), least)]
    return (kept[0] > 0) | (kept[1] > 0) | (kept[2] > 0), *kept


def rank_score(plan: Plan, lexical: Column, semantic: Column, relation: Column, effective_at: Column, weights: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Column:
    structural = 1.0 + 0.3 * bool(plan.topic_keys) + 0.2 * bool(plan.memory_types) + 0.2 * bool(plan.temporal_statuses or plan.as_of)
    recency = F.least(F.greatest(F.unix_micros(effective_at) / 1e6, F.lit(0.0)) / 1e10, F.lit(0.2))
    return F.round(F.lit(structural) + F.col("importance") * 0.1 + weights[0] * lexical + weights[1] * semantic + weights[2] * relation + recency, 6)


def has_anchor(mentions: Sequence[str], text: Column) -> Column:
    """Whether any mention stands in the normalized text."""
    return F.exists(F.array(*[F.lit(m) for m in mentions]), lambda m: F.contains(text, m))


def first_of_identity(df: DataFrame, identity: Sequence[str], order: Column) -> DataFrame:
    """One row of each identity, the first by ``order``; an aggregation, so nothing is sorted by group."""
    kept = df.groupBy(*identity).agg(F.min_by(F.struct(*[c for c in df.columns if c not in identity]), order).alias("_r"))
    return kept.select(*identity, "_r.*")
