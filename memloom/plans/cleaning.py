"""Queries of problems 3, 4 and 5: histories, surplus rows, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.keys import micros
from memloom.operators import copies, history, intervals
from memloom.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history(table(spark, sf_dir, "memory_log")).select("memory_id", "started_us")


def p3_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = history.history(table(spark, sf_dir, "memory_log"))
    return found.select("memory_id", "started_us", "ended_us", "state", micros("valid_from").alias("valid_from_us"), micros("valid_to").alias("valid_to_us"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = copies.surplus_of_links(table(spark, sf_dir, "messages"), "scope_key", ["message_id", "event_id"], "received_at", "delivery_id")
    writes = copies.surplus_of_key(table(spark, sf_dir, "memories"), "scope_key", "idempotency_key", "created_at", "memory_id")
    return messages.select(F.lit("messages").alias("source_table"), F.col("delivery_id").cast("string").alias("row_key")).unionByName(
        writes.select(F.lit("memories").alias("source_table"), F.col("memory_id").alias("row_key"))
    )


def p4_kept_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.keep_one(table(spark, sf_dir, "memories"), "scope_key", ["idempotency_key"], "created_at", "memory_id").select("memory_id", "scope_key", "state")


def _merged(spark: SparkSession, sf_dir: str) -> intervals.Merged:
    return intervals.Merged(intervals.claim_intervals(table(spark, sf_dir, "claims")), ["scope_key", "subject_id", "topic_key"], "a", "b")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = _merged(spark, sf_dir).gaps()
    return gaps.select("scope_key", "subject_id", "topic_key", F.col("p0").alias("gap_from_us"), F.col("p1").alias("gap_to_us"))


def p5_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuous periods; an open end is null."""
    periods = _merged(spark, sf_dir).periods()
    return periods.select(
        "scope_key",
        "subject_id",
        "topic_key",
        F.when(F.col("p0") > intervals.LOW, F.col("p0")).alias("from_us"),
        F.when(F.col("p1") < intervals.HIGH, F.col("p1")).alias("to_us"),
    )


QUERIES = {f.__name__: f for f in (p3_found, p3_chains, p4_found, p4_kept_memories, p5_found, p5_periods)}

#: Fixed value: white space at either end, in RE2's notation.
EDGE = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"
_trim = lambda c: f"regexp_replace({c}, '{EDGE}', '', 'g')"

_CHAINS = f"""
with r as (
  select {_trim("memory_id")} memory_id, epoch_us(updated_at) us, nullif({_trim("lower(state)")}, '') state,
         valid_from, valid_to, recorded_at, log_id
  from memory_log where memory_id is not null and updated_at is not null),
v as (
  select memory_id, us,
         last(state order by recorded_at, log_id) filter (where state is not null) state,
         last(struct_pack(f := epoch_us(valid_from), t := epoch_us(valid_to)) order by recorded_at, log_id) valid
  from r group by memory_id, us),
k as (
  select memory_id, us, last_value(state ignore nulls) over (partition by memory_id order by us) state, valid.f f, valid.t t from v),
m as (
  select *, row_number() over w n, lag(state) over w ls, lag(f) over w lf, lag(t) over w lt from k
  window w as (partition by memory_id order by us)),
c as (
  select * from m where n = 1 or state is distinct from ls or f is distinct from lf or t is distinct from lt)
"""

_MERGED = f"""
with c as (
  select {_trim("scope_key")} scope_key, {_trim("subject_id")} subject_id, lower({_trim("topic_key")}) topic_key,
         coalesce(epoch_us(valid_from), -9e18::bigint) a, coalesce(epoch_us(valid_to), 9e18::bigint) b
  from claims where valid_from is not null or valid_to is not null),
o as (
  select *, max(b) over (partition by scope_key, subject_id, topic_key order by a, b rows between unbounded preceding and 1 preceding) reach
  from c where a < b and topic_key <> '')
"""

ORACLE = {
    "p3_found": _CHAINS + "select memory_id, us as started_us from c",
    "p3_chains": _CHAINS
    + "select memory_id, us as started_us, lead(us) over (partition by memory_id order by us) as ended_us, state, f as valid_from_us, t as valid_to_us from c",
    "p4_found": f"""
with recursive ids as (
  select delivery_id, scope_key s, nullif({_trim("message_id")}, '') m, nullif({_trim("event_id")}, '') e,
         row_number() over (order by received_at nulls last, delivery_id) rk
  from messages),
pairs as (select s, m, e, min(rk) p from ids where m is not null or e is not null group by s, m, e),
links as (
  select p, min(p) over (partition by s, m) q from pairs where m is not null
  union select p, min(p) over (partition by s, e) from pairs where e is not null),
edges as (select p, q from links where p <> q union select q, p from links where p <> q),
reach(p, q) as (
  select distinct p, p from edges
  union select r.p, x.q from reach r join edges x on x.p = r.q),
least_of as (select p, min(q) q from reach group by p),
first_rows as (select distinct coalesce(l.q, pairs.p) rk from pairs left join least_of l on l.p = pairs.p)
select 'messages' as source_table, cast(delivery_id as varchar) as row_key from ids
where (m is not null or e is not null) and rk not in (select rk from first_rows)
union all
select 'memories', memory_id from (
  select memory_id, row_number() over (partition by scope_key, {_trim("idempotency_key")} order by created_at nulls last, memory_id) n
  from memories where {_trim("idempotency_key")} <> '') where n > 1""",
    "p4_kept_memories": f"""
select memory_id, scope_key, state from (
  select memory_id, scope_key, state, {_trim("idempotency_key")} k,
         row_number() over (partition by scope_key, {_trim("idempotency_key")} order by created_at nulls last, memory_id) n
  from memories) where n = 1 or k is null or k = ''""",
    "p5_found": _MERGED + "select scope_key, subject_id, topic_key, reach as gap_from_us, a as gap_to_us from o where a > reach",
    "p5_periods": _MERGED
    + """, s as (select *, sum((reach is null or a > reach)::int) over (partition by scope_key, subject_id, topic_key order by a, b, reach nulls first rows unbounded preceding) g from o)
select scope_key, subject_id, topic_key, nullif(min(a), -9e18::bigint) as from_us, nullif(max(b), 9e18::bigint) as to_us
from s group by scope_key, subject_id, topic_key, g""",
}
