"""Analysis to records: drafts, proposals, conflicts, governance with replacement, ledgers, and quality over judged evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions import times, values
from memloom.functions.keys import clean_id, micros
from memloom.operators import claims, proposals
from memloom.plans.analysis_queries import _CONSOLIDATED, _JUDGED, _S, _STATUS, _TOPIC, _TYPE, judged
from memloom.plans.filter_queries import memories, messages
from memloom.plans.registry import Registry, sql_id, sql_label, sql_normal, sql_trim
from memloom.providers import RuleAnalyzer
from memloom.sources.tables import table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

_ROLE = f"case {sql_label('actor')} when '' then 'system' when 'human_self' then 'owner' when 'peer' then 'contact' when 'internal' then 'system' else {sql_label('actor')} end"


@R.query(f"select scope_key, actor, authority, kind, {sql_label('subject')} as subject, {sql_label('subject_id')} as subject_id, {_TYPE} as type, {_TOPIC} as topic, count(*) as records, count(distinct {sql_normal('content')}) as contents, count(distinct {_STATUS}) as statuses from memories where state in ('candidate','confirmed') and kind <> 'memory_conflict' group by all")
def a04_slots(spark: SparkSession, d: str) -> DataFrame:
    """Slots of active claims, with how many contents and statuses each has."""
    s = claims.slots(memories(spark, d)).select("scope_key", "actor", "authority", "kind", F.col("subject_").alias("subject"), F.col("subject_id_").alias("subject_id"), F.col("type_").alias("type"), F.col("topic_").alias("topic"), "normal", "status_")
    return s.groupBy("scope_key", "actor", "authority", "kind", "subject", "subject_id", "type", "topic").agg(F.count("*").alias("records"), F.count_distinct("normal").alias("contents"), F.count_distinct("status_").alias("statuses"))


_DRAFTS = r"""d as (select delivery_id, scope_key, ROLE actor, unnest([
 struct_pack(memory_type := 'preference', content := nullif(regexp_extract(text, '(?i)(?:would rather|prefiere|prefers?) ([^.!?。]+)', 1), ''), confidence := 0.9),
 struct_pack(memory_type := 'plan', content := nullif(regexp_extract(text, '(?i)(?:let''s|want to|wollen|打算) ?([^.!?。]+)', 1), ''), confidence := 0.8),
 struct_pack(memory_type := 'commitment', content := nullif(regexp_extract(text, '(?i)(?:promised to|答应把) ?([^.!?。]+)', 1), ''), confidence := 0.7)]) x from messages where text is not null),
dr as (select delivery_id, scope_key, actor, x.memory_type memory_type, x.content content, x.confidence confidence from d where x.content is not null)""".replace("ROLE", _ROLE)
_OUTCOMES = f"""{_DRAFTS}, fp as (select *, {sql_normal('content')} fp from dr),
oc as (select *, case when confidence < 0.75 then 'low_confidence' when fp = '' then 'empty' end bad from fp),
pr as (select *, coalesce(bad, case when delivery_id = min(delivery_id) filter (where bad is null) over (partition by scope_key, actor, memory_type, fp) then 'proposed' else 'duplicate' end) outcome from oc)"""


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    return RuleAnalyzer().drafts(messages(spark, d).where("text is not null"), "text").select("delivery_id", "scope_key", values.role("actor").alias("actor"), "memory_type", "content", "confidence")


@R.query(f"with {_OUTCOMES} select delivery_id, memory_type, content, outcome from pr")
def g09_draft_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Drafts of an offline analyzer over all messages, and which of them become proposals."""
    return proposals.drafts_to_proposals(_drafts(spark, d)).select("delivery_id", "memory_type", "content", "outcome")


@R.query(f"with {_OUTCOMES} select scope_key, outcome, count(*) as n from pr group by scope_key, outcome")
def g10_mined_counts(spark: SparkSession, d: str) -> DataFrame:
    """What a periodic miner reports: drafts of each scope by outcome, the quarantined among them."""
    return proposals.drafts_to_proposals(_drafts(spark, d)).groupBy("scope_key", "outcome").agg(F.count("*").alias("n"))


@R.query(rf"""with c as (select delivery_id, text, nullif({sql_trim("regexp_extract(text, '([^.!?。！？]+)', 1)")}, '') clause from messages where text is not null)
select delivery_id, clause, instr(text, clause) - 1 as start_pos, instr(text, clause) - 1 + length(clause) as end_pos, sha256(clause) as hash from c where clause is not null""")
def g15_g16_clauses(spark: SparkSession, d: str) -> DataFrame:
    """The first clause of each message, trimmed, with its place in the source and its hash; a clause is always part of its source."""
    clause = clean_id(F.regexp_extract("text", "([^.!?。！？]+)", 1))
    rows = messages(spark, d).where("text is not null").select("delivery_id", "text", clause.alias("clause")).where("clause is not null")
    at = F.expr("instr(text, clause)")
    return rows.select("delivery_id", "clause", (at - 1).alias("start_pos"), (at - 1 + F.length("clause")).alias("end_pos"), F.sha2("clause", 256).alias("hash"))


@R.query(f"""with e as (select memory_id, scope_key, {sql_normal('content')} c, unnest(evidence) e from memories where content is not null and evidence is not null),
s as (select scope_key, {sql_id('message_id')} id, text from messages where {sql_id('message_id')} is not null and text is not null),
j as (select e.memory_id, bool_or(contains({sql_normal('s.text')}, e.c)) q, count(s.id) n from e left join s on s.scope_key = e.scope_key and s.id = {sql_id('e.e.message_id')} group by e.memory_id)
select memory_id, case when n = 0 then 'unassessed' when q then 'supported' else 'unsupported' end as verdict from j""")
def g14_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Whether a record's content stands, but for spacing, punctuation and case, in a message it cites."""
    cited = memories(spark, d).where("content is not null").select("memory_id", "scope_key", values.normal_text("content").alias("c"), F.explode("evidence").alias("e")).select("memory_id", "scope_key", "c", clean_id("e.message_id").alias("id"))
    said = messages(spark, d).where("text is not null").select("scope_key", clean_id("message_id").alias("id"), values.normal_text("text").alias("t")).where("id is not null")
    met = cited.join(said, ["scope_key", "id"], "left").groupBy("memory_id").agg(F.bool_or(F.contains("t", F.col("c"))).alias("q"), F.count("t").alias("n"))
    return met.select("memory_id", F.when(F.col("n") == 0, "unassessed").when(F.col("q"), "supported").otherwise("unsupported").alias("verdict"))


@R.query(_CONSOLIDATED + f""", cf as (select mu.* from mu join used u using (memory_id) where u.operation = 'conflict'), m as (select memory_id, importance from memories)
select scope_key, tp as topic, count(*) as sources, max(importance) as importance, arg_max(memory_id, (eff, memory_id)) as anchor, 'Unresolved personal-memory conflict in topic ' || tp || ' across ' || count(*) || ' active claims.' as content from cf join m using (memory_id) group by {_S}, st""")
def g05_conflict_markers(spark: SparkSession, d: str) -> DataFrame:
    return proposals.conflict_markers(memories(spark, d)).drop("marker")


@R.query(_CONSOLIDATED + "select memory_id, canonical from retired")
def g02_historical_revisions(spark: SparkSession, d: str) -> DataFrame:
    """Records that a strictly latest historical correction or retraction retires."""
    found = claims.consolidate(memories(spark, d))
    revised = found.where("operation = 'correct'")
    status = memories(spark, d).select(F.col("memory_id").alias("canonical"), values.label("temporal_status").alias("s"))
    return revised.join(status, "canonical").where("s = 'historical'").select("memory_id", "canonical")


_CLASS = """'{"retention_class":"' || kind || '"}'"""


@R.query("""with a as (select memory_id, importance i, coalesce(list_max(list_transform(evidence, lambda e: e.at)), created_at) anchor from memories where state in ('candidate','confirmed') and kind in ('style','fact','background'))
select memory_id, round(greatest(0.1, i - 0.1), 6) as target from a where i > 0.1 and epoch_us(timestamptz '2026-01-01 00:00:00+00') - epoch_us(anchor) >= 90 * 86400000000::bigint and round(greatest(0.1, i - 0.1), 6) < i""")
def c22_decay(spark: SparkSession, d: str) -> DataFrame:
    """Opt-in decay of ephemeral records without recent evidence; the class is read from the metadata."""
    m = memories(spark, d).withColumn("metadata", F.expr(_CLASS))
    return proposals.decayed(m, times.at("2026-01-01 00:00:00"), ("style", "fact", "background"))


@R.query()
def g08_replacements(spark: SparkSession, d: str) -> DataFrame:
    """Governance carried out: each governed record's replacement, and its source superseded."""
    m = memories(spark, d)
    return proposals.replacements(m, claims.govern(m, times.at("2026-01-01 00:00:00"))).select("memory_id", "new_id", "importance", "state", "source_state")


def _g08() -> str:
    from memloom.plans.analysis_queries import ORACLE as known

    return f"""with g as ({known['g07_governance']}) select memory_id, 'gov_' || substr(sha256(concat_ws('|', memory_id, version::varchar, operation)), 1, 24) as new_id, coalesce(target, importance) as importance,
 case when operation = 'archive' then 'expired' else state end as state, 'superseded' as source_state from g join memories using (memory_id)"""


ORACLE["g08_replacements"] = _g08()


@R.query(f"""with w as (select memory_id, scope_key, {sql_id('idempotency_key')} k, nullif(trim(coalesce(content, ''), ' '), '') c, created_at, kind = 'event' old from memories),
f as (select *, first_value(memory_id) over (partition by scope_key, k, old order by created_at nulls last, memory_id) f, bool_or(old) over (partition by scope_key, k) was from w),
s as (select distinct scope_key from messages where {_ROLE} = 'contact')
select memory_id, case when c is null then 'rejected' when s.scope_key is null then 'scope' when k is not null and (was or f <> memory_id) then 'duplicate' else 'created' end as outcome from f left join s using (scope_key) where not old""")
def g11_write_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Proposals (all records that are no events) written into a store of the events, within the scopes that a contact speaks in."""
    m = memories(spark, d)
    scopes = messages(spark, d).where(values.role("actor") == "contact").select("scope_key").distinct()
    return proposals.write_outcomes(m.where("kind != 'event'"), m.where("kind = 'event'"), scopes)


@R.query(ORACLE["g11_write_outcomes"].replace("select memory_id, case when c is null", "select outcome, count(*) as n from (select memory_id, case when c is null") + ") group by outcome")
def a08_write_summary(spark: SparkSession, d: str) -> DataFrame:
    return g11_write_outcomes(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


@R.query(f"""select delivery_id, scope_key, 'event:' || coalesce({sql_id('message_id')}, {sql_id('event_id')}) as idempotency_key, trim(text, ' ') as content, {_ROLE} as actor, case {_ROLE} when 'owner' then 'human_self' when 'contact' then 'peer_statement' when 'agent' then 'agent_output' else 'derived_summary' end as authority
from messages where coalesce({sql_id('message_id')}, {sql_id('event_id')}) is not null and trim(coalesce(text, ''), ' ') <> ''""")
def g12_event_processor(spark: SparkSession, d: str) -> DataFrame:
    return proposals.event_records(messages(spark, d)).select("delivery_id", "scope_key", "idempotency_key", "content", "actor", "authority")


@R.query("""with r as (select *, sha256(concat_ws('|', memory_id, version::varchar, state)) h from memories)
select scope_key, kind, count(*) as n, sum(('0x' || substr(h, 1, 12))::bigint)::bigint as h1, sum(('0x' || substr(h, 13, 12))::bigint)::bigint as h2 from r group by scope_key, kind""")
def a17_group_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return proposals.group_fingerprints(memories(spark, d), ["scope_key", "kind"], "memory_id", "version", "state")


@R.query("""select scope_key, count(*) filter (where state in ('candidate','confirmed')) as upserts, count(*) filter (where state not in ('candidate','confirmed')) as deletes, count(*) filter (where content is null) as unembeddable from memories group by scope_key""")
def a09_maintenance_report(spark: SparkSession, d: str) -> DataFrame:
    active = F.col("state").isin("candidate", "confirmed")
    return memories(spark, d).groupBy("scope_key").agg(F.count_if(active).alias("upserts"), F.count_if(~active).alias("deletes"), F.count_if(F.col("content").isNull()).alias("unembeddable"))


@R.query("""select claim_id, case when valid_from is null and valid_to is null then 'unknown' when valid_from > timestamptz '2026-01-01 00:00:00+00' then 'future' when valid_to < timestamptz '2026-01-01 00:00:00+00' then 'past' else 'valid' end as validity,
 coalesce(first_observed_at > timestamptz '2026-01-01 00:00:00+00', false) as late from claims""")
def g13_transient_view(spark: SparkSession, d: str) -> DataFrame:
    """Claims as seen at one moment: their validity then, and whether they were observed later; nothing is written."""
    at = times.at("2026-01-01 00:00:00")
    a, b = F.col("valid_from"), F.col("valid_to")
    validity = F.when(a.isNull() & b.isNull(), "unknown").when(a > at, "future").when(b < at, "past").otherwise("valid")
    return table(spark, d, "claims").select("claim_id", validity.alias("validity"), F.coalesce(F.col("first_observed_at") > at, F.lit(False)).alias("late"))


@R.query("""select memory_id from memories where state in ('candidate','confirmed') and created_at <= timestamptz '2025-09-01 00:00:00+00' and (valid_from is null or valid_from <= timestamptz '2026-01-01 00:00:00+00') and (valid_to is null or valid_to >= timestamptz '2026-01-01 00:00:00+00')""")
def t10_two_clocks(spark: SparkSession, d: str) -> DataFrame:
    """What was known by one moment and is valid at another."""
    known = F.col("created_at") <= times.at("2025-09-01 00:00:00")
    return memories(spark, d).where(F.col("state").isin("candidate", "confirmed") & known & times.valid_at(times.at("2026-01-01 00:00:00"), F.col("valid_from"), F.col("valid_to"))).select("memory_id")


@R.query(f"""with b as (select memory_id, scope_key, 'base' o, 0 r from memories where state = 'confirmed' union all select memory_id, scope_key, 'relation', 1 from memories where kind = 'relation'),
k as (select *, row_number() over (partition by scope_key, memory_id order by r) n from b) select scope_key, memory_id, o as origin from k where n = 1""")
def u02_base_and_relations(spark: SparkSession, d: str) -> DataFrame:
    """Base and relation records by identity; the base one wins."""
    m = memories(spark, d)
    both = m.where("state = 'confirmed'").select("scope_key", "memory_id", F.lit(0).alias("r")).unionByName(m.where("kind = 'relation'").select("scope_key", "memory_id", F.lit(1).alias("r")))
    return both.groupBy("scope_key", "memory_id").agg(F.min("r").alias("r")).select("scope_key", "memory_id", F.when(F.col("r") == 0, "base").otherwise("relation").alias("origin"))


@R.query(f"""select m.memory_id, s.state as state, s.version as version from memories m join memories s on s.scope_key = m.scope_key and s.memory_id = m.memory_id where m.kind = 'fact' and s.state in ('candidate','confirmed')""")
def j04_authoritative_reload(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by (scope, id) with what the store says of them now."""
    m = memories(spark, d)
    found = m.where("kind = 'fact'").select("scope_key", "memory_id")
    return found.join(m.where("state in ('candidate', 'confirmed')").select("scope_key", "memory_id", "state", "version"), ["scope_key", "memory_id"]).select("memory_id", "state", "version")


@R.query("""select memory_id, scope_user, scope_key <> '' as scoped, concat_ws('/', coalesce(scope_user, '*'), coalesce(scope_agent, '*'), coalesce(scope_platform, '*'), coalesce(scope_chat_type, '*'), coalesce(scope_chat_id, '*')) as described,
 concat_ws('/', coalesce(scope_user, '*'), coalesce(scope_agent, '*'), '*', '*', '*') as user_scope, concat_ws('/', coalesce(scope_user, '*'), coalesce(scope_agent, '*'), coalesce(scope_platform, '*'), 'direct', coalesce(scope_chat_id, '*')) as counterpart from memories""")
def prj02_scope_derivations(spark: SparkSession, d: str) -> DataFrame:
    """A scope described, and the scopes derived from it: the user's alone, and the direct chat's."""
    part = lambda c: F.coalesce(c, F.lit("*"))
    user, agent, platform, chat = (part(F.col(f"scope_{x}")) for x in ("user", "agent", "platform", "chat_id"))
    star = F.lit("*")
    return memories(spark, d).select("memory_id", "scope_user", (F.col("scope_key") != "").alias("scoped"), F.concat_ws("/", user, agent, platform, part(F.col("scope_chat_type")), chat).alias("described"), F.concat_ws("/", user, agent, star, star, star).alias("user_scope"), F.concat_ws("/", user, agent, platform, F.lit("direct"), chat).alias("counterpart"))


@R.query(f"select memory_id, coalesce(content, '') as text, actor as role, epoch_us(coalesce(valid_from, created_at)) as at_us, importance as score, coalesce({sql_id('source_message_id')}, {sql_id('source_event_id')}, memory_id) as source from memories")
def prj09_recall_row(spark: SparkSession, d: str) -> DataFrame:
    """A record as a recalled message."""
    return memories(spark, d).select("memory_id", F.coalesce("content", F.lit("")).alias("text"), F.col("actor").alias("role"), micros(F.coalesce("valid_from", "created_at")).alias("at_us"), F.col("importance").alias("score"), F.coalesce(clean_id("source_message_id"), clean_id("source_event_id"), F.col("memory_id")).alias("source"))


@R.query(f"with {_OUTCOMES} select 'prop_' || substr(sha256(concat_ws('|', delivery_id::varchar, memory_type, fp)), 1, 16) as memory_id, scope_key, memory_type as personal_memory_type, content, confidence, 'candidate' as state, actor, 0.5 as importance from pr where outcome = 'proposed'")
def prj11_proposal_record(spark: SparkSession, d: str) -> DataFrame:
    """Proposals as candidate records with ids that follow from them."""
    made = proposals.drafts_to_proposals(_drafts(spark, d)).where("outcome = 'proposed'")
    ident = F.concat(F.lit("prop_"), F.substring(F.sha2(F.concat_ws("|", F.col("delivery_id").cast("string"), "memory_type", "fp"), 256), 1, 16))
    return made.select(ident.alias("memory_id"), "scope_key", F.col("memory_type").alias("personal_memory_type"), "content", "confidence", F.lit("candidate").alias("state"), "actor", F.lit(0.5).alias("importance"))


@R.query(f"""select memory_id, list_filter([case when contains(coalesce(content, ''), 'contact') then 'lexical' end, case when confidence >= 0.35 then 'semantic' end, case when kind = 'relation' then 'relation' end], lambda x: x is not null) as sources,
 case when {sql_id('subject_id')} is null then 'unbound' when {sql_label('subject')} = 'owner' then 'owner' else 'other' end as entity_binding from memories""")
def prj12_candidate_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Why a record is a candidate: the sources that bring it, and how its subject is bound."""
    one = lambda test, name: F.when(test, name)
    sources = F.array_compact(F.array(one(F.contains(F.coalesce("content", F.lit("")), F.lit("contact")), "lexical"), one(F.col("confidence") >= 0.35, "semantic"), one(F.col("kind") == "relation", "relation")))
    binding = F.when(clean_id("subject_id").isNull(), "unbound").when(values.label("subject") == "owner", "owner").otherwise("other")
    return memories(spark, d).select("memory_id", sources.alias("sources"), binding.alias("entity_binding"))


# Quality over judged evidence: a document is relevant to an item if it has half of the item's rarer words ------------


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    top, held = judged(spark, d)
    return top, held.where("h * 2 >= m").select("query", "doc")


@R.query(_JUDGED + " select query, count(*) as relevant, count(rank) as found, round(count(rank) / count(*)::double, 6) as recall, round(count(rank) / 20.0, 6) as precision, round(coalesce(1.0 / min(rank), 0), 6) as reciprocal_rank from j group by query")
def a24_retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall, precision and reciprocal rank of each item against documents judged by its rarer words, apart from the search itself."""
    top, relevant = _judged(spark, d)
    met = relevant.join(top, ["query", "doc"], "left")
    return met.groupBy("query").agg(
        F.count("*").alias("relevant"), F.count("rank").alias("found"), F.round(F.count("rank") / F.count("*"), 6).alias("recall"), F.round(F.count("rank") / 20, 6).alias("precision"), F.round(F.coalesce(1 / F.min("rank"), F.lit(0.0)), 6).alias("reciprocal_rank")
    )


@R.query(_JUDGED + ", s as (select top.query, top.doc, rank, rel.doc is not null good from top left join rel on rel.query = top.query and rel.doc = top.doc) select query, count(*) filter (where good and rank <= 5) as before, count(*) filter (where good) as after, count(*) filter (where good and rank > 5) as recovered, count(*) filter (where not good and rank <= 5) as displaced from s group by query")
def a19_coverage_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Evidence covered by five hits and by twenty: what the larger context recovers, and what takes room in the smaller."""
    top, relevant = _judged(spark, d)
    s = top.join(relevant.withColumn("good", F.lit(True)), ["query", "doc"], "left").withColumn("good", F.coalesce("good", F.lit(False)))
    first = F.col("rank") <= 5
    return s.groupBy("query").agg(F.count_if(F.col("good") & first).alias("before"), F.count_if("good").alias("after"), F.count_if(F.col("good") & ~first).alias("recovered"), F.count_if(~F.col("good") & first).alias("displaced"))


@R.query(_JUDGED + ", s as (select top.query, rank <= 10 said, rel.doc is not null good from top left join rel on rel.query = top.query and rel.doc = top.doc) select count(*) filter (where said and good) as supported, round(count(*) filter (where said and good) / count(*) filter (where said)::double, 6) as precision, round(count(*) filter (where said and good) / count(*) filter (where good)::double, 6) as recall, round(count(*) filter (where not said) / count(*)::double, 6) as abstained from s")
def a20_support_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A verdict for the first ten of twenty hits, none for the others: its precision, recall and abstention."""
    top, relevant = _judged(spark, d)
    s = top.join(relevant.withColumn("g", F.lit(True)), ["query", "doc"], "left").select((F.col("rank") <= 10).alias("said"), F.col("g").isNotNull().alias("good"))
    both = F.count_if(F.col("said") & F.col("good"))
    return s.agg(both.alias("supported"), F.round(both / F.count_if("said"), 6).alias("precision"), F.round(both / F.count_if("good"), 6).alias("recall"), F.round(F.count_if(~F.col("said")) / F.count("*"), 6).alias("abstained"))
