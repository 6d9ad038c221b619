"""Filters, gates and projections over memories and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import times, values
from memloom.functions.keys import clean_id, micros, trimmed
from memloom.operators.filters import Plan, RecordFilter, contains_text, eligible, first_of_identity, has_anchor, rank_score, rejection_reason, score_gate
from memloom.plans.registry import Registry, sql_id, sql_label, sql_normal, sql_trim
from memloom.sources.tables import table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

NOW = "2026-01-01 00:00:00"
CURRENT = Plan(now=NOW, memory_types=("preference", "state", "plan", "fact"))
AS_OF = Plan(now=NOW, view="as_of", as_of="2025-06-01 00:00:00", observed_until="2026-03-01 00:00:00")
INTERVAL = Plan(now=NOW, view="interval", time_from="2025-03-01 00:00:00", time_to="2025-09-01 00:00:00")
_T = lambda s: f"timestamptz '{s}+00'"


def memories(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "memories")


def messages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "messages")


@R.query("""select memory_id, kind, importance from memories
where state in ('candidate','confirmed') and kind in ('fact','habit','style') and actor in ('owner','contact')
  and authority <> 'agent_output' and list_has_all(tags, ['personal-memory']) and importance >= 0.3
  and created_at between timestamptz '2025-03-01 00:00:00+00' and timestamptz '2026-03-01 00:00:00+00'""")
def f01_memory_filter(spark: SparkSession, d: str) -> DataFrame:
    wanted = RecordFilter(kinds=("fact", "habit", "style"), actors=("owner", "contact"), exclude_authorities=("agent_output",), tags=("personal-memory",), min_importance=0.3, time_from="2025-03-01 00:00:00", time_to="2026-03-01 00:00:00")
    return memories(spark, d).where(wanted.column()).select("memory_id", "kind", "importance")


@R.query("select memory_id, scope_key from memories where scope_key in (select scope_key from messages where actor = 'HUMAN_SELF')")
def f02_scope_membership(spark: SparkSession, d: str) -> DataFrame:
    allowed = messages(spark, d).where("actor = 'HUMAN_SELF'").select("scope_key").distinct()
    return memories(spark, d).join(allowed, "scope_key", "left_semi").select("memory_id", "scope_key")


@R.query("select memory_id, state from memories where state in ('candidate','confirmed')")
def f03_active_states(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).where(RecordFilter().column()).select("memory_id", "state")


@R.query("select memory_id from memories where list_has_all(tags, ['personal-memory','health'])")
def f04_tag_subset(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).where(values.subset(["personal-memory", "health"], F.col("tags"))).select("memory_id")


@R.query("select memory_id, epoch_us(created_at) as created_us from memories where created_at between timestamptz '2025-06-01 00:00:00+00' and timestamptz '2025-07-01 00:00:00+00'")
def f05_time_range(spark: SparkSession, d: str) -> DataFrame:
    wanted = RecordFilter(include_inactive=True, time_from="2025-06-01 00:00:00", time_to="2025-07-01 00:00:00")
    return memories(spark, d).where(wanted.column()).select("memory_id", micros("created_at").alias("created_us"))


@R.query("select memory_id from memories where contains(coalesce(content,''), 'rain jacket') or contains(coalesce(metadata,''), 'rain jacket')")
def f06_substring(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).where(contains_text("rain jacket")).select("memory_id")


@R.query(r"""with w as (select memory_id, content, regexp_extract_all(lower(coalesce(content,'')), '[\p{L}\p{N}]+') t from memories),
h as (select memory_id from w where list_has_all(t, ['contact','promised','suitcase']))
select memory_id from h union all
select memory_id from memories where contains(coalesce(content,''), 'contact promised suitcase') and not exists (select 1 from h)""")
def f07_full_text(spark: SparkSession, d: str) -> DataFrame:
    """All query words; only if none has them, the query as a substring."""
    words = F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    found = memories(spark, d).where(values.subset(["contact", "promised", "suitcase"], words)).select("memory_id")
    if not found.isEmpty():
        return found
    return memories(spark, d).where(contains_text("contact promised suitcase")).select("memory_id")


_L = {c: sql_label(c) for c in ("subject", "topic_key", "personal_memory_type", "temporal_status")}
_AGENT = "coalesce(authority = 'agent_output', false)"


def _reasons(plan: Plan, eligible_sql: str, middle: str, tail: str) -> str:
    return f"""select memory_id, case
 when not ({eligible_sql}) then 'ineligible_authority_or_lifecycle'
 when {_L['subject']} <> '{plan.subject}' then 'subject_mismatch'
 when created_at > {_T(plan.observed_until or plan.now)} then 'not_yet_observed'
 {middle}
 when event_time is not null and {_L['personal_memory_type']} <> 'episode' then 'invalid_event_time'
 {tail} else '' end as reason from memories"""


@R.query(_reasons(CURRENT, f"coalesce(state in ('candidate','confirmed'), false) and not {_AGENT}",
    f"when {_L['personal_memory_type']} not in ('preference','state','plan','fact') then 'memory_type_mismatch'",
    f"when valid_from > {_T(NOW)} then 'not_yet_valid' when valid_to < {_T(NOW)} then 'no_longer_valid'"))
def f08_structural_gate(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", rejection_reason(CURRENT).alias("reason"))


_BACK = "coalesce(state in ('candidate','confirmed','superseded','expired'), false)"
_AT = _T("2025-06-01 00:00:00")
_AS_OF_OK = f"{_BACK} and not {_AGENT} and (state not in ('superseded','expired') or ((valid_from is not null or valid_to is not null) and (valid_from is null or valid_from <= {_AT}) and (valid_to is null or valid_to >= {_AT})))"


@R.query(_reasons(AS_OF, _AS_OF_OK, f"when {_L['temporal_status']} = 'planned' then 'planned_not_actual'", f"when valid_from > {_AT} then 'not_yet_valid' when valid_to < {_AT} then 'no_longer_valid'"))
def f08_gate_as_of(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", rejection_reason(AS_OF).alias("reason"))


_FIRST = "case when event_time is not null then event_time.\"start\" else coalesce(valid_from, created_at) end"
_LAST = f"case when event_time is not null then event_time.\"end\" else coalesce(valid_to, case when {_L['personal_memory_type']} = 'episode' or valid_from is null then coalesce(valid_from, created_at) end) end"
_INTERVAL_OK = f"{_BACK} and not {_AGENT} and (state not in ('superseded','expired') or ((valid_from is not null or valid_to is not null) and {_L['temporal_status']} = 'historical'))"


@R.query(_reasons(INTERVAL, _INTERVAL_OK, "", f"""when (event_time is null or event_time."start" is not null)
 and (coalesce({_FIRST} > {_T('2025-09-01 00:00:00')}, false) or coalesce({_LAST} < {_T('2025-03-01 00:00:00')}, false)) then 'outside_time_interval'"""))
def f08_gate_interval(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", rejection_reason(INTERVAL).alias("reason"))


@R.query(f"select memory_id, state from memories where {_AS_OF_OK}")
def f09_eligibility(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).where(eligible(AS_OF)).select("memory_id", "state")


def _lexical() -> Column:
    """Part of the words of a fixed question that the content has."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    asked = F.array(*[F.lit(w) for w in ("where", "contact", "promised", "notebook")])
    return F.size(F.array_intersect(words, asked)) / 4


_LEX = r"len(list_intersect(list_distinct(regexp_extract_all(lower(coalesce(content,'')), '[\p{L}\p{N}]+')), ['where','contact','promised','notebook'])) / 4.0"


@R.query(f"""with s as (select memory_id, {_LEX} l, coalesce(confidence, 0) c, importance i from memories),
g as (select memory_id, case when l >= 0.25 then l else 0.0 end l, case when c >= 0.35 then c else 0.0 end c, case when i * 0.5 >= 0.35 then i * 0.5 else 0.0 end r from s)
select memory_id, l as lexical, c as semantic, r as relation from g where l > 0 or c > 0 or r > 0""")
def f10_score_gate(spark: SparkSession, d: str) -> DataFrame:
    keep, lex, sem, rel = score_gate(_lexical(), F.coalesce("confidence", F.lit(0.0)), F.col("importance") * 0.5)
    return memories(spark, d).select("memory_id", lex.alias("lexical"), sem.alias("semantic"), rel.alias("relation"), keep.alias("keep")).where("keep").drop("keep")


_NORMAL = sql_normal("content")


@R.query(f"select memory_id from memories where contains({_NORMAL}, 'rainjacket') or contains({_NORMAL}, '雨衣') or contains({_NORMAL}, 'regenjacke')")
def f11_entity_anchor(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", values.normal_text("content").alias("n")).where(has_anchor(["rainjacket", "雨衣", "regenjacke"], F.col("n"))).select("memory_id")


@R.query("""with base as (select memory_id, scope_key, 'base' origin, 0 rank from memories where kind = 'fact' and state = 'confirmed'),
rel as (select memory_id, scope_key, 'relation' origin, 1 rank from memories where kind in ('relation', 'fact') and importance >= 0.5)
select memory_id, scope_key, arg_min(origin, rank) as origin, count(*) as sources from (select * from base union all select * from rel) group by memory_id, scope_key""")
def f12_candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Union of two candidate sources by identity; the base source wins."""
    m = memories(spark, d)
    base = m.where("kind = 'fact' and state = 'confirmed'").select("memory_id", "scope_key", F.lit("base").alias("origin"), F.lit(0).alias("rank"))
    rel = m.where("kind in ('relation', 'fact') and importance >= 0.5").select("memory_id", "scope_key", F.lit("relation").alias("origin"), F.lit(1).alias("rank"))
    return base.unionByName(rel).groupBy("memory_id", "scope_key").agg(F.min_by("origin", "rank").alias("origin"), F.count("*").alias("sources"))


@R.query("""select m.memory_id from memories m where m.kind = 'fact' and m.state = 'confirmed'
and exists (select 1 from memories r where r.scope_key = m.scope_key and r.kind = 'relation' and r.subject_id = m.subject_id and r.state = 'confirmed')""")
def f12_relation_gate(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    allowed = m.where("kind = 'relation' and state = 'confirmed'").select("scope_key", "subject_id").distinct()
    return m.where("kind = 'fact' and state = 'confirmed'").join(allowed, ["scope_key", "subject_id"], "left_semi").select("memory_id")


@R.query(f"select memory_id from memories where list_has_all(tags, ['personal-memory']) and state in ('candidate','confirmed') and authority <> 'agent_output' and created_at <= {_T(NOW)}")
def f13_coarse_filter(spark: SparkSession, d: str) -> DataFrame:
    wanted = RecordFilter(tags=("personal-memory",), exclude_authorities=("agent_output",), time_to=NOW)
    return memories(spark, d).where(wanted.column()).select("memory_id")


@R.query(f"""select memory_id from memories where extractor = 'ingestor' and kind = 'event' and state = 'confirmed'
and ((actor = 'owner' and authority = 'human_self') or (actor = 'agent' and authority = 'agent_output')) and created_at <= {_T(NOW)}""")
def f14_raw_events(spark: SparkSession, d: str) -> DataFrame:
    consistent = values.authority(F.col("actor")) == F.col("authority")
    return memories(spark, d).where("extractor = 'ingestor' and kind = 'event' and state = 'confirmed' and actor in ('owner', 'agent')").where(consistent & (F.col("created_at") <= times.at(NOW))).select("memory_id")


@R.query(f"""select memory_id, case when state not in ('candidate','confirmed') then 'inactive' when coalesce(content, '') = '' then 'empty'
 when {_L['subject']} = 'owner' or ({_L['subject']} = '' and actor = 'owner') then 'owner' when {_L['subject']} = '' then 'unbound' else {_L['subject']} end as verdict
from memories where kind = 'relation'""")
def f15_relation_subject(spark: SparkSession, d: str) -> DataFrame:
    """Validity of relation records and whom they are about; old owner rows lack the subject."""
    subject = values.label("subject")
    verdict = (
        F.when(~F.col("state").isin("candidate", "confirmed"), "inactive")
        .when(F.coalesce("content", F.lit("")) == "", "empty")
        .when((subject == "owner") | ((subject == "") & (F.col("actor") == "owner")), "owner")
        .when(subject == "", "unbound")
        .otherwise(subject)
    )
    return memories(spark, d).where("kind = 'relation'").select("memory_id", verdict.alias("verdict"))


@R.query(f"""select scope_key, identity, arg_min(delivery_id, rk) as delivery_id from (
 select scope_key, coalesce({sql_id('message_id')}, {sql_id('event_id')}) identity, delivery_id, row_number() over (order by "at", delivery_id) rk from messages)
where identity is not null group by scope_key, identity""")
def f16_guard_dedupe(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).select("scope_key", F.coalesce(clean_id("message_id"), clean_id("event_id")).alias("identity"), "delivery_id", "at").where("identity is not null")
    return first_of_identity(rows, ["scope_key", "identity"], F.struct("at", "delivery_id")).select("scope_key", "identity", "delivery_id")


_SNIPPET = f"""case when {sql_id('text')} is null then 'no_text' when {sql_id('actor')} is null then 'no_actor'
 when {sql_id('message_id')} is null and {sql_id('event_id')} is null then 'no_identity' when "at" > {_T(NOW)} then 'not_yet' else 'accepted' end"""


@R.query(f"select scope_key, reason, count(*) as n from (select scope_key, {_SNIPPET} reason from messages) group by scope_key, reason")
def f17_snippet_reasons(spark: SparkSession, d: str) -> DataFrame:
    reason = (
        F.when(clean_id("text").isNull(), "no_text")
        .when(clean_id("actor").isNull(), "no_actor")
        .when(clean_id("message_id").isNull() & clean_id("event_id").isNull(), "no_identity")
        .when(F.col("at") > times.at(NOW), "not_yet")
        .otherwise("accepted")
    )
    return messages(spark, d).select("scope_key", reason.alias("reason")).groupBy("scope_key", "reason").agg(F.count("*").alias("n"))


@R.query(f"""select memory_id, case when {sql_id('subject_id')} is null then 'missing' when {_L['subject']} = 'owner' and lower({sql_trim('subject_id')}) <> lower(coalesce(scope_user,'')) then 'not_the_owner'
 when {_L['subject']} not in ('owner','agent','contact') then 'unknown_subject' else 'bound' end as binding from memories where subject is not null""")
def f19_subject_binding(spark: SparkSession, d: str) -> DataFrame:
    subject = values.label("subject")
    binding = (
        F.when(clean_id("subject_id").isNull(), "missing")
        .when((subject == "owner") & (F.lower(trimmed("subject_id")) != F.lower(F.coalesce("scope_user", F.lit("")))), "not_the_owner")
        .when(~subject.isin("owner", "agent", "contact"), "unknown_subject")
        .otherwise("bound")
    )
    return memories(spark, d).where("subject is not null").select("memory_id", binding.alias("binding"))


@R.query("select memory_id, scope_key from memories where kind = 'memory_conflict' and state in ('candidate','confirmed')")
def f21_open_conflicts(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).where(RecordFilter(kinds=("memory_conflict",)).column()).select("memory_id", "scope_key")


# Projections -----------------------------------------------------------------------------------------------------


_SCOPE_JSON = (
    "'{\"agent_id\":' || to_json(scope_agent) || ',\"chat_id\":' || to_json(scope_chat_id) || ',\"chat_type\":' || to_json(scope_chat_type) || ',\"extra_dimensions\":{' || "
    "coalesce(array_to_string(list_transform(list_sort(map_keys(scope_extra)), lambda k: to_json(k) || ':' || to_json(scope_extra[k])), ','), '') || '},\"platform\":' || to_json(scope_platform) || ',\"user_id\":' || to_json(scope_user) || '}'"
)


@R.query(f"select memory_id, 'dpl_' || sha256({_SCOPE_JSON}) as computed, scope_key = 'dpl_' || sha256({_SCOPE_JSON}) as agrees from memories")
def prj01_scope_key(spark: SparkSession, d: str) -> DataFrame:
    scope = {"agent": F.col("scope_agent"), "chat_id": F.col("scope_chat_id"), "chat_type": F.col("scope_chat_type"), "platform": F.col("scope_platform"), "user": F.col("scope_user")}
    computed = values.scope_key(scope, F.col("scope_extra"))
    return memories(spark, d).select("memory_id", computed.alias("computed"), (computed == F.col("scope_key")).alias("agrees"))


@R.query("""select distinct scope_user, scope_agent, level from (select scope_user, scope_agent, unnest(list_distinct(['user', case when scope_chat_type = '' then 'user' else 'contact' end, case when scope_chat_id = '' then 'contact' else 'conversation' end])) as level from memories)""")
def prj03_scope_expansion(spark: SparkSession, d: str) -> DataFrame:
    levels = F.array_distinct(F.array(F.lit("user"), F.when(F.col("scope_chat_type") == "", "user").otherwise("contact"), F.when(F.col("scope_chat_id") == "", "contact").otherwise("conversation")))
    return memories(spark, d).select("scope_user", "scope_agent", F.explode(levels).alias("level")).distinct()


@R.query(f"""with r as (select delivery_id, {sql_label('actor')} a from messages),
n as (select delivery_id, case a when 'human_self' then 'owner' when 'peer' then 'contact' when 'internal' then 'system' when '' then 'system' else a end role from r)
select delivery_id, role, case role when 'owner' then 'human_self' when 'contact' then 'peer_statement' when 'agent' then 'agent_output' else 'derived_summary' end as authority from n""")
def prj04_prj05_role_authority(spark: SparkSession, d: str) -> DataFrame:
    who = values.role("actor")
    return messages(spark, d).select("delivery_id", who.alias("role"), values.authority(who).alias("authority"))


@R.query(f"""select claim_id, left(case when {sql_label('memory_type')} = '' then 'event' else {sql_label('memory_type')} end, 64) as kind,
 case {sql_label('temporal_status')} when 'present' then 'current' when 'future' then 'planned' when 'past' then 'historical' when 'history' then 'historical' when '' then 'unknown' else {sql_label('temporal_status')} end as temporal_status,
 case {sql_label('revision_kind')} when '' then 'assertion' when 'assertion' then 'assertion' when 'correction' then 'correction' when 'retraction' then 'retraction' end as revision_kind from claims""")
def prj06_normalized_labels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").select("claim_id", values.kind("memory_type").alias("kind"), values.temporal_status("temporal_status").alias("temporal_status"), values.revision_kind("revision_kind").alias("revision_kind"))


@R.query(r"""with p as (select delivery_id, i, parts[i].text t from messages, unnest(range(1, len(parts) + 1)) as u(i) where parts is not null),
f as (select delivery_id, t, min(i) i from p where coalesce(t,'') <> '' group by delivery_id, t)
select m.delivery_id, case when {TRIM} <> '' then {TRIM} else coalesce((select string_agg(t, chr(10) order by i) from f where f.delivery_id = m.delivery_id), '') end as body from messages m""".replace("{TRIM}", sql_trim("coalesce(m.text, '')")))
def prj07_text_of_parts(spark: SparkSession, d: str) -> DataFrame:
    own = trimmed(F.coalesce("text", F.lit("")))
    texts = F.filter(F.transform(F.coalesce("parts", F.array()), lambda p: p.text), lambda t: F.coalesce(t, F.lit("")) != "")
    return messages(spark, d).select("delivery_id", F.when(own != "", own).otherwise(F.array_join(F.array_distinct(texts), "\n")).alias("body"))


@R.query(f"""with r as (select *, {sql_label('actor')} a from messages),
n as (select *, case a when 'human_self' then 'owner' when 'peer' then 'contact' when 'internal' then 'system' when '' then 'system' else a end role from r)
select delivery_id, '[actor=' || role || ' authority=' || case role when 'owner' then 'human_self' when 'contact' then 'peer_statement' when 'agent' then 'agent_output' else 'derived_summary' end
 || ' at_us=' || epoch_us("at") || case when message_type <> 'message' then ' type=' || message_type else '' end
 || coalesce(' reply=' || {sql_id('reply_to_id')}, '') || coalesce(' thread=' || {sql_id('thread_id')}, '') || '] ' || coalesce(text, '')
 || case when len(attachments) > 0 then ' [attachments=' || len(attachments) || ']' else '' end as line from n""")
def prj08_episode_line(spark: SparkSession, d: str) -> DataFrame:
    who = values.role("actor")
    optional = lambda name, c: F.coalesce(F.concat(F.lit(f" {name}="), c), F.lit(""))
    line = F.concat(
        F.lit("[actor="), who, F.lit(" authority="), values.authority(who), F.lit(" at_us="), micros("at").cast("string"),
        F.when(F.col("message_type") != "message", F.concat(F.lit(" type="), "message_type")).otherwise(""),
        optional("reply", clean_id("reply_to_id")), optional("thread", clean_id("thread_id")), F.lit("] "), F.coalesce("text", F.lit("")),
        F.when(F.size("attachments") > 0, F.concat(F.lit(" [attachments="), F.size("attachments").cast("string"), F.lit("]"))).otherwise(""),
    )
    return messages(spark, d).select("delivery_id", line.alias("line"))


@R.query(f"""select memory_id, {sql_label('topic_key')} as topic, json_extract_string(metadata, '$.analyzer_version') as analyzer_version from memories""")
def prj10_metadata_values(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", values.label("topic_key").alias("topic"), F.get_json_object("metadata", "$.analyzer_version").alias("analyzer_version"))


@R.query(f"""select memory_id, case when valid_from is not null or valid_to is not null then 'validity_match' when case {sql_label('temporal_status')} when 'timeless' then true else false end then 'timeless' else 'uncertain' end as match from memories""")
def prj13_as_of_match(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", times.as_of_match(F.col("valid_from"), F.col("valid_to"), F.col("temporal_status")).alias("match"))


@R.query("""select memory_id, epoch_us(coalesce(event_time."start", valid_from, created_at)) as effective_us,
 list_filter([case when event_time is not null then 'event_time' end, case when valid_from is not null or valid_to is not null then 'dated' end, case when coalesce(topic_key,'') <> '' then 'topic_key' end], lambda x: x is not null) as reasons from memories""")
def prj14_effective_time(spark: SparkSession, d: str) -> DataFrame:
    reasons = F.array_compact(F.array(F.when(F.col("event_time").isNotNull(), "event_time"), F.when(F.col("valid_from").isNotNull() | F.col("valid_to").isNotNull(), "dated"), F.when(F.coalesce("topic_key", F.lit("")) != "", "topic_key")))
    return memories(spark, d).select("memory_id", micros(times.effective_time(F.col("event_time.start"), F.col("valid_from"), F.col("created_at"))).alias("effective_us"), reasons.alias("reasons"))


@R.query("""select memory_id, '{"memory_id":' || to_json(memory_id) || ',"actor":' || to_json(actor) || ',"importance":' || cast(cast(round(importance * 1000) as bigint) as varchar) || '}' as item from memories""")
def prj15_attributed_json(spark: SparkSession, d: str) -> DataFrame:
    item = F.to_json(F.struct("memory_id", "actor", F.round(F.col("importance") * 1000).cast("long").alias("importance")))
    return memories(spark, d).select("memory_id", item.alias("item"))


_BUCKET = "case kind when 'event' then 'events' when 'background' then 'background' when 'relation' then 'relations' when 'style' then 'style' end"


@R.query(f"""with b as (select scope_key, {_BUCKET} bucket, memory_id, row_number() over (partition by scope_key, {_BUCKET} order by created_at desc, memory_id) n from memories where {_BUCKET} is not null and state in ('candidate','confirmed'))
select scope_key, bucket, list(memory_id order by n) as memory_ids from b where n <= case bucket when 'events' then 8 when 'style' then 3 else 5 end group by scope_key, bucket""")
def prj16_materials(spark: SparkSession, d: str) -> DataFrame:
    """Newest records of each kind by scope, as many as a prompt takes; the caps are the feature."""
    bucket = F.when(F.col("kind") == "event", "events").when(F.col("kind") == "background", "background").when(F.col("kind") == "relation", "relations").when(F.col("kind") == "style", "style")
    newest = Window.partitionBy("scope_key", "bucket").orderBy(F.desc("created_at"), "memory_id")
    top = memories(spark, d).where(RecordFilter().column()).select("scope_key", bucket.alias("bucket"), "memory_id", "created_at").where("bucket is not null").withColumn("n", F.row_number().over(newest)).where("n <= 8")
    kept = top.where(F.col("n") <= F.when(F.col("bucket") == "events", 8).when(F.col("bucket") == "style", 3).otherwise(5))
    return kept.groupBy("scope_key", "bucket").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "memory_id"))), lambda x: x.memory_id).alias("memory_ids"))


@R.query("select memory_id, sha256(concat_ws('|', memory_id, kind, coalesce(content,'-'), state, cast(version as varchar))) as fingerprint from memories")
def prj17_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", F.sha2(F.concat_ws("|", "memory_id", "kind", F.coalesce("content", F.lit("-")), "state", F.col("version").cast("string")), 256).alias("fingerprint"))


@R.query("""select delivery_id, sha256('["' || scope_key || '",' || cast(epoch_us("at") as varchar) || ',"' || coalesce(actor,'') || '"]') as write_key from messages""")
def prj18_write_key(spark: SparkSession, d: str) -> DataFrame:
    payload = F.concat(F.lit('["'), "scope_key", F.lit('",'), micros("at").cast("string"), F.lit(',"'), F.coalesce("actor", F.lit("")), F.lit('"]'))
    return messages(spark, d).select("delivery_id", F.sha2(payload, 256).alias("write_key"))


@R.query(f"""select claim_id, case {sql_label('temporal_status')} when 'planned' then ['planned'] when 'future' then ['planned'] when 'historical' then ['historical','timeless'] when 'past' then ['historical','timeless'] when 'history' then ['historical','timeless']
 when 'current' then ['current','timeless'] when 'present' then ['current','timeless'] else [] end as statuses from claims""")
def prj20_default_statuses(spark: SparkSession, d: str) -> DataFrame:
    status = values.temporal_status("temporal_status")
    array = lambda *v: F.array(*[F.lit(x) for x in v])
    out = F.when(status == "planned", array("planned")).when(status == "historical", array("historical", "timeless")).when(status == "current", array("current", "timeless")).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "claims").select("claim_id", out.alias("statuses"))


@R.query(f"""with g as ({ORACLE['f08_structural_gate']}),
s as (select m.memory_id, m.scope_key, coalesce(m.valid_from, m.created_at) e, round(1.2 + m.importance * 0.1 + {_LEX} + least(greatest(epoch_us(coalesce(m.valid_from, m.created_at)) / 1e6, 0) / 1e10, 0.2), 6) score from memories m join g using (memory_id) where g.reason = '')
select scope_key, memory_id, score, rank from (select scope_key, memory_id, score, row_number() over (partition by scope_key order by score desc, e desc, memory_id desc) as rank from s) where rank <= 20""")
def l03_rank_topk(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: gate, score and the best 20 of each scope."""
    effective = F.coalesce("valid_from", "created_at")
    score = rank_score(CURRENT, _lexical(), F.lit(0.0), F.lit(0.0), effective)
    kept = memories(spark, d).where(rejection_reason(CURRENT) == "").select("scope_key", "memory_id", effective.alias("e"), score.alias("score"))
    best = Window.partitionBy("scope_key").orderBy(F.desc("score"), F.desc("e"), F.desc("memory_id"))
    return kept.withColumn("rank", F.row_number().over(best)).where("rank <= 20").select("scope_key", "memory_id", "score", "rank")
