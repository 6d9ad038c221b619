"""Sources, sinks and store verbs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import times, values
from memloom.functions.keys import clean_id, micros
from memloom.operators import store
from memloom.plans.filter_queries import memories, messages
from memloom.plans.registry import Registry, sql_id, sql_label
from memloom.operators.ranks import positions
from memloom.sources.tables import table
from memloom.staging import scratch

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

_CUT = "timestamptz '2026-01-01 00:00:00+00'"


@R.query(f"""with r as (select memory_id, scope_key s, {sql_id('idempotency_key')} k, created_at c, created_at < {_CUT} as old from memories),
f as (select s, k, arg_min(memory_id, rk) filter (where old) stored_row, arg_min(memory_id, rk) filter (where not old) batch_row
  from (select *, row_number() over (order by c, memory_id) rk from r) where k is not null group by s, k)
select r.memory_id, case when coalesce(f.stored_row, nullif(f.batch_row, r.memory_id)) is not null then 'duplicate' else 'created' end as status,
 coalesce(f.stored_row, nullif(f.batch_row, r.memory_id)) as existing from r left join f on f.s = r.s and f.k = r.k where not r.old""")
def s05_idempotent_put(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    old = F.col("created_at") < times.at("2026-01-01 00:00:00")
    return store.put(m.where(~old), m.where(old))


@R.query(f"""with r as (select *, {sql_label('actor')} a from messages)
select delivery_id, scope_key, 'event' as kind, coalesce(text, '') as content, 'event:' || coalesce({sql_id('message_id')}, {sql_id('event_id')}) as idempotency_key,
 case a when 'owner' then 'human_self' when 'human_self' then 'human_self' when 'contact' then 'peer_statement' when 'peer' then 'peer_statement' when 'agent' then 'agent_output' else 'derived_summary' end as authority,
 epoch_us("at") as created_us from r""")
def s06_event_records(spark: SparkSession, d: str) -> DataFrame:
    key = F.concat(F.lit("event:"), F.coalesce(clean_id("message_id"), clean_id("event_id")))
    return messages(spark, d).select("delivery_id", "scope_key", F.lit("event").alias("kind"), F.coalesce("text", F.lit("")).alias("content"), key.alias("idempotency_key"), values.authority(values.role("actor")).alias("authority"), micros("at").alias("created_us"))


@R.query("select claim_id, scope_key, 'background' as kind, content, 0.5 as importance, [memory_type] as tags from claims")
def s07_background_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").select("claim_id", "scope_key", F.lit("background").alias("kind"), "content", F.lit(0.5).alias("importance"), F.array("memory_type").alias("tags"))


@R.query("select c_custkey, 'relationship=' || c_mktsegment || ' address=' || n_name as content, 'derived_summary' as authority from customer join nation on n_nationkey = c_nationkey")
def s08_relation_rows(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return people.select("c_custkey", F.concat(F.lit("relationship="), "c_mktsegment", F.lit(" address="), "n_name").alias("content"), F.lit("derived_summary").alias("authority"))


@R.query("""with a as (select scope_key, memory_id, created_at, row_number() over (partition by scope_key order by created_at, memory_id) as position from memories
 where created_at > timestamptz '2025-09-01 00:00:00+00'), m as (select scope_key, max(position) > 20 as has_more from a group by scope_key)
select scope_key, memory_id, position, has_more from a join m using (scope_key) where position <= 20""")
def s09_keyset_page(spark: SparkSession, d: str) -> DataFrame:
    """The page of 20 after a cursor, for every scope at once; the page size is the feature."""
    return store.page(memories(spark, d), "scope_key", "created_at", "memory_id", (times.at("2025-09-01 00:00:00"), F.lit("\U0010ffff")), 20).select("scope_key", "memory_id", "position", "has_more")


@R.query("select m.memory_id, m.state, m.version from memories m where exists (select 1 from memory_log l where l.memory_id = m.memory_id and l.scope_key = m.scope_key)")
def s10_lookup(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "memory_log").select("scope_key", "memory_id").distinct()
    return memories(spark, d).join(asked, ["scope_key", "memory_id"], "left_semi").select("memory_id", "state", "version")


@R.query("""select scope_key, memory_id, row_number() over (partition by scope_key order by created_at, memory_id desc) as position from (
 select *, row_number() over (partition by scope_key order by created_at desc, memory_id) n from memories where kind = 'event' and actor = 'owner' and state in ('candidate','confirmed')) where n <= 5""")
def s11_recent_owner(spark: SparkSession, d: str) -> DataFrame:
    own = memories(spark, d).where("kind = 'event' and actor = 'owner' and state in ('candidate', 'confirmed')")
    latest = own.withColumn("n", F.row_number().over(Window.partitionBy("scope_key").orderBy(F.desc("created_at"), "memory_id"))).where("n <= 5")
    return latest.select("scope_key", "memory_id", F.row_number().over(Window.partitionBy("scope_key").orderBy("created_at", F.desc("memory_id"))).alias("position"))


@R.query("""select scope_key, case when coalesce(content, '') = '' then 'skipped' else 'created' end as status, count(*) as n from memories group by 1, 2""")
def s12_json_import(spark: SparkSession, d: str) -> DataFrame:
    """Records written as files of JSON lines, read back from there with an explicit schema, counted by outcome."""
    folder = scratch(spark, "s12")
    memories(spark, d).select("memory_id", "scope_key", "content", "kind").write.json(folder)
    items = spark.read.schema("memory_id string, scope_key string, content string, kind string").json(folder)
    return items.groupBy("scope_key", F.when(F.coalesce("content", F.lit("")) == "", "skipped").otherwise("created").alias("status")).agg(F.count("*").alias("n"))


@R.query(f"""with r as (select scope_key, case when {sql_id('text')} is null and coalesce(len(parts), 0) = 0 then 'skipped' when {sql_id('message_id')} is null and {sql_id('event_id')} is null then 'failed' else 'accepted' end s from messages)
select scope_key, count(*) filter (where s = 'accepted') as accepted, count(*) filter (where s = 'skipped') as skipped, count(*) filter (where s = 'failed') as failed, cast(ceil(count(*) / 8.0) as bigint) as batches from r group by scope_key""")
def s13_ingest_counts(spark: SparkSession, d: str) -> DataFrame:
    empty = clean_id("text").isNull() & (F.coalesce(F.size(F.coalesce("parts", F.array())), F.lit(0)) == 0)
    status = F.when(empty, "skipped").when(clean_id("message_id").isNull() & clean_id("event_id").isNull(), "failed").otherwise("accepted")
    counts = [F.count_if(F.col("s") == s).alias(s) for s in ("accepted", "skipped", "failed")]
    return messages(spark, d).select("scope_key", status.alias("s")).groupBy("scope_key").agg(*counts, F.ceil(F.count("*") / 8).alias("batches"))


@R.query("""select memory_id, rtrim(replace(replace(to_base64(encode('["' || strftime(created_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%f') || '+00:00","' || memory_id || '"]')), '+', '-'), '/', '_'), '=') as "cursor",
 epoch_us(created_at) as time_us from memories""")
def s14_cursor_codec(spark: SparkSession, d: str) -> DataFrame:
    """Cursors of all rows, and the time that comes out of each again."""
    coded = memories(spark, d).select("memory_id", store.encode_cursor(F.col("created_at"), F.col("memory_id")).alias("cursor"))
    return coded.select("memory_id", "cursor", micros(store.decode_cursor(F.col("cursor")).time).alias("time_us"))


@R.query("select c.c_custkey as episode, 'RELATES_TO' as name, 'fallback' as origin from customer c where not exists (select 1 from orders o where o.o_custkey = c.c_custkey)")
def s17_fallback_edges(spark: SparkSession, d: str) -> DataFrame:
    """An edge of last resort for each episode from which none was extracted."""
    people, edges = table(spark, d, "customer"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return people.join(edges, "c_custkey", "left_anti").select(F.col("c_custkey").alias("episode"), F.lit("RELATES_TO").alias("name"), F.lit("fallback").alias("origin"))


@R.query(f"""with t as (select scope_key, {sql_id('thread_id')} thread, delivery_id, row_number() over (partition by scope_key, {sql_id('thread_id')} order by "at", delivery_id) - 1 turn from messages where {sql_id('thread_id')} is not null)
select scope_key, thread, cast(floor(turn / 4) as bigint) as chunk, count(*) as turns, min(delivery_id) as first_row from t group by scope_key, thread, floor(turn / 4)""")
def s22_session_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Sessions cut into chunks of four turns."""
    rows = messages(spark, d).select("scope_key", clean_id("thread_id").alias("thread"), "at", "delivery_id").where("thread is not null")
    turns = positions(rows, ["scope_key", "thread"], ["at", "delivery_id"], "turn", base=0)
    return turns.groupBy("scope_key", "thread", F.floor(F.col("turn") / 4).alias("chunk")).agg(F.count("*").alias("turns"), F.min("delivery_id").alias("first_row"))


@R.query("""select format('bench-s{:04d}-r{:08d}', s, r) as memory_id, format('synthetic benchmark memory needle{:08d} topic{:02d} scope{:04d}', r, r % 20, s) as content,
 case r % 3 when 0 then 'fact' when 1 then 'event' else 'background' end as kind, (r % 10) / 10.0 as importance from range(4) a(s), range(250) b(r)""")
def s23_generator(spark: SparkSession, d: str) -> DataFrame:
    rows = spark.range(1000).select(F.floor(F.col("id") / 250).alias("s"), (F.col("id") % 250).alias("r"))
    return rows.select(
        F.format_string("bench-s%04d-r%08d", "s", "r").alias("memory_id"),
        F.format_string("synthetic benchmark memory needle%08d topic%02d scope%04d", F.col("r"), F.col("r") % 20, F.col("s")).alias("content"),
        F.when(F.col("r") % 3 == 0, "fact").when(F.col("r") % 3 == 1, "event").otherwise("background").alias("kind"),
        (F.col("r") % 10 / 10).alias("importance"),
    )


@R.query("select 'memories' as source, count(*) as n, count(distinct scope_key) as scopes from memories union all select 'messages', count(*), count(distinct scope_key) from messages")
def s24_health(spark: SparkSession, d: str) -> DataFrame:
    of = lambda df, name: df.agg(F.lit(name).alias("source"), F.count("*").alias("n"), F.count_distinct("scope_key").alias("scopes"))
    return of(memories(spark, d), "memories").unionByName(of(messages(spark, d), "messages"))


@R.query(f"""with r as (select scope_key, {sql_id('message_id')} id, sha256(coalesce(text,'') || '|' || {sql_label('actor')} || '|' || cast(epoch_us("at") as varchar)) h from messages)
select scope_key, id, count(*) as deliveries, count(distinct h) as contents from r where id is not null group by scope_key, id having count(distinct h) > 1""")
def s25_checked_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Identities under which different contents were delivered."""
    content = F.sha2(F.concat(F.coalesce("text", F.lit("")), F.lit("|"), values.label("actor"), F.lit("|"), micros("at").cast("string")), 256)
    rows = messages(spark, d).select("scope_key", clean_id("message_id").alias("id"), content.alias("h")).where("id is not null")
    return rows.groupBy("scope_key", "id").agg(F.count("*").alias("deliveries"), F.count_distinct("h").alias("contents")).where("contents > 1")


@R.query("""select delivery_id, len(list_distinct(list_filter(list_transform(parts, lambda p: p.text), lambda t: coalesce(t, '') <> ''))) as derived_parts,
 len(list_filter(parts, lambda p: p.media is not null and p.media.uri is not null)) as media from messages where len(parts) > 0""")
def s26_resolved_content(spark: SparkSession, d: str) -> DataFrame:
    texts = F.array_distinct(F.filter(F.transform("parts", lambda p: p.text), lambda t: F.coalesce(t, F.lit("")) != ""))
    media = F.filter("parts", lambda p: p.media.isNotNull() & p.media.uri.isNotNull())
    return messages(spark, d).where(F.size("parts") > 0).select("delivery_id", F.size(texts).alias("derived_parts"), F.size(media).alias("media"))


@R.query("select memory_id, case when state = 'confirmed' then 'expired' else state end as state, version + (state = 'confirmed')::int as version from memories where importance >= 0.1")
def s28_forget(spark: SparkSession, d: str) -> DataFrame:
    """Soft deletion of confirmed rows (a new version that is expired) and hard deletion of unimportant ones (gone)."""
    m = memories(spark, d)
    hard = m.where("importance < 0.1").select("memory_id")
    soft = F.col("state") == "confirmed"
    return m.join(hard, "memory_id", "left_anti").select("memory_id", F.when(soft, "expired").otherwise(F.col("state")).alias("state"), (F.col("version") + soft.cast("int")).alias("version"))


@R.query("""select memory_id, case when state = 'candidate' then 'applied' when state = 'confirmed' then 'already_applied' else 'conflict' end as outcome,
 case when state = 'candidate' then 'confirmed' else state end as state, version + (state = 'candidate')::int as version from memories where importance >= 0.5""")
def t07_transition_cas(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    requests = m.where("importance >= 0.5").select("memory_id", F.lit("candidate").alias("expected"), F.lit("confirmed").alias("target"))
    return store.transition(m, requests)


@R.query("""select memory_id, version, state, epoch_us(updated_at) as updated_us from (
 select *, row_number() over (partition by memory_id order by version desc nulls last, updated_at desc, log_id desc) n from memory_log where version is not null) where n = 1""")
def t07_latest_versions(spark: SparkSession, d: str) -> DataFrame:
    folded = store.fold_transitions(table(spark, d, "memory_log").where("version is not null"))
    return folded.select("memory_id", "version", "state", micros("updated_at").alias("updated_us"))
