"""Durable state, pages, bounds and further measures, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.client import MemoryClient
from memloom.functions import times, values
from memloom.functions.keys import clean_id, micros, trimmed
from memloom.operators import claims, copies, store, style
from memloom.operators.ranks import positions
from memloom.plans.analysis_queries import _STYLE
from memloom.plans.analysis_queries import ORACLE as ANALYSIS_SQL
from memloom.plans.cleaning import ORACLE as CLEANING_SQL
from memloom.plans.filter_queries import memories, messages
from memloom.plans.planning_queries import f20_path_gate
from memloom.plans.planning_queries import ORACLE as PLANNING_SQL
from memloom.plans.registry import Registry, sql_id
from memloom.plans.ranking_queries import c08_operation_and_view
from memloom.plans.ranking_queries import ORACLE as RANKING_SQL
from memloom.plans.retrieval_queries import edges
from memloom.sources.tables import table
from memloom.staging import scratch
from memloom.storage import Inbox, run_stages

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
_ACTIVE = "state in ('candidate','confirmed')"


@R.query("""select delivery_id, row_number() over (order by (received_at > timestamptz '2025-07-01 00:00:00+00' or received_at is null)::int, received_at nulls first, delivery_id) as sequence from messages""")
def s19_arrival_inbox(spark: SparkSession, d: str) -> DataFrame:
    """All messages through an inbox: what came by one moment, then everything again; known rows are not added twice, and the
    sequence they were given holds. Taken as one frozen batch, and acknowledged."""
    rows = messages(spark, d).select(F.col("delivery_id").cast("string").alias("delivery_id"), "received_at", "scope_key", "text", F.lpad(F.col("delivery_id").cast("string"), 20, "0").alias("tie"))
    inbox = Inbox(spark, scratch(spark, "inbox"), ["delivery_id"], ["received_at", "tie"])
    inbox.append(rows.where(F.col("received_at") <= times.at("2025-07-01 00:00:00")))
    inbox.append(rows)
    first, last = inbox.reserve(1 << 60)
    inbox.acknowledge(last)
    return inbox.batch(first, last).select(F.col("delivery_id").cast("long").alias("delivery_id"), "sequence")


@R.query(f"with k as ({CLEANING_SQL['p4_kept_memories']}) select memory_id, sha256(concat_ws('|', m.memory_id, m.version::varchar, coalesce(m.content, '-'))) as fingerprint from k join memories m using (memory_id) where m.{_ACTIVE}")
def t09_stages(spark: SparkSession, d: str) -> DataFrame:
    """Deduplication, lifecycle and index fingerprints as stages that each run once, the plan being put on record first."""
    stages = [
        ("deduplicate", lambda m: copies.keep_one(m, "scope_key", ["idempotency_key"], "created_at", "memory_id")),
        ("active", lambda m: m.where(F.col("state").isin("candidate", "confirmed"))),
        ("fingerprint", lambda m: m.select("memory_id", F.sha2(F.concat_ws("|", "memory_id", F.col("version").cast("string"), F.coalesce("content", F.lit("-"))), 256).alias("fingerprint"))),
    ]
    columns = ["memory_id", "scope_key", "idempotency_key", "created_at", "state", "version", "content"]
    return run_stages(spark, scratch(spark, "stages"), stages, memories(spark, d).select(*columns))


@R.query(f"""with w as (select scope_key, {sql_id('idempotency_key')} k, sha256(coalesce(content, '-')) p from memories) select scope_key, k as write_key, case when count(distinct p) > 1 then 'conflict' when count(*) > 1 then 'replayed' else 'written' end as outcome from w where k is not null group by scope_key, k""")
def t16_payload_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Repeated writes: the same payload is a replay, another one a conflict. The payloads themselves are not gathered."""
    w = memories(spark, d).select("scope_key", clean_id("idempotency_key").alias("write_key"), F.sha2(F.coalesce("content", F.lit("-")), 256).alias("p")).where("write_key is not null")
    each = w.groupBy("scope_key", "write_key").agg(F.count("*").alias("n"), F.min("p").alias("a"), F.max("p").alias("b"))
    return each.select("scope_key", "write_key", F.when(F.col("a") != F.col("b"), "conflict").when(F.col("n") > 1, "replayed").otherwise("written").alias("outcome"))


@R.query(ANALYSIS_SQL["g01_consolidate"].replace("select memory_id, operation, canonical from used union all", "select memory_id, sha256(concat_ws('|', memory_id, operation, coalesce(canonical, '-'))) as decision from used union all").replace("select memory_id, operation, canonical from mg where n > 1", "select memory_id, sha256(concat_ws('|', memory_id, operation, coalesce(canonical, '-'))) from mg where n > 1"))
def t11_decision_ids(spark: SparkSession, d: str) -> DataFrame:
    """Decisions under ids that follow from what they decide: run again, they are the same and write nothing new."""
    found = claims.consolidate(memories(spark, d))
    return found.select("memory_id", F.sha2(F.concat_ws("|", "memory_id", "operation", F.coalesce("canonical", F.lit("-"))), 256).alias("decision"))


@R.query(f"""with k as (select scope_key, memory_id, sha256(coalesce(content, '-')) h, row_number() over (partition by scope_key order by created_at, memory_id) n, count(*) over (partition by scope_key) c from memories where {_ACTIVE})
select scope_key, memory_id, h as content_hash, c > 100 as has_more from k where n <= 100""")
def s27_backfill_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of each scope's active records to be embedded, with the hash that tells whether they must be."""
    start = (F.lit("0001-01-01 00:00:00").cast("timestamp"), F.lit(""))
    page = store.page(memories(spark, d).where(F.col("state").isin("candidate", "confirmed")).select("scope_key", "memory_id", "created_at", "content"), "scope_key", "created_at", "memory_id", start, 100)
    return page.select("scope_key", "memory_id", F.sha2(F.coalesce("content", F.lit("-")), 256).alias("content_hash"), "has_more")


@R.query("""select vec_id, len(embedding) as dimension, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) as norm, len(embedding) = 64 and list_dot_product(embedding::double[], embedding::double[]) > 0 as valid from embeddings""")
def s16_vector_profile(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of a profile checked: dimension, finite values, not zero."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    fine = (F.size("embedding") == 64) & (square > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x))
    return table(spark, d, "embeddings").select("vec_id", F.size("embedding").cast("long").alias("dimension"), F.round(F.sqrt(square), 5).alias("norm"), fine.alias("valid"))


@R.query(f"""select 'put_duplicate' as verb, count(*) as n from (select row_number() over (partition by scope_key, {sql_id('idempotency_key')} order by created_at, memory_id) k, kind from memories where {sql_id('idempotency_key')} is not null) where k > 1
union all select 'records', count(*) from memories union all select 'scopes', count(distinct scope_key) from memories union all select 'forgotten', count(*) from memories where state = 'rejected'
union all select 'transitioned', count(*) from memories where state = 'candidate'""")
def s01_store_contract(spark: SparkSession, d: str) -> DataFrame:
    """The facade's verbs over the whole table, by what each touches."""
    m = memories(spark, d)
    client = MemoryClient(m)
    health = client.health()
    none = MemoryClient(m.limit(0))
    moved = client.transition(m.where("state = 'candidate'").select("memory_id", F.lit("candidate").alias("expected"), F.lit("confirmed").alias("target")))
    parts = [
        none.put(m).where("status = 'duplicate'").agg(F.count("*").alias("n")).select(F.lit("put_duplicate").alias("verb"), "n"),
        health.select(F.lit("records").alias("verb"), F.col("records").alias("n")),
        health.select(F.lit("scopes").alias("verb"), F.col("scopes").alias("n")),
        m.where("state = 'rejected'").agg(F.count("*").alias("n")).select(F.lit("forgotten").alias("verb"), "n"),
        moved.where("outcome = 'applied'").agg(F.count("*").alias("n")).select(F.lit("transitioned").alias("verb"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@R.query("select scope_key, memory_id, (row_number() over (partition by scope_key order by created_at, memory_id) - 1) // 50 as page from memories where created_at is not null")
def l02_keyset_pages(spark: SparkSession, d: str) -> DataFrame:
    """The page of fifty on which each record lies; a scope of any size is numbered in pieces."""
    placed = positions(memories(spark, d).where("created_at is not null").select("scope_key", "created_at", "memory_id"), ["scope_key"], ["created_at", "memory_id"], "n", base=0)
    return placed.select("scope_key", "memory_id", F.floor(F.col("n") / 50).alias("page"))


@R.query("""with p as (select scope_key, count(*) n from memories group by scope_key) select scope_key, n as rows, cast(ceil(n / 2000.0) as bigint) as pages, n <= 50000000 and ceil(n / 2000.0) <= 100000 as allowed from p""")
def t04_read_guard(spark: SparkSession, d: str) -> DataFrame:
    """Pages that a reader of each scope would take, against its bounds."""
    sizes = memories(spark, d).groupBy("scope_key").agg(F.count("*").alias("rows"))
    pages = F.ceil(F.col("rows") / 2000).cast("long")
    return sizes.select("scope_key", "rows", pages.alias("pages"), ((F.col("rows") <= 50_000_000) & (pages <= 100_000)).alias("allowed"))


@R.query(f"""with k as (select scope_key, memory_id, created_at, row_number() over (partition by scope_key order by created_at desc, memory_id) n from memories where {_ACTIVE} and created_at is not null)
select scope_key, memory_id, sha256(concat_ws('|', 'active', scope_key, strftime(created_at at time zone 'UTC', '%Y-%m-%dT%H:%M:%S.%f'), memory_id)) as cursor from k where n % 100 = 0""")
def t06_frozen_cursors(spark: SparkSession, d: str) -> DataFrame:
    """The cursors between pages of a frozen selection; each is bound to the selection, so it can't be used with another."""
    placed = positions(memories(spark, d).where(F.col("state").isin("candidate", "confirmed") & F.col("created_at").isNotNull()).select("scope_key", "memory_id", "created_at", (-micros("created_at")).alias("newest")), ["scope_key"], ["newest", "memory_id"], "n")
    stamp = F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return placed.where("n % 100 = 0").select("scope_key", "memory_id", F.sha2(F.concat_ws("|", F.lit("active"), "scope_key", stamp, "memory_id"), 256).alias("cursor"))


@R.query(f"""with r as (select scope_key, memory_id, kind, row_number() over (partition by scope_key order by created_at desc, memory_id) n from memories where not ({_ACTIVE})) select scope_key, count(*) filter (where n <= 20) as kept, count(*) filter (where n > 20) as dropped, min(memory_id) filter (where n <= 20) as first_id from r group by scope_key""")
def l09_bounded_trace(spark: SparkSession, d: str) -> DataFrame:
    """A trace of rejected records with at most twenty entries, and how many it leaves out."""
    order = Window.partitionBy("scope_key").orderBy(F.desc("created_at"), "memory_id")
    rejected = memories(spark, d).where(~F.col("state").isin("candidate", "confirmed"))
    kept = rejected.select("scope_key", "memory_id", F.row_number().over(order).alias("n")).where("n <= 20").groupBy("scope_key").agg(F.count("*").alias("kept"), F.min("memory_id").alias("first_id"))
    return rejected.groupBy("scope_key").agg(F.count("*").alias("all")).join(kept, "scope_key").select("scope_key", "kept", (F.col("all") - F.col("kept")).alias("dropped"), "first_id")


_ONE = "row_number() over (partition by scope_key order by {} desc nulls last, memory_id)"
_COMPOSITE = f"""with s as (select * from (select scope_key, memory_id, {_ONE.format('confidence')} n from memories where {_ACTIVE}) where n <= 100), r as (select * from (select scope_key, memory_id, {_ONE.format('importance')} n from memories where kind = 'relation') where n <= 40),
u as (select scope_key, memory_id, sum(1.0 / (60 + n)) score, min(n) best from (select * from s union all select * from r) group by scope_key, memory_id)"""


def _top(rows: DataFrame, by: str, most: int) -> DataFrame:
    order = Window.partitionBy("scope_key").orderBy(F.desc_nulls_last(by), "memory_id")
    return rows.select("scope_key", "memory_id", F.row_number().over(order).alias("n")).where(F.col("n") <= most)


@R.query(_COMPOSITE + " select scope_key, memory_id, position from (select *, row_number() over (partition by scope_key order by round(score, 12) desc, best, memory_id) as position from u) where position <= 20")
def l07_l11_composite(spark: SparkSession, d: str) -> DataFrame:
    """A hundred semantic and forty relation candidates of each scope, fused in order of (score, best rank, identity), twenty kept."""
    m = memories(spark, d)
    both = _top(m.where(F.col("state").isin("candidate", "confirmed")), "confidence", 100).unionByName(_top(m.where("kind = 'relation'"), "importance", 40))
    fused = both.groupBy("scope_key", "memory_id").agg(F.round(F.sum(1 / (60 + F.col("n"))), 12).alias("score"), F.min("n").alias("best"))
    order = Window.partitionBy("scope_key").orderBy(F.desc("score"), "best", "memory_id")
    return fused.select("scope_key", "memory_id", F.row_number().over(order).alias("position")).where("position <= 20")


@R.query("select scope_key, kind, memory_id, n as choice from (select scope_key, kind, memory_id, row_number() over (partition by scope_key, kind order by importance desc, memory_id) n, count(*) over (partition by scope_key, kind) c from memories) where n <= 3 and c >= 3")
def l13_exactly_k(spark: SparkSession, d: str) -> DataFrame:
    """Exactly three of each scope and kind, or none where there are fewer."""
    order = Window.partitionBy("scope_key", "kind").orderBy(F.desc("importance"), "memory_id")
    top = memories(spark, d).select("scope_key", "kind", "memory_id", F.row_number().over(order).alias("choice")).where("choice <= 3")
    whole = top.groupBy("scope_key", "kind").agg(F.count("*").alias("c")).where("c = 3").drop("c")
    return top.join(whole, ["scope_key", "kind"])


@R.query(f"with f as ({PLANNING_SQL['f20_path_gate']}), w as (select 'c' || o_custkey anchor, 'o' || o_orderkey mid, 'p' || l_partkey as last from orders join lineitem on l_orderkey = o_orderkey), fc as (select anchor, count(*) n from f group by anchor), wc as (select anchor, count(*) n from w group by anchor) select wc.anchor, wc.n as expected, coalesce(fc.n, 0) as found, round(coalesce(fc.n, 0) / wc.n::double, 6) as recall, fc.n is null as missed from wc left join fc using (anchor)")
def a22_path_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Of each customer's paths, the part that the gate lets through, and whether it loses all of them."""
    e = edges(spark, d)
    every = e.where("name = 'PLACED'").select(F.col("source").alias("anchor"), F.col("target").alias("mid")).join(e.where("name = 'CONTAINS'").select(F.col("source").alias("mid"), F.col("target").alias("last")), "mid")
    expected = every.groupBy("anchor").agg(F.count("*").alias("expected"))
    found = f20_path_gate(spark, d).groupBy("anchor").agg(F.count("*").alias("f"))
    met = expected.join(found, "anchor", "left")
    return met.select("anchor", "expected", F.coalesce("f", F.lit(0)).alias("found"), F.round(F.coalesce("f", F.lit(0)) / F.col("expected"), 6).alias("recall"), F.col("f").isNull().alias("missed"))


@R.query(f"""with r as (select scope_key, memory_id, kind = 'fact' and state = 'confirmed' want, state in ('rejected','superseded') bad, {_ONE.format('importance')} n from memories)
select scope_key, count(*) filter (where want and n > 50) as missing, count(*) filter (where bad and n <= 50) as forbidden, abs(count(*) filter (where want) - count(*) filter (where want and n <= 50)) as count_error from r group by scope_key""")
def a25_query_quality(spark: SparkSession, d: str) -> DataFrame:
    """Fifty answers a scope against what is wanted and what is forbidden in them."""
    m = memories(spark, d)
    want, bad = (F.col("kind") == "fact") & (F.col("state") == "confirmed"), F.col("state").isin("rejected", "superseded")
    top = _top(m, "importance", 50).select("memory_id", F.lit(True).alias("given"))
    met = m.select("scope_key", "memory_id", want.alias("want"), bad.alias("bad")).join(top, "memory_id", "left").withColumn("given", F.coalesce("given", F.lit(False)))
    both = F.count_if(F.col("want") & F.col("given"))
    return met.groupBy("scope_key").agg(F.count_if(F.col("want") & ~F.col("given")).alias("missing"), F.count_if(F.col("bad") & F.col("given")).alias("forbidden"), F.abs(F.count_if("want") - both).alias("count_error"))


@R.query(r"""with t as (select memory_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(content, '')), '[\p{L}\p{N}]+'))) w from memories) select m.memory_id, m.state, count(*) as words from t join memories m using (memory_id) where w in ('contact', 'promised', 'suitcase', 'notebook') group by m.memory_id, m.state""")
def j02_index_join(spark: SparkSession, d: str) -> DataFrame:
    """Postings of a few terms joined back with their records."""
    words = F.regexp_extract_all(F.lower(F.coalesce("content", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    asked = F.array(*[F.lit(w) for w in ("contact", "promised", "suitcase", "notebook")])
    postings = memories(spark, d).select("memory_id", F.size(F.array_intersect(F.array_distinct(words), asked)).cast("long").alias("words")).where("words > 0")
    return postings.join(memories(spark, d).select("memory_id", "state"), "memory_id").select("memory_id", "state", "words")


@R.query(f"with q as ({RANKING_SQL['c08_operation_and_view']}) select delivery_id, case when operation = 'count' then 'count' when temporal_view = 'planned' then 'plan' when temporal_view = 'prior' then 'history' when operation = 'list' then 'list' else 'fact' end as intent from q")
def prj19_intents(spark: SparkSession, d: str) -> DataFrame:
    """Operation and temporal view of a newer plan as the one intent of an older one."""
    op, view = F.col("operation"), F.col("temporal_view")
    intent = F.when(op == "count", "count").when(view == "planned", "plan").when(view == "prior", "history").when(op == "list", "list").otherwise("fact")
    return c08_operation_and_view(spark, d).select("delivery_id", intent.alias("intent"))


@R.query(f"""with g as (select scope_key, topic_key, count(*) n, count(distinct coalesce(actor, '-')) a, count(distinct coalesce(kind, '-')) k, min(actor) actor, min(kind) kind from memories where topic_key is not null group by scope_key, topic_key)
select m.memory_id, case when g.a = 1 then null else m.actor end as actor, case when g.k = 1 then null else m.kind end as kind, case when g.a = 1 then g.actor end as shared_actor, case when g.k = 1 then g.kind end as shared_kind from memories m join g using (scope_key, topic_key)""")
def prj21_context_factoring(spark: SparkSession, d: str) -> DataFrame:
    """Values that all items of a context share are given once; coalescing both gives every item back."""
    m = memories(spark, d).where("topic_key is not null").select("memory_id", "scope_key", "topic_key", "actor", "kind")
    shared = m.groupBy("scope_key", "topic_key").agg(*[F.when(F.min(F.coalesce(c, F.lit("-"))) == F.max(F.coalesce(c, F.lit("-"))), F.min(c)).alias(f"shared_{c}") for c in ("actor", "kind")])
    met = m.join(shared, ["scope_key", "topic_key"])
    return met.select("memory_id", *[F.when(F.col(f"shared_{c}").isNull(), F.col(c)).alias(c) for c in ("actor", "kind")], "shared_actor", "shared_kind")


_LEVELS = {"terminal_ratio": (0.30, 0.70, 90), "question_ratio": (0.05, 0.30, 70), "emoji_ratio": (0.02, 0.20, 60), "multiline_ratio": (0.05, 0.20, 50), "exclamation_ratio": (0.05, 0.25, 40)}
_EACH = " union all ".join(f"select scope_key, author, messages, '{c}' as feature, {p} as priority, case when {c} >= {hi} then 'often' when {c} <= {lo} then 'rarely' else 'naturally' end as directive from p" for c, (lo, hi, p) in _LEVELS.items())


@R.query(f"""with {_STYLE}, e as ({_EACH} union all select scope_key, author, messages, 'message_length', 100, greatest(1, round(median_length * 0.6))::bigint || '-' || greatest(greatest(1, round(median_length * 0.6)), least(200, round(greatest(mean_length, median_length) * 1.4)))::bigint from p)
select scope_key, author, feature, priority::bigint as priority, directive, round(least(1.0, sqrt(messages / 100.0)), 4) as confidence from e""")
def c23_style_guidance(spark: SparkSession, d: str) -> DataFrame:
    """Guidance from each author's profile: a range of lengths, and for five habits whether to show them often, rarely or as it comes."""
    p = style.profile(messages(spark, d).withColumn("author", values.label("actor")), ["scope_key", "author"], trimmed("text"))
    return style.directives(p, ["scope_key", "author"], {c: (lo, hi, n) for c, (lo, hi, n) in _LEVELS.items()})
