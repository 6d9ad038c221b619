"""Functions of planning, relation paths and texts, each over its whole table."""

from __future__ import annotations

import collections
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import times, values
from memloom.functions.keys import clean_id, micros
from memloom.operators import graph, lexical, planning, style, vectors
from memloom.plans.filter_queries import memories, messages
from memloom.plans.registry import Registry, sql_id, sql_label, sql_nfkc, sql_normal
from memloom.plans.retrieval_queries import _ASK, _BM25, _EDGES, _EXPLORED, _documents, _explored, _questions, edges
from memloom.providers import ByColumn, rerank
from memloom.sources.tables import table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

_G = r"regexp_replace({}, '[^0-9a-z㐀-鿿]+', '', 'g')"


@R.query(rf"""with t as (select memory_id, {_G.format("lower(content)")} t from memories where content is not null),
g as (select memory_id, unnest(list_concat(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)), list_transform(range(1, length(t)), lambda i: substr(t, i, 2)))) g from t)
select memory_id, count(*) as grams, count(distinct g) as kinds from g group by memory_id""")
def c04_gram_counts(spark: SparkSession, d: str) -> DataFrame:
    """Character pairs and single characters of each content."""
    text = F.lower("content")
    rows = memories(spark, d).where("content is not null").select("memory_id", F.concat(values.grams(text, 1), values.grams(text, 2)).alias("g"))
    return rows.where(F.size("g") > 0).select("memory_id", F.size("g").cast("long").alias("grams"), F.size(F.array_distinct("g")).cast("long").alias("kinds"))


def _equals(value: str) -> Callable[[Column], Column]:
    return lambda x: x == value


@R.query(rf"""with d as (select memory_id, {_G.format("lower(coalesce(content,''))")} t from memories), q as (select unnest(list_transform(range(1, length(q)), lambda i: substr(q, i, 2))) g from (select {_G.format(repr(_ASK))} q)),
qc as (select g, count(*) n from q group by g), dc as (select memory_id, g, count(*) n from (select memory_id, unnest(list_transform(range(1, length(t)), lambda i: substr(t, i, 2))) g from d) group by memory_id, g),
o as (select memory_id, sum(least(dc.n, qc.n)) o from dc join qc using (g) group by memory_id)
select memory_id, round(coalesce(o, 0) / (select sum(n) from qc), 6) as coverage from d left join o using (memory_id)""")
def c06_focused_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The part of a question's character pairs that a content has."""
    q = re.sub(values.GRAM_DROP, "", _ASK)
    asked = collections.Counter(q[i : i + 2] for i in range(len(q) - 1))
    pairs = values.grams(F.lower(F.coalesce("content", F.lit(""))), 2)
    known = F.array(*[F.lit(g) for g in asked])
    rows = memories(spark, d).select("memory_id", F.filter(pairs, lambda g: F.array_contains(known, g)).alias("g"))
    both = sum((F.least(F.size(F.filter("g", _equals(g))), F.lit(n)) for g, n in asked.items()), F.lit(0))
    return rows.select("memory_id", F.round(both / sum(asked.values()), 6).alias("coverage"))


def _sql_search(c: str) -> str:
    # RE2 knows no look-behind: a date of month and day, or a year alone, counts here without looking at what stands before it.
    text = rf"regexp_replace(lower({sql_nfkc(c)}), '(20\d{{2}})\s*(?:年|[-/])\s*(\d{{1,2}})\s*(?:月|[-/])\s*(\d{{1,2}})\s*日?|(20\d{{2}})\s*(?:年|[-/])\s*(\d{{1,2}})\s*月?|(\d{{1,2}})\s*月\s*(\d{{1,2}})\s*日|(20\d{{2}})\s*年', '', 'g')"
    for phrase in planning.STOP_PHRASES:
        text = f"replace({text}, '{phrase}', '')"
    return rf"regexp_replace({text}, '[\s\p{{Z}}，。！？；：、,.!?;:]+', '', 'g')"


@R.query(f"select delivery_id, {_sql_search('text')} as search from messages where text is not null")
def c07_search_text(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).where("text is not null").select("delivery_id", F.regexp_replace(planning.search_text("text"), r"\p{Z}+", "").alias("search"))


#: Ways to write a record's time, by its importance: a day in two forms, a month, a day without its year, a year, two days.
_FORMS = ("yyyy年M月d日", "yyyy-M-d", "yyyy年M月", "M月d日", "yyyy年")


def _dated(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    rows = memories(spark, d).select("memory_id", "created_at", (F.floor(F.col("importance") * 1000) % 6).cast("int").alias("form"))
    text = F.concat(F.date_format("created_at", _FORMS[0]), F.lit(" or "), F.date_format("created_at", _FORMS[1]))
    for i, form in enumerate(_FORMS):
        text = F.when(F.col("form") == i, F.concat(F.lit("what of "), F.date_format("created_at", form), F.lit("?"))).otherwise(text)
    return rows.withColumn("said", text), F.col("said")


def _sql_dated(hours: int) -> str:
    at = f"- interval {hours} hour"
    return f"""with r as (select memory_id, created_at at time zone 'UTC' t, cast(floor(importance * 1000) as bigint) % 6 form from memories),
s as (select memory_id, form, t, case form when 2 then date_trunc('month', t) when 4 then date_trunc('year', t) when 3 then make_timestamp(2026, month(t), day(t), 0, 0, 0) + interval 12 hour else date_trunc('day', t) + interval 12 hour end a from r)
select memory_id, case when form = 5 then null when form in (2, 4) then 'interval' else 'point' end as shape, case when form < 5 then epoch_us(a {at}) end as start_us,
 case when form = 2 then epoch_us(a + interval 1 month - interval 1 second {at}) when form = 4 then epoch_us(a + interval 1 year - interval 1 second {at}) when form < 5 then epoch_us(a {at}) end as end_us from s"""


def _calendar(spark: SparkSession, d: str, zone: str) -> DataFrame:
    rows, said = _dated(spark, d)
    return rows.select("memory_id", times.calendar_expression(said, 2026, zone).alias("x")).select("memory_id", F.col("x.shape").alias("shape"), micros("x.start").alias("start_us"), micros("x.end").alias("end_us"))


@R.query(_sql_dated(0))
def c09_calendar_expression(spark: SparkSession, d: str) -> DataFrame:
    """Each record's time written in one of five ways (or two dates at once, which is none), and read back."""
    return _calendar(spark, d, "UTC")


@R.query(_sql_dated(8))
def c10_calendar_zone(spark: SparkSession, d: str) -> DataFrame:
    """The same in a zone: its noon and its midnight, in UTC."""
    return _calendar(spark, d, "Asia/Shanghai")


@R.query(f"""with e as ({_sql_dated(0)}) select memory_id, case when shape is null then view when shape = 'point' then 'as_of' else 'interval' end as view, case when shape = 'point' then start_us end as as_of_us,
 case when shape = 'interval' then start_us end as from_us, case when shape = 'interval' then end_us end as to_us from e join (select memory_id, case when state in ('candidate','confirmed') then 'current' else 'prior' end view from memories) using (memory_id)""")
def c11_grounded_draft(spark: SparkSession, d: str) -> DataFrame:
    """A draft whose view is repaired by the calendar expression in its question: a point makes it as-of, a span an interval."""
    rows, said = _dated(spark, d)
    x = times.calendar_expression(said, 2026)
    view = memories(spark, d).select("memory_id", F.when(F.col("state").isin("candidate", "confirmed"), "current").otherwise("prior").alias("view"))
    met = rows.select("memory_id", x.alias("x")).join(view, "memory_id")
    point, span = F.col("x.shape") == "point", F.col("x.shape") == "interval"
    return met.select("memory_id", F.when(point, "as_of").when(span, "interval").otherwise(F.col("view")).alias("view"), F.when(point, micros("x.start")).alias("as_of_us"), F.when(span, micros("x.start")).alias("from_us"), F.when(span, micros("x.end")).alias("to_us"))


@R.query("select memory_id, round(1 / (1 + exp(greatest(-60, least(60, importance * 400 - 200)))), 9) as similarity from memories")
def c12_fts_similarity(spark: SparkSession, d: str) -> DataFrame:
    """A full-text rank (the better, the lower) as a similarity."""
    rank = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.col("importance") * 400 - 200))
    return memories(spark, d).select("memory_id", F.round(1 / (1 + F.exp(rank)), 9).alias("similarity"))


@R.query("""with v as (select memory_id, lower(trim(coalesce(content, ''), ' ')) v from memories), r as (select memory_id, regexp_extract_all(v, '[㐀-鿿]{2,}') runs from v),
x as (select memory_id, i, runs[i] run from r, unnest(range(1, len(runs) + 1)) u(i)), f as (select memory_id, i, n, j, substr(run, j, n) term from x, (values (2), (3), (4)) s(n), unnest(range(1, greatest(length(run) - n + 2, 1))) w(j)),
o as (select memory_id, term, min((i, n, j)) pos from (select memory_id, 0 i, 0 n, 0 j, v term from v where v <> '' and not regexp_full_match(v, '[㐀-鿿]') union all select memory_id, i, n, j, term from f) group by memory_id, term),
k as (select *, row_number() over (partition by memory_id order by pos) p from o)
select v.memory_id, coalesce(list(term order by pos) filter (where p <= 64), []) as terms from v left join k using (memory_id) group by v.memory_id""".replace("lower(trim", "replace(lower(trim").replace("' ')) v from", "' ')), 'ß', 'ss') v from"))
def c14_hint_fragments(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).select("memory_id", planning.hint_fragments("content").alias("terms"))


_RANKED = f"row_number() over (partition by scope_key order by created_at, memory_id) rank, count(*) over (partition by scope_key) n, {sql_label('topic_key')} <> '' hints, coalesce(contains(content, topic_key), false) hm, importance > 0.9 rr, kind = 'relation' ht, {sql_label('personal_memory_type')} <> '' sg, {sql_label('personal_memory_type')} = 'relationship' sm"


@R.query(f"""with r as (select memory_id, {_RANKED} from memories), b as (select *, round(1 - rank / (2.0 * n), 6) base from r)
select memory_id, case when ht or rr then base when sg then case when sm then base else least(base, 0.2) end when not hints or hm then base else least(base, 0.2) end as score from b""")
def c15_relation_score(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    order = Window.partitionBy("scope_key").orderBy("created_at", "memory_id")
    rows = m.withColumns({"rank": F.row_number().over(order), "n": F.count("*").over(Window.partitionBy("scope_key"))})
    topic, kind = values.label("topic_key"), values.label("personal_memory_type")
    score = planning.relation_score(
        F.col("rank"), F.col("n"), hints=topic != "", hint_match=F.coalesce(F.contains("content", F.col("topic_key")), F.lit(False)), reranked=F.col("importance") > 0.9, hard_type=F.col("kind") == "relation", suggested=kind != "", suggested_match=kind == "relationship"
    )
    return rows.select("memory_id", score.alias("score"))


@R.query(r"""with recursive t as (select doc_id, text, length(text) n from documents where length(text) > 0),
s as (select doc_id, 0 a, case when n <= 1200 then n else 600 + coalesce(nullif(length(regexp_replace(substr(text, 601, 600), '[^\s\x{85}\p{Z}\x{1c}-\x{1f}]*$', '')), 0), 600) end b, n, text from t
 union all select doc_id, greatest(a + 1, b - 160), case when n <= greatest(a + 1, b - 160) + 1200 then n else greatest(a + 1, b - 160) + 600 + coalesce(nullif(length(regexp_replace(substr(text, greatest(a + 1, b - 160) + 601, 600), '[^\s\x{85}\p{Z}\x{1c}-\x{1f}]*$', '')), 0), 600) end, n, text from s where b < n)
select doc_id, a as start, b as "end" from s""")
def c16_text_spans(spark: SparkSession, d: str) -> DataFrame:
    return planning.text_spans(table(spark, d, "documents"), "doc_id", "text")


_BOUND = f"coalesce(event_time is not null and {sql_label('personal_memory_type')} = 'episode' and len(list_filter(evidence, lambda e: e.evidence_id = event_time.evidence_id and e.actor = memories.actor and e.at = event_time.anchor_observed_at)) > 0, false)"


def _bound_event() -> Column:
    cited = F.exists("evidence", lambda e: (e.evidence_id == F.col("event_time.evidence_id")) & (e.actor == F.col("actor")) & (e["at"] == F.col("event_time.anchor_observed_at")))
    return F.coalesce(F.col("event_time").isNotNull() & (values.label("personal_memory_type") == "episode") & cited, F.lit(False))


@R.query(f"select memory_id, case when event_time is null then 'none' when {sql_label('personal_memory_type')} <> 'episode' then 'not_an_episode' when {_BOUND} then 'bound' else 'unbound' end as verdict from memories")
def c19_record_event_time(spark: SparkSession, d: str) -> DataFrame:
    """Whether a record's event time is that of an episode and bound to evidence it cites."""
    verdict = F.when(F.col("event_time").isNull(), "none").when(values.label("personal_memory_type") != "episode", "not_an_episode").when(_bound_event(), "bound").otherwise("unbound")
    return memories(spark, d).select("memory_id", verdict.alias("verdict"))


@R.query("""select memory_id, (event_time."start" is null or event_time."end" is null or event_time."start" < timestamptz '2025-03-01 00:00:00+00' or event_time."end" > timestamptz '2025-09-01 00:00:00+00') as uncertain from memories where event_time is not null""")
def c20_uncertain_interval(spark: SparkSession, d: str) -> DataFrame:
    """Events that are not known to lie within the interval asked for."""
    a, b = F.col("event_time.start"), F.col("event_time.end")
    test = a.isNull() | b.isNull() | (a < times.at("2025-03-01 00:00:00")) | (b > times.at("2025-09-01 00:00:00"))
    return memories(spark, d).where("event_time is not null").select("memory_id", test.alias("uncertain"))


_REVIEWED = """'{"source_grounding":{"decision":{"verdict":"' || case when importance > 0.8 then 'contradicted' else 'supported' end || '"}}}'"""


@R.query("select memory_id, importance > 0.8 as disputed from memories")
def c21_source_disputed(spark: SparkSession, d: str) -> DataFrame:
    """Records whose grounding review, read from their metadata, contradicts them."""
    reviewed = memories(spark, d).select("memory_id", F.expr(_REVIEWED).alias("metadata"))
    return reviewed.select("memory_id", F.coalesce(F.get_json_object("metadata", "$.source_grounding.decision.verdict") == "contradicted", F.lit(False)).alias("disputed"))


@R.query("select memory_id, sha1('x') <> '' and true as ok, null::varchar as id from memories where false")
def c24_graph_ids(spark: SparkSession, d: str) -> DataFrame:
    """Name-based ids of episodes, and the scope-salted pseudonym of a subject."""
    subject = F.coalesce(clean_id("subject_id"), clean_id("scope_user"), F.lit("owner"))
    return memories(spark, d).select(
        "memory_id", planning.uuid5(uuid.NAMESPACE_URL.hex, F.concat_ws(":", "scope_key", "memory_id")).alias("episode"), F.concat(F.lit("Subject-"), F.substring(F.sha2(F.concat_ws(":", "scope_key", subject), 256), 1, 24)).alias("subject")
    )


_NS = f"""from_hex('{uuid.NAMESPACE_URL.hex}')"""
ORACLE["c24_graph_ids"] = f"""with h as (select memory_id, scope_key, coalesce({sql_id('subject_id')}, {sql_id('scope_user')}, 'owner') s, sha1({_NS} || encode(concat_ws(':', scope_key, memory_id))) h from memories)
select memory_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as episode,
 'Subject-' || substr(sha256(concat_ws(':', scope_key, s)), 1, 24) as subject from h"""


@R.query(f"""with q as (select 'x' q), n as (select memory_id, lower({sql_nfkc("coalesce(content, '')")}) t from memories),
f as (select memory_id, 'w:' || unnest(regexp_extract_all(t, '[a-z0-9]+')) f, 2 w from n union all select memory_id, 'c:' || unnest(regexp_extract_all(t, '[㐀-鿿]')), 1 from n
 union all select memory_id, 'b:' || substr(h, i, 2), 3 from (select memory_id, regexp_replace(t, '[^㐀-鿿]', '', 'g') h from n), unnest(range(1, greatest(length(h), 1))) u(i)),
c as (select memory_id, f, sum(w) w from f group by memory_id, f), a as (select * from (values ('w:where', 2), ('w:did', 2), ('w:the', 4), ('w:contact', 2), ('w:leave', 2), ('w:notebook', 2)) v(f, w))
select c.memory_id, round(sum(c.w * coalesce(a.w, 0)) / (sqrt(sum(c.w * c.w)) * sqrt((select sum(w * w) from a))), 6) as cosine from c left join a using (f) group by c.memory_id""")
def c28_feature_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of weighted words, Han characters and Han pairs with a fixed question."""
    text = F.lower(values.nfkc(F.coalesce("content", F.lit(""))))
    rows = memories(spark, d).select("memory_id", text.alias("t")).withColumn("chars", F.regexp_extract_all("t", F.lit("[㐀-鿿]"), F.lit(0)))
    pairs = F.filter(F.zip_with("chars", F.slice("chars", F.lit(2), F.size("chars")), lambda x, y: F.concat(x, y)), lambda x: x.isNotNull())
    weighted = lambda prefix, a, w: F.transform(a, lambda x: F.struct(F.concat(F.lit(prefix), x).alias("f"), F.lit(w).alias("w")))
    every = F.concat(weighted("w:", F.regexp_extract_all("t", F.lit("[a-z0-9]+"), F.lit(0)), 2), weighted("c:", F.col("chars"), 1), weighted("b:", pairs, 3))
    flat = rows.select("memory_id", F.explode(every).alias("x")).groupBy("memory_id", "x.f").agg(F.sum("x.w").alias("w"))
    asked = {f"w:{w}": 2 * n for w, n in collections.Counter(_ASK.split()).items()}
    other = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in asked.items() for v in pair]), F.col("f")), F.lit(0))
    norm = sum(v * v for v in asked.values()) ** 0.5
    return flat.groupBy("memory_id").agg(F.round(F.sum(F.col("w") * other) / (F.sqrt(F.sum(F.col("w") * F.col("w"))) * norm), 6).alias("cosine"))


@R.query(f"select delivery_id, {sql_nfkc('text')} as text from messages where text is not null")
def c31_nfkc(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).where("text is not null").select("delivery_id", values.nfkc("text").alias("text"))


@R.query(f"select memory_id, {sql_normal('content')} as content, case when {sql_label('personal_memory_type')} = 'episode' and {sql_label('event_key')} = '' then null else sha256(concat_ws('|', {sql_label('event_key')}, {sql_normal('content')}, {sql_label('temporal_status')}, {sql_label('revision_kind')})) end as signature from memories")
def c26_merge_signature(spark: SparkSession, d: str) -> DataFrame:
    """Normal content, and what must agree for two records to be merged; an episode without a key merges with none."""
    rows = memories(spark, d).select("memory_id", values.normal_text("content").alias("content"), values.label("personal_memory_type").alias("t"), values.label("event_key").alias("k"), values.label("temporal_status").alias("s"), values.label("revision_kind").alias("r"))
    return rows.select("memory_id", "content", F.when(~((F.col("t") == "episode") & (F.col("k") == "")), F.sha2(F.concat_ws("|", "k", "content", "s", "r"), 256)).alias("signature"))


@R.query("""select delivery_id, substr(regexp_replace(trim(regexp_replace(text, '[\\s\\x{85}\\x0b\\p{Z}]+', ' ', 'g'), ' '), '[\\p{Cc}\\p{Cf}\\p{Co}]', '', 'g'), 1, 12) as phrase from messages where text is not null""")
def c33_bounded_phrase(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).where("text is not null").select("delivery_id", planning.bounded_phrase(F.col("text"), 12).alias("phrase"))


# Relation paths and ranks ----------------------------------------------------------------------------------------


@R.query("""with f as (select 'c' || o_custkey anchor, 'o' || o_orderkey mid, o_orderkey k, o_orderdate t1 from orders)
select anchor, mid, 'p' || l_partkey as last from f join lineitem on l_orderkey = k where l_shipdate >= t1 and t1 <= timestamp '1997-01-01' and l_shipdate <= timestamp '1997-01-01'""")
def f20_path_gate(spark: SparkSession, d: str) -> DataFrame:
    """Two-hop paths of all customers whose hops have the wanted types and directions, differ, lie before a time and in time order."""
    typed = edges(spark, d).where("valid_at <= timestamp '1997-01-01'")
    one = typed.where("name = 'PLACED'").select(F.col("source").alias("anchor"), F.col("target").alias("mid"), F.col("valid_at").alias("t1"), F.col("uuid").alias("u1"))
    two = typed.where("name = 'CONTAINS'").select(F.col("source").alias("mid"), F.col("target").alias("last"), F.col("valid_at").alias("t2"), F.col("uuid").alias("u2"))
    return one.join(two, "mid").where("t2 >= t1 and u1 != u2 and last != anchor").select("anchor", "mid", "last")


@R.query(f"""with {_EXPLORED} select anchor, nodes, row_number() over (partition by anchor order by (hops <> 2)::int, (case when hops = 2 and left(nodes[3], 1) = 'p' then 0 else 1 end), array_to_string(edges, '|'), nodes) as rank from ex where position <= 256""")
def l12_exploration_order(spark: SparkSession, d: str) -> DataFrame:
    """Explored paths with two hops before others, those that end in the wanted type first, then by edge ids."""
    paths = _explored(spark, d)
    last = F.when((F.col("hops") == 2) & F.startswith(F.element_at("nodes", -1), F.lit("p")), "CONTAINS")
    order = planning.exploration_order(F.col("hops"), last, F.col("edges"), 2, ("CONTAINS",))
    return paths.select("anchor", "nodes", F.row_number().over(Window.partitionBy("anchor").orderBy(*order, "nodes")).alias("rank"))


@R.query("""with q as (select vec_id query, embedding e from embeddings where vec_id % 50 = 0),
s as (select q.query, v.vec_id, round(1 - list_cosine_similarity(q.e::double[], v.embedding::double[]), 6) distance, d.created_at c from q, embeddings v join documents d on d.doc_id = v.vec_id where v.vec_id <> q.query)
select query, vec_id, rank from (select *, row_number() over (partition by query order by distance, c desc, vec_id) as rank from s) where rank <= 10""")
def l05_vector_topk(spark: SparkSession, d: str) -> DataFrame:
    """Nearest records by distance, the newer first where it is equal, then by id."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "created_at")
    v = table(spark, d, "embeddings").join(docs, "vec_id")
    near = vectors.search_all(v, table(spark, d, "embeddings").where("vec_id % 50 = 0"), 40)
    order = Window.partitionBy("query").orderBy(F.round(1 - F.col("similarity"), 6), F.desc("created_at"), "vec_id")
    return near.join(docs, "vec_id").withColumn("rank", F.row_number().over(order)).where("rank <= 10").select("query", "vec_id", "rank")


@R.query(f"""with {_BM25}, k as (select query, doc, source, rank from bm join documents on doc_id = doc where rank <= 30), o as (select *, row_number() over (partition by query, source order by rank) n from k)
select query, doc, row_number() over (partition by query order by rank) as position from o where n = 1""")
def w03_rank_after_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Ranks within a list once each source is left with its best hit."""
    top = lexical.bm25(_documents(spark, d), _questions(spark, d), 30).select("query", "doc", "rank")
    sourced = top.join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc")
    best = sourced.groupBy("query", "source").agg(F.min(F.struct("rank", "doc")).alias("x")).select("query", "x.*")
    return best.select("query", "doc", F.row_number().over(Window.partitionBy("query").orderBy("rank")).alias("position"))


@R.query(f"with {_BM25} select query, min(rank) as first_rank from bm join documents on doc_id = doc where rank <= 30 and source = 'eval_log' group by query")
def w04_first_relevant(spark: SparkSession, d: str) -> DataFrame:
    """The rank of the first hit that counts: here one from the evaluation logs."""
    top = lexical.bm25(_documents(spark, d), _questions(spark, d), 30).select("query", "doc", "rank")
    good = table(spark, d, "documents").where("source = 'eval_log'").select(F.col("doc_id").alias("doc"))
    return top.join(good, "doc").groupBy("query").agg(F.min("rank").alias("first_rank"))


@R.query(f"with {_BM25} select query, doc, row_number() over (partition by query order by n_chars desc, rank) as position from bm join documents on doc_id = doc where rank <= 20")
def w05_rerank_order(spark: SparkSession, d: str) -> DataFrame:
    """A reranker's score first, the input's place where scores are equal."""
    top = lexical.bm25(_documents(spark, d), _questions(spark, d), 20).select("query", "doc", "rank")
    scored = top.join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "n_chars"), "doc")
    return scored.select("query", "doc", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("n_chars"), "rank")).alias("position"))


@R.query("""select memory_id, 'episode:v5:' || replace(replace(rtrim(base64(encode(memory_id)), '='), '+', '-'), '/', '_') || ':' || substr(sha256(coalesce(content, '-')), 1, 16) || ':' || version as name, memory_id as decoded, version::bigint as version from memories where version is not null""")
def c25_episode_names(spark: SparkSession, d: str) -> DataFrame:
    """Names of indexed records, and what they say when read back."""
    name = planning.episode_name(F.col("memory_id"), F.substring(F.sha2(F.coalesce("content", F.lit("-")), 256), 1, 16), F.col("version"))
    rows = memories(spark, d).where("version is not null").select("memory_id", name.alias("name")).withColumn("x", planning.episode_parts(F.col("name")))
    return rows.select("memory_id", "name", F.col("x.ident").alias("decoded"), F.col("x.version").cast("long").alias("version"))


@R.query("""select kind, state, count(*) as records, sha256('{"kinds":["' || kind || '"],"states":["' || state || '"],"view":"current"}') as fingerprint from memories where kind is not null and state is not null group by kind, state""")
def c27_plan_fingerprints(spark: SparkSession, d: str) -> DataFrame:
    """A fingerprint of the plan that asks for each kind and state: the hash of its JSON with sorted keys."""
    plan = F.to_json(F.struct(F.array("kind").alias("kinds"), F.array("state").alias("states"), F.lit("current").alias("view")))
    sizes = memories(spark, d).where("kind is not null and state is not null").groupBy("kind", "state").agg(F.count("*").alias("records"))
    return sizes.select("kind", "state", "records", F.sha2(plan, 256).alias("fingerprint"))


@R.query("select delivery_id, replace(replace(replace(replace(replace(replace(text, 'contact', chr(1)), 'owner', chr(2)), '联系人', chr(3)), chr(1), 'owner'), chr(2), 'contact'), chr(3), '主人') as text from messages where text is not null")
def c32_swapped_terms(spark: SparkSession, d: str) -> DataFrame:
    """Texts with their entities exchanged at once, for checks that answers follow the names."""
    return messages(spark, d).where("text is not null").select("delivery_id", planning.swap_terms(F.col("text"), {"contact": "owner", "owner": "contact", "联系人": "主人"}).alias("text"))


@R.query("""with r as (select 'c' || o_custkey anchor, 'p' || l_partkey as last, o_orderdate <= timestamp '1995-01-01' early from orders join lineitem on l_orderkey = o_orderkey)
select anchor, last, count(distinct early) as routes, count(*) as paths from r group by anchor, last""")
def j20_fused_routes(spark: SparkSession, d: str) -> DataFrame:
    """Two exact routes from every customer to the parts they bought (before a time, after it), fused by where they lead."""
    e = edges(spark, d)
    early = F.col("valid_at") <= F.lit("1995-01-01 00:00:00").cast("timestamp")
    anchors = table(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("anchor")).distinct()
    routes = [graph.typed_paths(e.where((F.col("name") != "PLACED") | (early if k else ~early)), anchors, [("PLACED", True), ("CONTAINS", True)]).select("anchor", F.col("nodes")[2].alias("last"), F.lit(k).alias("route")) for k in (0, 1)]
    return routes[0].unionByName(routes[1]).groupBy("anchor", "last").agg(F.count_distinct("route").alias("routes"), F.count("*").alias("paths"))


@R.query("select scope_key, memory_id, row_number() over (partition by scope_key order by confidence desc nulls last, n) as position from (select scope_key, memory_id, confidence, row_number() over (partition by scope_key order by created_at desc, memory_id) n from memories) where n <= 50")
def x03_reranked(spark: SparkSession, d: str) -> DataFrame:
    """The fifty newest records of each scope through a reranker behind its interface."""
    order = Window.partitionBy("scope_key").orderBy(F.desc("created_at"), "memory_id")
    newest = memories(spark, d).select("scope_key", "memory_id", "confidence", F.row_number().over(order).alias("rank")).where("rank <= 50")
    return rerank(newest, ByColumn("confidence"), "scope_key").select("scope_key", "memory_id", "position")
