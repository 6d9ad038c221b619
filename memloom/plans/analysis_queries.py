"""Aggregates, windows, claim processing, style, index upkeep and quality metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import times, values
from memloom.functions.keys import clean_id, micros, trimmed
from memloom.operators import claims, context, lexical, style
from memloom.operators.filters import rejection_reason
from memloom.operators.ranks import positions
from memloom.plans.filter_queries import CURRENT, memories, messages
from memloom.plans.filter_queries import ORACLE as FILTER_SQL
from memloom.plans.registry import Registry, sql_id, sql_label, sql_normal, sql_trim
from memloom.plans.retrieval_queries import _BM25, _documents, _questions
from memloom.sources.tables import table
from memloom.staging import stage

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

_KEY, _TYPE, _TOPIC, _STATUS = (sql_label(c) for c in ("event_key", "personal_memory_type", "topic_key", "temporal_status"))


@R.query(f"""with g as (select scope_key, {_KEY} k, {_TYPE} t from memories where state in ('candidate','confirmed') and tags is not null and list_contains(tags, 'personal-memory'))
select scope_key, case when bool_or(t <> 'episode') then 'indeterminate' when bool_or(k = '') then 'indeterminate' else 'exact' end as status,
 case when bool_or(t <> 'episode') or bool_or(k = '') then null else count(distinct k) end as value, count(*) as observed, count(distinct nullif(k, '')) as keys,
 case when bool_or(t <> 'episode') then 'not only episodes' when bool_or(k = '') then 'a key is missing' else 'complete' end as reason from g group by scope_key""")
def a02_exact_count(spark: SparkSession, d: str) -> DataFrame:
    """A count that is exact, or says why it isn't."""
    rows = memories(spark, d).where("state in ('candidate', 'confirmed') and array_contains(tags, 'personal-memory')").select("scope_key", values.label("event_key").alias("k"), values.label("personal_memory_type").alias("t"))
    other, blank = F.bool_or(F.col("t") != "episode"), F.bool_or(F.col("k") == "")
    return rows.groupBy("scope_key").agg(
        F.when(other | blank, "indeterminate").otherwise("exact").alias("status"),
        F.when(~other & ~blank, F.count_distinct("k")).alias("value"),
        F.count("*").alias("observed"),
        F.count_distinct(F.nullif("k", F.lit(""))).alias("keys"),
        F.when(other, "not only episodes").when(blank, "a key is missing").otherwise("complete").alias("reason"),
    )


@R.query(f"""with k as (select scope_key, {_TYPE} t, {_KEY} k from memories where {_TYPE} = 'episode' and state in ('candidate','confirmed'))
select scope_key, count(*) as observed, count(distinct nullif(k, '')) as value, bool_and(k <> '') as exact from k group by scope_key""")
def a02_episode_count(spark: SparkSession, d: str) -> DataFrame:
    rows = memories(spark, d).where((values.label("personal_memory_type") == "episode") & F.col("state").isin("candidate", "confirmed")).select("scope_key", values.label("event_key").alias("k"))
    return rows.groupBy("scope_key").agg(F.count("*").alias("observed"), F.count_distinct(F.nullif("k", F.lit(""))).alias("value"), F.bool_and(F.col("k") != "").alias("exact"))


_NORMAL = sql_normal("content")


@R.query(f"""with g as ({FILTER_SQL['f08_structural_gate']})
select m.scope_key, {sql_label('m.subject_id')} as subject_id, {sql_label('m.topic_key')} as topic, count(distinct {_NORMAL.replace('content', 'm.content')}) as contents
from memories m join g using (memory_id) where g.reason = '' and {sql_label('m.topic_key')} <> '' group by 1, 2, 3, {sql_label('m.personal_memory_type')} having count(distinct {_NORMAL.replace('content', 'm.content')}) > 1""")
def a03_ambiguity(spark: SparkSession, d: str) -> DataFrame:
    rows = memories(spark, d).where(rejection_reason(CURRENT) == "").select("scope_key", values.label("subject_id").alias("subject_id"), values.label("topic_key").alias("topic"), values.label("personal_memory_type").alias("type"), values.normal_text("content").alias("n"))
    return rows.where("topic != ''").groupBy("scope_key", "subject_id", "topic", "type").agg(F.count_distinct("n").alias("contents")).where("contents > 1").drop("type")


_SLOTS = f"""r as (select memory_id, scope_key, actor, authority, kind, {sql_label('subject')} su, {sql_label('subject_id')} si, {_TYPE} ty, {_TOPIC} tp, {_KEY} ek, {_STATUS} st, {sql_label('revision_kind')} rv,
 {_NORMAL} nm, trim(content, ' ') ex, coalesce(valid_from, created_at) eff, valid_from vf, valid_to vt from memories where state in ('candidate','confirmed') and kind <> 'memory_conflict')"""
_S = "scope_key, actor, authority, kind, su, si, ty, tp"
_CONSOLIDATED = f"""with {_SLOTS}, k as (select * from r where tp <> ''),
rev as (select *, rank() over (partition by {_S} order by eff desc) rk, count(*) over (partition by {_S}, eff) m, count(*) filter (where st = 'current') over (partition by {_S}) c, count(*) filter (where st = 'planned') over (partition by {_S}) p
 from k where st in ('current','planned') or (st = 'historical' and rv in ('correction','retraction'))),
ret as (select {_S}, memory_id canonical from rev where rk = 1 and m = 1 and st = 'historical' and (c > 0) <> (p > 0)),
retired as (select rev.memory_id, 'correct' operation, ret.canonical from rev join ret using ({_S}) where rev.st <> 'historical' or rev.memory_id = ret.canonical),
lf as (select * from k where memory_id not in (select memory_id from retired)),
mu as (select *, rank() over (partition by {_S}, st order by eff desc) rk, count(*) over (partition by {_S}, st, eff) m, count(*) over (partition by {_S}, st) n, min(nm) over (partition by {_S}, st) lo, max(nm) over (partition by {_S}, st) hi
 from lf where ty in ('fact','state','preference','relationship','plan','commitment') and st in ('current','planned')),
can as (select {_S}, st, memory_id canonical from mu where rk = 1 and m = 1 and rv in ('correction','retraction')),
settled as (select mu.memory_id, case when can.canonical is null then 'conflict' else 'correct' end operation, can.canonical from mu left join can using ({_S}, st) where lo <> hi and n > 1),
used as (select * from retired union all select * from settled),
rest as (select *, case when ty = 'episode' and ek <> '' then concat_ws(chr(1), ek, ex, st, rv, coalesce(epoch_us(vf)::varchar, '-'), coalesce(epoch_us(vt)::varchar, '-')) when ty <> 'episode' then concat_ws(chr(1), nm, st) end sg from r where memory_id not in (select memory_id from used)),
mg as (select memory_id, 'merge' operation, first_value(memory_id) over (partition by {_S}, sg order by eff desc, memory_id desc) canonical, count(*) over (partition by {_S}, sg) n from rest where sg is not null)
"""


@R.query(_CONSOLIDATED + "select memory_id, operation, canonical from used union all select memory_id, operation, canonical from mg where n > 1")
def g01_consolidate(spark: SparkSession, d: str) -> DataFrame:
    return claims.consolidate(memories(spark, d))


@R.query(ORACLE["g01_consolidate"].replace("select memory_id, operation, canonical from used union all select memory_id, operation, canonical from mg where n > 1",
    "select operation, count(*) as sources, count(distinct canonical) as canonicals from (select memory_id, operation, canonical from used union all select memory_id, operation, canonical from mg where n > 1) group by operation"))
def g03_decision_counts(spark: SparkSession, d: str) -> DataFrame:
    decided = claims.consolidate(memories(spark, d))
    return decided.groupBy("operation").agg(F.count("*").alias("sources"), F.count_distinct("canonical").alias("canonicals"))


@R.query(ORACLE["g01_consolidate"].replace("select memory_id, operation, canonical from used union all select memory_id, operation, canonical from mg where n > 1",
    ", a as (select memory_id, canonical from used where canonical is not null union all select memory_id, canonical from mg where n > 1) select a.canonical, max(m.importance) as importance, count(*) as sources, len(list_distinct(flatten(list(m.tags)))) as tags from a join memories m using (memory_id) group by a.canonical"))
def g04_canonical_proposals(spark: SparkSession, d: str) -> DataFrame:
    """What each canonical record takes over from its sources."""
    m = memories(spark, d)
    decided = claims.consolidate(m).where("canonical is not null")
    met = decided.join(m.select("memory_id", "importance", "tags"), "memory_id")
    tags = met.select("canonical", F.explode("tags").alias("tag")).groupBy("canonical").agg(F.count_distinct("tag").alias("tags"))
    return met.groupBy("canonical").agg(F.max("importance").alias("importance"), F.count("*").alias("sources")).join(tags, "canonical", "left").select("canonical", "importance", "sources", F.coalesce("tags", F.lit(0)).alias("tags"))


_EVID = "list_filter(list_distinct(list_append(list_transform(coalesce(evidence, []), lambda e: trim(coalesce(e.evidence_id, ''))), coalesce(nullif(source_message_id, ''), nullif(source_event_id, ''), ''))), lambda x: x <> '')"


@R.query(f"""with a as (select memory_id, importance i, authority, len({_EVID}) n, {_TYPE} in ('state','plan','commitment') and valid_to < timestamptz '2026-01-01 00:00:00+00' ended from memories where state in ('candidate','confirmed')),
b as (select *, round(least(0.9, i + 0.1 * (n - 2)), 6) target from a),
c as (select memory_id, case when coalesce(ended, false) then 'archive' when authority in ('human_self','peer_statement') and n >= 3 and i < 0.9 and target > i then 'reinforce' end as operation, target from b)
select memory_id, operation, case when operation = 'reinforce' then target end as target from c where operation is not null""")
def g07_governance(spark: SparkSession, d: str) -> DataFrame:
    return claims.govern(memories(spark, d), times.at("2026-01-01 00:00:00"))


@R.query(f"select memory_id, len({_EVID}) as evidence_count, list_max(list_transform(evidence, lambda e: epoch_us(e.at))) as latest_us from memories")
def a07_evidence(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(claims.evidence_ids(F.col("evidence"), F.coalesce(F.nullif("source_message_id", F.lit("")), F.nullif("source_event_id", F.lit("")))))
    return memories(spark, d).select("memory_id", n.alias("evidence_count"), F.array_max(F.transform("evidence", lambda e: F.unix_micros(e["at"]))).alias("latest_us"))


_STYLE = rf"""t as (select scope_key, {sql_label('actor')} author, {sql_trim('text')} t from messages),
l as (select *, length(regexp_replace(t, '[\s\x{{85}}\p{{Z}}]+', '', 'g')) n from t where t <> ''),
p as (select scope_key, author, count(*) messages, sum(n) characters, round(avg(n), 3) mean_length, median(n) median_length, round(avg((n <= 12)::int), 4) short_ratio,
 round(avg(regexp_matches(t, '[?？]')::int), 4) question_ratio, round(avg(regexp_matches(t, '[!！]')::int), 4) exclamation_ratio, round(avg(regexp_matches(t, '[\x{{1f1e6}}-\x{{1f1ff}}\x{{1f300}}-\x{{1faff}}\x{{2600}}-\x{{27bf}}]')::int), 4) emoji_ratio,
 round(avg(contains(t, chr(10))::int), 4) multiline_ratio, round(avg(regexp_matches(t, '[。！？!?…~～]$')::int), 4) terminal_ratio from l group by scope_key, author having count(*) >= 20)"""


@R.query(f"with {_STYLE} select * from p")
def a05_style_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).withColumn("author", values.label("actor"))
    return style.profile(rows, ["scope_key", "author"], trimmed("text"))


@R.query(f"""with {_STYLE} select a.scope_key, b.author, round(0.15 * round(1 - least(1.0, abs(b.mean_length - a.mean_length) / greatest(8.0, a.mean_length)), 4) + 0.15 * round(1 - least(1.0, abs(b.median_length - a.median_length) / greatest(8.0, a.median_length)), 4)
 + 0.15 * round(1 - abs(b.short_ratio - a.short_ratio), 4) + 0.1 * round(1 - abs(b.question_ratio - a.question_ratio), 4) + 0.1 * round(1 - abs(b.exclamation_ratio - a.exclamation_ratio), 4)
 + 0.1 * round(1 - abs(b.emoji_ratio - a.emoji_ratio), 4) + 0.1 * round(1 - abs(b.multiline_ratio - a.multiline_ratio), 4) + 0.15 * round(1 - abs(b.terminal_ratio - a.terminal_ratio), 4), 6) as likeness
 from p a join p b using (scope_key) where a.author = 'owner' and b.author <> 'owner'""")
def a16_style_quality(spark: SparkSession, d: str) -> DataFrame:
    """How far the others of a scope write like its owner."""
    rows = messages(spark, d).withColumn("author", values.label("actor"))
    p = style.profile(rows, ["scope_key", "author"], trimmed("text"))
    named = lambda prefix: p.select("scope_key", *[F.col(c).alias(prefix + c) for c in p.columns if c != "scope_key"])
    both = named("a_").where("a_author = 'owner'").join(named("b_").where("b_author != 'owner'"), "scope_key")
    return both.select("scope_key", F.col("b_author").alias("author"), style.similarity("a_", "b_").alias("likeness"))


@R.query()
def a06_common_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Greedy over overlapping phrases, so not SQL; its counts are checked by a06_phrase_counts."""
    rows = messages(spark, d).withColumn("author", values.label("actor")).where("text is not null")
    sizes = rows.groupBy("scope_key", "author").agg(F.count("*").alias("messages")).where("messages >= 20")
    return style.common_phrases(style.phrase_counts(rows, ["scope_key", "author"], F.col("text")), sizes, ["scope_key", "author"])


@R.query(rf"""with s as (select scope_key, delivery_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}]+')) w from messages where text is not null),
g as (select distinct scope_key, delivery_id, substr(w, i, n) phrase from s, range(2, 5) r(n), unnest(range(1, greatest(length(w) - n + 2, 1))) u(i))
select scope_key, phrase, count(*) as df from g group by scope_key, phrase having count(*) >= 3""")
def a06_phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).where("text is not null")
    return style.phrase_counts(rows, ["scope_key"], F.col("text")).where("df >= 3")


@R.query("select scope_key, round(least(1.0, sqrt(count(*) / 100.0)), 4) as confidence, case when avg(length(text)) < 20 then 'keep it short' when avg(length(text)) > 80 then 'write at length' else 'medium' end as directive from messages where text is not null group by scope_key")
def c23_style_directives(spark: SparkSession, d: str) -> DataFrame:
    mean = F.avg(F.length("text"))
    return messages(spark, d).where("text is not null").groupBy("scope_key").agg(style.confidence(F.count("*")).alias("confidence"), F.when(mean < 20, "keep it short").when(mean > 80, "write at length").otherwise("medium").alias("directive"))


# Quality metrics -------------------------------------------------------------------------------------------------


#: Judgements apart from the search: how much of an item's rarer words (in a twentieth of the scope's documents, at most) a document has.
_JUDGED = f"""with {_BM25}, qt as (select distinct q.query, q.scope, q.term from q join df using (scope, term) where df.df * 20 <= (select n from st where st.scope = q.scope)), qn as (select query, count(*) m from qt group by query),
held as (select qt.query, po.doc, count(*) h from qt join po using (scope, term) group by qt.query, po.doc), rel as (select query, doc from held join qn using (query) where h * 2 >= m),
top as (select query, doc, rank from bm where rank <= 20), j as (select r.query, r.doc, t.rank from rel r left join top t on t.query = r.query and t.doc = r.doc)"""
_HITS = _JUDGED + ", h as (select t.query, t.doc, t.rank, coalesce(3 * h // m, 0) as grade, t.query % 7 as cat, t.query % 2 as part from top t left join held using (query, doc) left join qn using (query))"


def judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(the best twenty, every document that has any of an item's rarer words: query, doc, h of m) for each item."""
    docs, asked = _documents(spark, d), _questions(spark, d)
    top = lexical.bm25(docs, asked, 20).select("query", "doc", "rank")
    terms = asked.select("query", "scope", values.lexical_tokens("text").alias("t")).select("query", "scope", F.explode(F.array_distinct("t")).alias("term"))
    tokens = docs.select("scope", "doc", values.lexical_tokens("text").alias("t"))
    held = tokens.select("scope", "doc", F.explode(F.array_distinct("t")).alias("term")).join(lexical.small(terms.select("scope", "term").distinct()), ["scope", "term"])
    held = stage(held)
    df = held.groupBy("scope", "term").agg(F.count("*").alias("df"))
    rare = terms.join(df, ["scope", "term"]).join(docs.groupBy("scope").agg(F.count("*").alias("n")), "scope").where("df * 20 <= n").select("query", "scope", "term")
    return top, held.join(rare, ["scope", "term"]).groupBy("query", "doc").agg(F.count("*").alias("h")).join(rare.groupBy("query").agg(F.count("*").alias("m")), "query")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    top, held = judged(spark, d)
    hits = top.join(held, ["query", "doc"], "left").select("query", "doc", "rank", F.coalesce(F.floor(3 * F.col("h") / F.col("m")), F.lit(0)).cast("long").alias("grade"))
    return hits.withColumns({"cat": F.col("query") % 7, "part": F.col("query") % 2})


@R.query(_HITS + " select query, count(*) filter (where grade >= 2 and rank <= 5) / greatest(count(*) filter (where grade >= 2), 1)::double as recall_5, coalesce(1.0 / min(rank) filter (where grade >= 2), 0) as reciprocal_rank from h group by query")
def a10_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    good = F.col("grade") >= 2
    return _hits(spark, d).groupBy("query").agg(
        (F.count_if(good & (F.col("rank") <= 5)) / F.greatest(F.count_if(good), F.lit(1))).alias("recall_5"), F.coalesce(1.0 / F.min(F.when(good, F.col("rank"))), F.lit(0.0)).alias("reciprocal_rank")
    )


@R.query(_HITS + " select grouping_id(cat, part)::bigint as level, cat, part, count(*) as hits, sum(grade)::bigint as grades from h group by grouping sets ((), (cat), (part))")
def a11_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    """Totals, by category and by partition from one pass."""
    return _hits(spark, d).groupingSets([[], ["cat"], ["part"]], "cat", "part").agg(F.grouping_id().alias("level"), F.count("*").alias("hits"), F.sum("grade").alias("grades")).select("level", "cat", "part", "hits", "grades")


@R.query(_HITS + """, i as (select query, grade, row_number() over (partition by query order by grade desc) ir from h),
dc as (select query, sum((power(2, grade) - 1) / log2(rank + 1)) dcg from h where rank <= 5 group by query), id as (select query, sum((power(2, grade) - 1) / log2(ir + 1)) idcg from i where ir <= 5 group by query)
select query, round(dcg / idcg, 6) as ndcg_5 from dc join id using (query) where idcg > 0""")
def a12_ndcg(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d)
    gain = lambda r: F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col(r) + 1))
    dcg = h.where("rank <= 5").groupBy("query").agg(gain("rank").alias("dcg"))
    ideal = h.withColumn("ir", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("grade")))).where("ir <= 5").groupBy("query").agg(gain("ir").alias("idcg"))
    return dcg.join(ideal, "query").where("idcg > 0").select("query", F.round(F.col("dcg") / F.col("idcg"), 6).alias("ndcg_5"))


@R.query("select event_type, quantile_disc(value, 0.95) as nearest_rank, round(quantile_cont(value, 0.95), 6) as linear from events group by event_type")
def a13_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Nearest rank and linear interpolation, from ranks counted in pieces: no group's values are in one place."""
    rows = table(spark, d, "events").where("value is not null").select("event_type", "value", "event_id")
    placed = positions(rows, ["event_type"], ["value", "event_id"], "n")
    sizes = placed.groupBy("event_type").agg(F.count("*").alias("m"))
    at = (F.col("m") - 1) * 0.95 + 1  # between two ranks
    met = placed.join(sizes, "event_type").where((F.col("n") == F.ceil(F.col("m") * 0.95)) | (F.col("n") == F.floor(at)) | (F.col("n") == F.floor(at) + 1))
    value = lambda test: F.max(F.when(test, F.col("value")))
    ends = met.groupBy("event_type", "m").agg(value(F.col("n") == F.ceil(F.col("m") * 0.95)).alias("nearest_rank"), value(F.col("n") == F.floor(at)).alias("a"), value(F.col("n") == F.floor(at) + 1).alias("b"))
    return ends.select("event_type", "nearest_rank", F.round(F.col("a") + (F.coalesce("b", "a") - F.col("a")) * (at - F.floor(at)), 6).alias("linear"))


@R.query(f"with g as ({FILTER_SQL['f08_structural_gate']}) select 'structural_gate' as stage, m.kind as source, case when reason = '' then 'qualified' else reason end as reason, count(*) as n from g join memories m using (memory_id) group by 2, 3")
def a15_trace_counts(spark: SparkSession, d: str) -> DataFrame:
    reason = rejection_reason(CURRENT)
    rows = memories(spark, d).select(F.lit("structural_gate").alias("stage"), F.col("kind").alias("source"), F.when(reason == "", "qualified").otherwise(reason).alias("reason"))
    return rows.groupBy("stage", "source", "reason").agg(F.count("*").alias("n"))


@R.query(f"select scope_key, {_TOPIC} as topic, count(*) as episodes, count(distinct {_KEY}) as keys, count(distinct {_STATUS}) = 1 as consistent from memories where {_TYPE} = 'episode' group by 1, 2")
def a18_event_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = memories(spark, d).where(values.label("personal_memory_type") == "episode").select("scope_key", values.label("topic_key").alias("topic"), values.label("event_key").alias("k"), values.label("temporal_status").alias("s"))
    return rows.groupBy("scope_key", "topic").agg(F.count("*").alias("episodes"), F.count_distinct("k").alias("keys"), (F.count_distinct("s") == 1).alias("consistent"))


@R.query("""select scope_key, count(*) as n from messages where "at" >= timestamptz '2025-06-01 00:00:00+00' and "at" < timestamptz '2025-09-01 00:00:00+00' group by scope_key having count(*) >= 20""")
def a21_window_threshold(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).where((F.col("at") >= times.at("2025-06-01 00:00:00")) & (F.col("at") < times.at("2025-09-01 00:00:00"))).groupBy("scope_key").agg(F.count("*").alias("n")).where("n >= 20")


# Windows and context ---------------------------------------------------------------------------------------------


@R.query(f"""with r as (select scope_key, {_TOPIC} t, memory_id, coalesce(valid_from, created_at) e from memories where {_TOPIC} <> ''),
k as (select *, rank() over (partition by scope_key, t order by e desc) k, count(*) over (partition by scope_key, t, e) n from r)
select scope_key, t as topic, case when n = 1 then memory_id end as strictly_latest, max(memory_id) over (partition by scope_key, t) as latest from k where k = 1 qualify row_number() over (partition by scope_key, t order by memory_id) = 1""")
def w01_w02_latest(spark: SparkSession, d: str) -> DataFrame:
    """The strictly latest row of a topic (null on a tie) and the latest by (time, id), by two aggregations."""
    rows = memories(spark, d).select("scope_key", values.label("topic_key").alias("topic"), "memory_id", F.coalesce("valid_from", "created_at").alias("e")).where("topic != ''")
    by_time = rows.groupBy("scope_key", "topic", "e").agg(F.count("*").alias("n"), F.max("memory_id").alias("id"))
    last = by_time.groupBy("scope_key", "topic").agg(F.max_by(F.struct("n", "id"), "e").alias("l"))
    return last.select("scope_key", "topic", F.when(F.col("l.n") == 1, F.col("l.id")).alias("strictly_latest"), F.col("l.id").alias("latest"))


@R.query(f"""with h as (with {_BM25} select query, doc, rank from bm where rank <= 30), s as (select h.query, d.source, h.doc, h.rank, row_number() over (partition by h.query, d.source order by h.rank) turn from h join documents d on d.doc_id = h.doc)
select query, doc, position from (select *, row_number() over (partition by query order by turn, source) as position from s) where position <= 12""")
def w08_round_robin(spark: SparkSession, d: str) -> DataFrame:
    top = lexical.bm25(_documents(spark, d), _questions(spark, d), 30).select("query", "doc", "rank")
    sourced = top.join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source"), "doc")
    return context.round_robin(sourced, "query", "source", "rank", 12).select("query", "doc", "position")


@R.query(f"""with recursive s as materialized (with {_BM25} select query, rank, octet_length(encode(d.text)) size, doc::varchar id from bm join documents d on d.doc_id = doc where rank <= 30),
f(query, rank, used, ids) as (select distinct query, 0::bigint, 2::bigint, []::varchar[] from s union all
 select f.query, s.rank, case when len(ids) < 20 and used + size + (len(ids) > 0)::int <= 4000 then used + size + (len(ids) > 0)::int else used end, case when len(ids) < 20 and used + size + (len(ids) > 0)::int <= 4000 then list_append(ids, id) else ids end from f join s on s.query = f.query and s.rank = f.rank + 1)
select query, arg_max(ids, rank) as kept from f group by query""")
def w09_ranked_fit(spark: SparkSession, d: str) -> DataFrame:
    """Ranked items packed into 4,000 bytes with skips; a fold over each query's short list."""
    top = lexical.bm25(_documents(spark, d), _questions(spark, d), 30).select("query", "doc", "rank")
    sized = top.join(table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.octet_length("text").cast("long").alias("size")), "doc")
    lists = sized.groupBy("query").agg(F.collect_list(F.struct("rank", "size", F.col("doc").cast("string").alias("id"))).alias("items"))
    return lists.select("query", context.ranked_fit(F.col("items"), 4000, 20).alias("kept"))


# Index upkeep ----------------------------------------------------------------------------------------------------


_FP = "sha256(concat_ws('|', memory_id, coalesce(content, '-'), state))"


@R.query(f"""with r as (select memory_id, state, {_FP} fp, sha256(coalesce(content, '-')) ch from memories), c as (select memory_id, case when version > 2 then 'stale' else {_FP} end fp from memories where importance < 0.8 union all select 'gone-' || memory_id, 'x' from memories where importance > 0.95)
select coalesce(r.memory_id, c.memory_id) as memory_id, case when r.memory_id is null then 'orphan' when r.state not in ('candidate','confirmed') and c.memory_id is not null then 'delete' when r.state not in ('candidate','confirmed') then 'skip'
 when c.memory_id is null then 'insert' when c.fp <> r.fp then 'repair' else 'keep' end as action from r full join c on c.memory_id = r.memory_id""")
def t12_t13_index_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Records against an index catalog with missing, stale and orphaned entries."""
    m = memories(spark, d)
    fp = F.sha2(F.concat_ws("|", "memory_id", F.coalesce("content", F.lit("-")), "state"), 256)
    records = m.select("memory_id", "state", fp.alias("fp"))
    catalog = m.where("importance < 0.8").select("memory_id", F.when(F.col("version") > 2, "stale").otherwise(fp).alias("cfp"))
    catalog = catalog.unionByName(m.where("importance > 0.95").select(F.concat(F.lit("gone-"), "memory_id").alias("memory_id"), F.lit("x").alias("cfp")))
    active = F.col("state").isin("candidate", "confirmed")
    action = (
        F.when(F.col("fp").isNull(), "orphan")
        .when(~active & F.col("cfp").isNotNull(), "delete")
        .when(~active, "skip")
        .when(F.col("cfp").isNull(), "insert")
        .when(F.col("cfp") != F.col("fp"), "repair")
        .otherwise("keep")
    )
    return records.join(catalog, "memory_id", "full").select("memory_id", action.alias("action"))


@R.query(f"""with r as (select memory_id, {_FP} fp, sha256(coalesce(content, '-')) ch, importance i from memories)
select memory_id, case when i < 0.3 then 'skip' when i < 0.6 then 'manifest_only' else 'embed' end as branch from r""")
def t14_incremental_embedding(spark: SparkSession, d: str) -> DataFrame:
    """What each record costs: nothing if its fingerprint is known, a manifest row if its content is, else an embedding."""
    m = memories(spark, d)
    fp = F.sha2(F.concat_ws("|", "memory_id", F.coalesce("content", F.lit("-")), "state"), 256)
    content = F.sha2(F.coalesce("content", F.lit("-")), 256)
    known = m.where("importance < 0.6").select("memory_id", F.when(F.col("importance") < 0.3, fp).otherwise("old").alias("known_fp"), content.alias("known_content"))
    branch = F.when(F.col("known_fp") == fp, "skip").when(F.col("known_content") == content, "manifest_only").otherwise("embed")
    return m.join(known, "memory_id", "left").select("memory_id", branch.alias("branch"))


@R.query(r"""with t as (select delivery_id, text, regexp_extract_all(text, '(?:20\d{2})\s*(?:年|[-/])\s*\d{1,2}\s*(?:月|[-/])\s*\d{1,2}') f from messages where text is not null)
select delivery_id, len(f) as dates from t where len(f) > 0""")
def c09_calendar_dates(spark: SparkSession, d: str) -> DataFrame:
    pattern = r"(?:20\d{2})\s*(?:年|[-/])\s*\d{1,2}\s*(?:月|[-/])\s*\d{1,2}"
    rows = messages(spark, d).where("text is not null").select("delivery_id", F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))).alias("dates"))
    return rows.where("dates > 0")


@R.query("""select memory_id, event_time.precision as "precision", coalesce((epoch_us(event_time."end") - epoch_us(event_time."start")) / 1e6 not between
 case event_time.precision when 'day' then 82799 when 'month' then 28 * 86400 - 3601 when 'year' then 365 * 86400 - 3601 end and case event_time.precision when 'day' then 90000 when 'month' then 31 * 86400 + 3600 when 'year' then 366 * 86400 + 3600 end, false) as mismatch from memories where event_time is not null""")
def c18_precision(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_time")
    return memories(spark, d).where("event_time is not null").select("memory_id", "event_time.precision", times.precision_mismatch(e["start"], e["end"], e["precision"]).alias("mismatch"))


@R.query(f"""with m as (select scope_key, {sql_id('message_id')} id, string_agg(text, chr(10)) t from messages group by 1, 2)
select x.memory_id, coalesce(bool_or(contains(m.t, x.event_time.expression)), false) as quoted from memories x left join m on m.scope_key = x.scope_key and m.id = {sql_id('x.source_message_id')} where x.event_time is not null group by x.memory_id""")
def c17_quoted_expression(spark: SparkSession, d: str) -> DataFrame:
    """Whether an event's time expression stands in the message it was taken from."""
    asked = memories(spark, d).where("event_time is not null").select("memory_id", "scope_key", clean_id("source_message_id").alias("id"), F.col("event_time.expression").alias("x"))
    said = messages(spark, d).select("scope_key", clean_id("message_id").alias("id"), "text")
    met = asked.join(said, ["scope_key", "id"], "left").groupBy("memory_id").agg(F.bool_or(F.coalesce(F.contains("text", F.col("x")), F.lit(False))).alias("quoted"))
    return met


@R.query("select doc_id, round(len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1)::double, 6) as jaccard from (select doc_id, list_distinct(regexp_extract_all(lower(coalesce(text,'')), '[a-z]+')) a, ['the','owner','contact','agent','note'] b from documents)")
def c30_jaccard(spark: SparkSession, d: str) -> DataFrame:
    a = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)))
    b = F.array(*[F.lit(w) for w in ("the", "owner", "contact", "agent", "note")])
    return table(spark, d, "documents").select("doc_id", F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 6).alias("jaccard"))


@R.query("select doc_id, epoch_us(date_trunc('day', created_at)) as day_us, cast(floor(epoch_us(ingested_at) / 1000.0) as bigint) as ingested_ms from documents")
def c29_dates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", micros(F.date_trunc("day", "created_at")).alias("day_us"), F.unix_millis("ingested_at").alias("ingested_ms"))


@R.query("select distinct scope_key from messages union select distinct scope_key from memories")
def u03_scope_union(spark: SparkSession, d: str) -> DataFrame:
    return messages(spark, d).select("scope_key").union(memories(spark, d).select("scope_key")).distinct()


@R.query(f"select scope_key, {sql_id('message_id')} as id from messages where {sql_id('message_id')} is not null except select scope_key, {sql_id('source_message_id')} from memories")
def u04_difference(spark: SparkSession, d: str) -> DataFrame:
    a = messages(spark, d).select("scope_key", clean_id("message_id").alias("id")).where("id is not null").distinct()
    b = memories(spark, d).select("scope_key", clean_id("source_message_id").alias("id")).where("id is not null")
    return a.join(b, ["scope_key", "id"], "left_anti")


@R.query("select memory_id, list_has_all(tags, ['personal-memory']) and len(tags) > 1 as tagged, list_distinct(list_concat(tags, ['personal-memory','reviewed'])) as tags from memories")
def u06_u07_sets(spark: SparkSession, d: str) -> DataFrame:
    more = F.array(F.lit("personal-memory"), F.lit("reviewed"))
    return memories(spark, d).select("memory_id", (values.subset(["personal-memory"], F.col("tags")) & (F.size("tags") > 1)).alias("tagged"), F.array_sort(F.array_distinct(F.concat("tags", more))).alias("tags"))


ORACLE["u06_u07_sets"] = ORACLE["u06_u07_sets"].replace("list_distinct(list_concat", "list_sort(list_distinct(list_concat").replace("'reviewed'])) as tags", "'reviewed']))) as tags")


@R.query("select scope_key, memory_id, row_number() over (partition by scope_key order by created_at desc, memory_id) as position from memories qualify position <= 10")
def l01_recency_topk(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("scope_key").orderBy(F.desc("created_at"), "memory_id")
    return memories(spark, d).select("scope_key", "memory_id", F.row_number().over(order).alias("position")).where("position <= 10")
