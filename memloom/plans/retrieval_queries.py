"""Lexical, vector and graph retrieval, fusion and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions import times, values
from memloom.functions.keys import clean_id, micros
from memloom.operators import graph, lexical, vectors
from memloom.operators.ranks import positions
from memloom.plans.filter_queries import memories, messages
from memloom.plans.registry import Registry, sql_id, sql_label, sql_nfkc, sql_normal
from memloom.sources.tables import table

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle

_LANG = "lower(coalesce(lang, 'none'))"


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.lower(F.coalesce("lang", F.lit("none"))).alias("scope"), F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """A stated query set: the held-out items, each against the texts of its language."""
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query"), "text", F.lower("lang").alias("scope"))


_FOLD = "replace(lower({}), 'ß', 'ss')"
_TOKENS = (
    "list_concat(list_transform(list_filter(regexp_extract_all(regexp_replace({f}, '[一-鿿㐀-䶿]+', ' ', 'g'), '[\\p{{L}}\\p{{M}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: 'w:' || w), "
    "flatten(list_transform(regexp_extract_all({f}, '[一-鿿㐀-䶿]+'), lambda r: list_concat(list_transform(range(1, length(r) + 1), lambda i: 'h:' || substr(r, i, 1)), list_transform(range(1, length(r)), lambda i: 'h:' || substr(r, i, 2))))))"
)
_TOK = lambda c: _TOKENS.format(f=_FOLD.format(sql_nfkc(c)))

_BM25 = f"""docs as materialized (select {_LANG} scope, doc_id doc, {_TOK("coalesce(text,'')")} t from documents),
len as (select scope, doc, len(t) l from docs), st as (select scope, count(*) n, avg(l) a from len group by scope),
q as (select item_id query, lower(lang) scope, unnest(list_distinct({_TOK('text')})) term from eval_items),
terms as (select distinct scope, term from q),
po as materialized (select scope, term, doc, count(*) tf from (select scope, doc, unnest(t) term from docs) semi join terms using (scope, term) group by scope, term, doc),
df as (select scope, term, count(*) df from po group by scope, term),
sc as (select q.query, q.scope, po.doc, sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * po.tf * 2.2 / (po.tf + 1.2 * (0.25 + 0.75 * len.l / st.a))) score
 from q join po using (scope, term) join df using (scope, term) join st using (scope) join len on len.scope = po.scope and len.doc = po.doc group by q.query, q.scope, po.doc),
bm as (select query, scope, doc, score, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from sc)"""


@R.query(f"select doc_id as doc, len({_TOK(chr(99) + 'oalesce(text, chr(32))')}) as tokens, len(list_distinct({_TOK(chr(99) + 'oalesce(text, chr(32))')})) as terms from documents")
def c01_lexical_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _documents(spark, d).select("doc", F.size(values.lexical_tokens("text")).alias("tokens"), F.size(F.array_distinct(values.lexical_tokens("text"))).alias("terms"))


@R.query(f"with {_BM25} select query, scope, doc, round(score, 6) as score, round(score / (1 + score), 6) as similarity, rank from bm where rank <= 10")
def l04_bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(_documents(spark, d), _questions(spark, d), 10)


@R.query(f"""with t as (select {_LANG} scope, unnest(list_distinct({_TOK("coalesce(text,'')")})) term from documents)
select scope, term, count(*) as df from t group by scope, term""")
def a01_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    terms = _documents(spark, d).select("scope", F.explode(F.array_distinct(values.lexical_tokens("text"))).alias("term"))
    return terms.groupBy("scope", "term").agg(F.count("*").alias("df"))


@R.query(f"select memory_id, {sql_normal('content')} as normal from memories where content is not null")
def c03_normal_text(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d).where("content is not null").select("memory_id", values.normal_text("content").alias("normal"))


_ASK = "where did the contact leave the notebook"
_G = r"regexp_replace({}, '[^0-9a-z㐀-鿿]+', '', 'g')"


@R.query(rf"""with d as (select memory_id, {_G.format("lower(coalesce(content,''))")} t, {_G.format(repr(_ASK))} q from memories),
g as (select memory_id, unnest(list_concat(list_transform(range(1, length(t) + 1), lambda i: substr(t, i, 1)), list_transform(range(1, length(t)), lambda i: substr(t, i, 2)))) g from d),
c as (select memory_id, g, count(*) n from g group by memory_id, g),
qg as (select g, count(*) n from (select unnest(list_concat(list_transform(range(1, length(q) + 1), lambda i: substr(q, i, 1)), list_transform(range(1, length(q)), lambda i: substr(q, i, 2)))) g from (select distinct q from d)) group by g),
o as (select c.memory_id, sum(least(c.n, qg.n)) o, sum(case when length(c.g) = 2 then least(c.n, qg.n) else 0 end) o2 from c join qg using (g) group by c.memory_id),
s as (select sum(n) s, sum(case when length(g) = 2 then n end) s2 from qg), z as (select memory_id, sum(n) s from c group by memory_id)
select d.memory_id, round(least(1.0, greatest(o.o / (sqrt(s.s) * sqrt(z.s)), o.o2 / s.s2) + case when contains(d.t, d.q) then 0.25 else 0 end), 6) as score from d join o using (memory_id) join z using (memory_id), s""")
def c05_lexical_score(spark: SparkSession, d: str) -> DataFrame:
    """Character-pair overlap of every memory with a fixed question; the question's counts are literals."""
    import collections
    import re

    q = re.sub(values.GRAM_DROP, "", _ASK)
    counts = collections.Counter([*q, *(q[i : i + 2] for i in range(len(q) - 1))])
    pairs, total = len(q) - 1, sum(counts.values())
    known = F.array(*[F.lit(g) for g in counts])
    text = F.regexp_replace(F.lower(F.coalesce("content", F.lit(""))), values.GRAM_DROP, "")
    rows = memories(spark, d).select("memory_id", F.contains(text, F.lit(q)).alias("whole"), F.concat(values.grams(text, 1), values.grams(text, 2)).alias("grams"))
    # Only what the question has too goes on, without the text.
    met = rows.select("memory_id", "whole", F.size("grams").alias("size"), F.explode(F.filter("grams", lambda g: F.array_contains(known, g))).alias("g"))
    asked = spark.createDataFrame(list(counts.items()), "g string, asked long")
    both = met.groupBy("memory_id", "whole", "size", "g").agg(F.count("*").alias("n")).join(F.broadcast(asked), "g").withColumn("both", F.least("n", "asked"))
    sums = both.groupBy("memory_id", "whole", "size").agg(F.sum("both").alias("o"), F.sum(F.when(F.length("g") == 2, F.col("both")).otherwise(0)).alias("o2"))
    score = F.greatest(F.col("o") / (F.sqrt(F.lit(float(total))) * F.sqrt("size")), F.col("o2") / pairs) + F.when(F.col("whole"), 0.25).otherwise(0.0)
    return sums.select("memory_id", F.round(F.least(F.lit(1.0), score), 6).alias("score"))


@R.query("""with q as (select vec_id query, embedding e from embeddings where vec_id % 50 = 0),
s as (select q.query, v.vec_id, round(list_cosine_similarity(q.e::double[], v.embedding::double[]), 9) similarity from q, embeddings v where v.vec_id <> q.query)
select query, vec_id, round(similarity, 6) as similarity, rank from (select *, row_number() over (partition by query order by similarity desc, vec_id) as rank from s) where rank <= 10""")
def j17_knn(spark: SparkSession, d: str) -> DataFrame:
    """Nearest vectors of every vector whose id is divisible by 50, against all."""
    v = table(spark, d, "embeddings")
    return vectors.search_all(v, v.where("vec_id % 50 = 0"), 10).withColumn("similarity", F.round("similarity", 6))


@R.query("select vec_id, round(list_cosine_similarity(embedding::double[], list_transform(range(64), lambda i: 1.0::double)), 6) as similarity from embeddings")
def c13_cosine(spark: SparkSession, d: str) -> DataFrame:
    ones = F.array_repeat(F.lit(1.0), 64)
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.cosine(F.col("embedding"), ones), 6).alias("similarity"))


#: The hybrid's queries: the documents that have a vector and an id divisible by 50, asked by their text and by their vector.
_ASKED = "(select doc_id item_id, text, lang from documents where doc_id % 50 = 0 and doc_id in (select vec_id from embeddings))"
_FUSED = f"""with {_BM25.replace("from eval_items", "from " + _ASKED).replace("lower(lang) scope, unnest", _LANG + " scope, unnest")}, found as (select query, doc, row_number() over (partition by query order by round(score, 9) desc, doc) as rank from sc where doc <> query),
a as (select query, doc ident, rank from found where rank <= 30),
vs as (select x.vec_id query, v.vec_id ident, round(list_cosine_similarity(x.embedding::double[], v.embedding::double[]), 9) s from embeddings x, embeddings v where x.vec_id % 50 = 0 and v.vec_id <> x.vec_id and x.vec_id in (select item_id from {_ASKED})),
b as (select query, ident, rank from (select query, ident, row_number() over (partition by query order by s desc, ident) as rank from vs) where rank <= 30),
u as (select query, ident, rank, 1.0 w from a union all select query, ident, rank, 0.5 w from b),
f as (select query, ident, round(sum(w / (60 + rank)), 12) score, min(rank) best_rank, count(*) sources from u group by query, ident)
"""


def _ranked_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The thirty best by words and the thirty best by vectors of each of the hybrid's queries, without itself."""
    v = table(spark, d, "embeddings")
    docs = _documents(spark, d)
    asked = docs.where("doc % 50 = 0").join(v.select(F.col("vec_id").alias("doc")), "doc", "left_semi").select(F.col("doc").alias("query"), "scope", "text")
    hits = lexical.bm25(docs, asked, 31).where("doc != query").select("query", F.col("doc").alias("ident"), "rank")
    order = Window.partitionBy("query").orderBy("rank")
    a = hits.withColumn("rank", F.row_number().over(order)).where("rank <= 30")
    near = vectors.search_all(v, v.where("vec_id % 50 = 0").join(asked.select(F.col("query").alias("vec_id")), "vec_id", "left_semi"), 30)
    return a, near.select("query", F.col("vec_id").alias("ident"), "rank")


@R.query(_FUSED + "select query, ident, round(score / (1.5 / 61), 6) as similarity, best_rank, sources, position from (select *, row_number() over (partition by query order by score desc, best_rank, ident) as position from f) where position <= 10")
def a14_rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Words and vectors searched side by side and fused by rank."""
    a, b = _ranked_lists(spark, d)
    return vectors.reciprocal_rank_fusion([(a, 1.0), (b, 0.5)], ["query"]).where("position <= 10").select("query", "ident", "similarity", "best_rank", "sources", "position")


_TWO = f"""with {_BM25}, a as (select query, doc ident, rank from bm where rank <= 30),
b as (select query, ident, row_number() over (partition by query order by l desc, ident) as rank from (select query, ident, l from a join len on len.doc = a.ident))
"""


@R.query(_TWO + """, j as (select a.query, a.ident, a.rank ra, b.rank rb from a join b using (query, ident))
select query, ident, row_number() over (partition by query order by round(1.0 / (60 + ra) + 1.0 / (60 + rb), 12) desc, ra) as position from j""")
def w06_rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two complete orders of the same candidates (best match, most words), weighted alike; ties keep the first order."""
    a = lexical.bm25(_documents(spark, d), _questions(spark, d), 30, length=True).select("query", F.col("doc").alias("ident"), "rank", "len")
    longest = Window.partitionBy("query").orderBy(F.desc("len"), "ident")
    both = a.withColumn("rb", F.row_number().over(longest))
    order = Window.partitionBy("query").orderBy(F.desc(F.round(1 / (60 + F.col("rank")) + 1 / (60 + F.col("rb")), 12)), "rank")
    return both.select("query", "ident", F.row_number().over(order).alias("position"))


@R.query(_TWO + "select query, ident, round(1 - (rank - 1) / greatest(count(*) over (partition by query) - 1, 1)::double, 6) as score from a")
def w12_listwise_score(spark: SparkSession, d: str) -> DataFrame:
    a = lexical.bm25(_documents(spark, d), _questions(spark, d), 30).select("query", F.col("doc").alias("ident"), "rank")
    n = F.count("*").over(Window.partitionBy("query"))
    return a.select("query", "ident", F.round(1 - (F.col("rank") - 1) / F.greatest(n - 1, F.lit(1)), 6).alias("score"))


@R.query()
def w10_mmr(spark: SparkSession, d: str) -> DataFrame:
    """Ten of the thirty best of each question, without much the same twice; greedy, so not SQL."""
    top = lexical.bm25(_documents(spark, d), _questions(spark, d), 30)
    info = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "source", F.array_distinct(values.lexical_tokens(F.coalesce("text", F.lit("")))).alias("tokens"))
    return vectors.diversify(top.join(info, "doc").select("query", "doc", "source", F.col("similarity").alias("score"), "rank", "tokens"), "query", ["rank"], 0.3, 10)


@R.query("select memory_id, max(score) as score, count(*) as sources from (select memory_id, importance as score from memories where kind = 'fact' union all select memory_id, coalesce(confidence, 0) from memories where state = 'confirmed') group by memory_id")
def u01_distinct_union(spark: SparkSession, d: str) -> DataFrame:
    m = memories(spark, d)
    a, b = m.where("kind = 'fact'").select("memory_id", F.col("importance").alias("score")), m.where("state = 'confirmed'").select("memory_id", F.coalesce("confidence", F.lit(0.0)).alias("score"))
    return a.unionByName(b).groupBy("memory_id").agg(F.max("score").alias("score"), F.count("*").alias("sources"))


# Joins -----------------------------------------------------------------------------------------------------------


_EV = "select memory_id, scope_key, actor, unnest(evidence) e from memories where evidence is not null"


@R.query(f"""with m as (select scope_key s, {sql_id('message_id')} id, count(*) copies, min("at") seen from messages group by 1, 2)
select memory_id, x.source_message_id as source, coalesce(m.copies, 0) as copies, m.id is not null as found from memories x left join m on m.s = x.scope_key and m.id = {sql_id('x.source_message_id')}""")
def j03_source_audit(spark: SparkSession, d: str) -> DataFrame:
    """Left join of records to the messages they name."""
    seen = messages(spark, d).select("scope_key", clean_id("message_id").alias("id")).where("id is not null").groupBy("scope_key", "id").agg(F.count("*").alias("copies"))
    joined = memories(spark, d).withColumn("id", clean_id("source_message_id")).join(seen, ["scope_key", "id"], "left")
    return joined.select("memory_id", F.col("source_message_id").alias("source"), F.coalesce("copies", F.lit(0)).alias("copies"), F.col("copies").isNotNull().alias("found"))


@R.query(f"""with e as ({_EV}), m as (select distinct scope_key, {sql_id('message_id')} id from messages)
select memory_id, e.evidence_id as evidence_id, e.message_id as message_id from e join m on m.scope_key = e.scope_key and m.id = {sql_id('e.message_id')}""")
def j05_evidence_messages(spark: SparkSession, d: str) -> DataFrame:
    cited = memories(spark, d).select("memory_id", "scope_key", F.explode("evidence").alias("e")).select("memory_id", "scope_key", "e.evidence_id", "e.message_id", clean_id("e.message_id").alias("id"))
    there = messages(spark, d).select("scope_key", clean_id("message_id").alias("id")).where("id is not null").distinct()
    return cited.join(there, ["scope_key", "id"]).select("memory_id", "evidence_id", "message_id")


def edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders, their parts and customers as typed edges."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    node = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    placed = orders.select(node("po", "o_orderkey").alias("uuid"), node("c", "o_custkey").alias("source"), node("o", "o_orderkey").alias("target"), F.lit("PLACED").alias("name"), F.col("o_orderdate").alias("valid_at"))
    holds = lines.select(F.concat(F.lit("ol"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("uuid"), node("o", "l_orderkey").alias("source"), node("p", "l_partkey").alias("target"), F.lit("CONTAINS").alias("name"), F.col("l_shipdate").alias("valid_at"))
    return placed.unionByName(holds)


_EDGES = """edges as (select 'po' || o_orderkey uuid, 'c' || o_custkey source, 'o' || o_orderkey target, 'PLACED' as name, o_orderdate valid_at from orders
 union all select 'ol' || l_orderkey || '-' || l_linenumber, 'o' || l_orderkey, 'p' || l_partkey, 'CONTAINS', l_shipdate from lineitem)"""


@R.query(f"""with {_EDGES}, n as (select 'c' || c_custkey id from customer where c_mktsegment = 'BUILDING' and c_acctbal > 9000)
select uuid, source, target from edges where name = 'PLACED' and (source in (select id from n) or target in (select id from n)) and valid_at >= timestamp '1996-01-01'""")
def j06_edge_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a type with an anchor at either end, in a time range."""
    named = table(spark, d, "customer").where("c_mktsegment = 'BUILDING' and c_acctbal > 9000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("here"))
    way = graph.half_edges(edges(spark, d).where("name = 'PLACED' and valid_at >= timestamp '1996-01-01'")).join(named, "here", "left_semi")
    return way.select("uuid", F.when(F.col("forward"), F.col("here")).otherwise(F.col("there")).alias("source"), F.when(F.col("forward"), F.col("there")).otherwise(F.col("here")).alias("target")).distinct()


@R.query("""with first as (select 'c' || o_custkey anchor, 'o' || o_orderkey mid, o_orderkey k from orders join customer on c_custkey = o_custkey where o_orderdate <= timestamp '1997-01-01')
select anchor, mid, 'p' || l_partkey as last from first join lineitem on l_orderkey = k where l_shipdate <= timestamp '1997-01-01'""")
def j07_typed_path(spark: SparkSession, d: str) -> DataFrame:
    anchors = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("anchor"))
    paths = graph.typed_paths(edges(spark, d), anchors, [("PLACED", True), ("CONTAINS", True)], "1997-01-01 00:00:00")
    return paths.select("anchor", F.col("nodes")[1].alias("mid"), F.col("nodes")[2].alias("last"))


_EXPLORED = f"""{_EDGES}, half as (select source h, target t, uuid from edges union all select target, source, uuid from edges),
anchors as (select 'c' || c_custkey anchor from customer),
one as (select anchor, t mid, uuid as first from anchors join half on h = anchor),
pa as (select anchor, 1 hops, [anchor, mid] nodes, [first] edges from one
 union all select anchor, 2, [anchor, mid, t], [first, uuid] from one join half on h = mid where t <> anchor and uuid <> first),
ex as (select *, row_number() over (partition by anchor order by hops, edges, nodes) as position from pa)"""


def _explored(spark: SparkSession, d: str) -> DataFrame:
    anchors = table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("anchor"))
    return graph.explore(edges(spark, d), anchors, ["PLACED", "CONTAINS"])


@R.query(f"with {_EXPLORED} select anchor, hops, nodes, position from ex where position <= 256")
def j08_explore(spark: SparkSession, d: str) -> DataFrame:
    return _explored(spark, d).select("anchor", "hops", "nodes", "position")


@R.query(f"""with {_EXPLORED}, k as (select * from ex where position <= 256)
select k.anchor, k.position, exists (select 1 from k o where o.anchor = k.anchor and o.hops = 2 and k.hops = 1 and o.edges[1] = k.edges[1]) as extended from k""")
def w11_prefix_demotion(spark: SparkSession, d: str) -> DataFrame:
    return graph.demote_prefixes(_explored(spark, d)).select("anchor", "position", "extended")


@R.query(f"""with e as ({_EV}), x as (select e.memory_id, e.scope_key, e.actor, {sql_id('e.e.event_id')} id from e)
select x.memory_id, s.memory_id as source_id from x join memories s on s.scope_key = x.scope_key and {sql_id('s.source_event_id')} = x.id and s.actor = x.actor and s.kind = 'event'""")
def j09_original_sources(spark: SparkSession, d: str) -> DataFrame:
    """Claims joined back to the stored events they cite, said by the same actor."""
    cited = memories(spark, d).select("memory_id", "scope_key", "actor", F.explode("evidence").alias("e")).select("memory_id", "scope_key", "actor", clean_id("e.event_id").alias("id"))
    events = memories(spark, d).where("kind = 'event'").select("scope_key", "actor", clean_id("source_event_id").alias("id"), F.col("memory_id").alias("source_id")).where("id is not null")
    return cited.join(events, ["scope_key", "actor", "id"]).select("memory_id", "source_id")


@R.query(f"""with a as (select scope_key, {sql_label('topic_key')} t, memory_id from memories where state in ('candidate','confirmed') and kind <> 'memory_conflict'),
c as (select memory_id, scope_key, {sql_label('topic_key')} t from memories where kind = 'memory_conflict' and state in ('candidate','confirmed'))
select c.memory_id, count(a.memory_id) as live from c join a on a.scope_key = c.scope_key and a.t = c.t where c.t <> '' group by c.memory_id having count(a.memory_id) >= 2""")
def j10_conflict_sources(spark: SparkSession, d: str) -> DataFrame:
    """Open conflicts whose topic still has at least two live records; counted before the join, so no topic is multiplied out."""
    active = memories(spark, d).where("state in ('candidate', 'confirmed')").withColumn("t", values.label("topic_key"))
    live = active.where("kind <> 'memory_conflict'").groupBy("scope_key", "t").agg(F.count("*").alias("live")).where("live >= 2")
    return active.where("kind = 'memory_conflict' and t <> ''").join(live, ["scope_key", "t"]).select("memory_id", "live")


@R.query("select claim_id from claims where (valid_from is null or valid_from <= timestamptz '2025-06-01 00:00:00+00') and (valid_to is null or valid_to >= timestamptz '2025-06-01 00:00:00+00')")
def j11_as_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").where(times.valid_at(times.at("2025-06-01 00:00:00"), F.col("valid_from"), F.col("valid_to"))).select("claim_id")


@R.query("select claim_id from claims where (valid_from is null or valid_from <= timestamptz '2025-06-30 00:00:00+00') and (valid_to is null or valid_to >= timestamptz '2025-06-01 00:00:00+00')")
def j12_interval_overlap(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "claims").where(times.overlaps(F.col("valid_from"), F.col("valid_to"), times.at("2025-06-01 00:00:00"), times.at("2025-06-30 00:00:00"))).select("claim_id")


_POS = f"""pos as (select scope_key, {sql_id('thread_id')} s, delivery_id, row_number() over (partition by scope_key, {sql_id('thread_id')} order by "at", delivery_id) o from messages where {sql_id('thread_id')} is not null)"""


def _positions(spark: SparkSession, d: str) -> DataFrame:
    rows = messages(spark, d).select("scope_key", clean_id("thread_id").alias("s"), "at", "delivery_id").where("s is not null")
    return positions(rows, ["scope_key", "s"], ["at", "delivery_id"], "o").drop("at")


@R.query(f"""with {_POS} select a.delivery_id, b.delivery_id as neighbor, b.o - a.o as "offset" from pos a join pos b on b.scope_key = a.scope_key and b.s = a.s and abs(b.o - a.o) between 1 and 2 where a.delivery_id % 50 = 0""")
def j13_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours within two places in the same session of every row whose id is divisible by 50.

    Each anchor asks for its five exact places, so the band join is an equi-join on (session, ordinal).
    """
    pos = _positions(spark, d)
    places = F.array(*[F.lit(k) for k in (-2, -1, 1, 2)])
    asked = pos.where("delivery_id % 50 = 0").select("scope_key", "s", "delivery_id", F.col("o").alias("own"), F.explode(places).alias("offset")).withColumn("o", F.col("own") + F.col("offset"))
    return asked.join(pos.withColumnRenamed("delivery_id", "neighbor"), ["scope_key", "s", "o"]).select("delivery_id", "neighbor", "offset")


@R.query(f"""with {_POS}, w as (select a.delivery_id anchor, b.delivery_id, abs(b.o - a.o) dist, b.o from pos a join pos b on b.scope_key = a.scope_key and b.s = a.s and abs(b.o - a.o) <= 2 where a.delivery_id % 50 = 0),
f as (select delivery_id, arg_min(anchor, (dist, anchor)) anchor, min(dist) dist from w group by delivery_id)
select anchor, delivery_id, dist from f""")
def j14_source_window(spark: SparkSession, d: str) -> DataFrame:
    """Anchors with their neighbours, each row once, under the nearest anchor."""
    pos = _positions(spark, d)
    places = F.array(*[F.lit(k) for k in (-2, -1, 0, 1, 2)])
    asked = pos.where("delivery_id % 50 = 0").select("scope_key", "s", F.col("delivery_id").alias("anchor"), F.col("o").alias("own"), F.explode(places).alias("offset")).withColumn("o", F.col("own") + F.col("offset"))
    met = asked.join(pos, ["scope_key", "s", "o"]).withColumn("dist", F.abs("offset"))
    return met.groupBy("delivery_id").agg(F.min_by("anchor", F.struct("dist", "anchor")).alias("anchor"), F.min("dist").alias("dist")).select("anchor", "delivery_id", F.col("dist").cast("long"))


@R.query(f"""select m.memory_id from memories m where kind = 'event' and not exists (select 1 from messages s where s.scope_key = m.scope_key and {sql_id('s.message_id')} = {sql_id('m.source_message_id')})""")
def j15_anti_join(spark: SparkSession, d: str) -> DataFrame:
    there = messages(spark, d).select("scope_key", clean_id("message_id").alias("id")).where("id is not null").distinct()
    return memories(spark, d).where("kind = 'event'").withColumn("id", clean_id("source_message_id")).join(there, ["scope_key", "id"], "left_anti").select("memory_id")


@R.query(f"""with e as ({_EV}), m as (select scope_key, {sql_id('message_id')} id, min("at") seen from messages where {sql_id('message_id')} is not null group by 1, 2)
select memory_id, e.evidence_id as evidence_id, case when m.id is null then 'unknown' when m.seen <> e.at then 'other_time' else 'bound' end as verdict from e left join m on m.scope_key = e.scope_key and m.id = {sql_id('e.message_id')}""")
def j18_evidence_binding(spark: SparkSession, d: str) -> DataFrame:
    cited = memories(spark, d).select("memory_id", "scope_key", F.explode("evidence").alias("e")).select("memory_id", "scope_key", "e.evidence_id", F.col("e.at").alias("cited_at"), clean_id("e.message_id").alias("id"))
    seen = messages(spark, d).select("scope_key", clean_id("message_id").alias("id"), "at").where("id is not null").groupBy("scope_key", "id").agg(F.min("at").alias("seen"), F.count("*").alias("n"))
    verdict = F.when(F.col("n").isNull(), "unknown").when(F.col("seen") != F.col("cited_at"), "other_time").otherwise("bound")
    return cited.join(seen, ["scope_key", "id"], "left").select("memory_id", "evidence_id", verdict.alias("verdict"))


@R.query("select coalesce(a.memory_id, b.memory_id) as memory_id, a.memory_id is not null as stored, b.memory_id is not null as logged from (select memory_id from memories) a full join (select distinct memory_id from memory_log where memory_id is not null) b on b.memory_id = a.memory_id")
def j16_full_outer(spark: SparkSession, d: str) -> DataFrame:
    a = memories(spark, d).select("memory_id", F.lit(True).alias("stored"))
    b = table(spark, d, "memory_log").where("memory_id is not null").select("memory_id").distinct().withColumn("logged", F.lit(True))
    return a.join(b, "memory_id", "full").select("memory_id", F.coalesce("stored", F.lit(False)).alias("stored"), F.coalesce("logged", F.lit(False)).alias("logged"))
