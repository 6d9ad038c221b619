"""Queries of problems 1, 2, 6, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import conversations, leakage, packing, pii, spans, truncation
from memloom.sources.tables import small_table, table


def _configs(spark: SparkSession, sf_dir: str) -> list[tuple[int, int, int]]:
    return [(r.config_id, r.max_chars, r.overlap_chars) for r in small_table(spark, sf_dir, "span_configs", 1000)]


def _budgets(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    return [(r.budget_id, r.capacity_tokens) for r in small_table(spark, sf_dir, "pack_budgets", 1000)]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.dropped(table(spark, sf_dir, "messages"))


def p1_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.rebuild(table(spark, sf_dir, "messages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = spans.split_oversized(table(spark, sf_dir, "memories"), "content", _configs(spark, sf_dir), ["memory_id"])
    return cut.where(F.size("pieces") > 1).select("config_id", "memory_id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = spans.split_oversized(table(spark, sf_dir, "memories"), "content", _configs(spark, sf_dir), ["memory_id"])
    return cut.select("config_id", "memory_id", F.posexplode("pieces").alias("piece", "x")).select("config_id", "memory_id", "piece", F.col("x.start").alias("start_pos"), F.col("x.end").alias("end_pos"), "x.text")


def p2_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each split text: whether its pieces cover it in order, keep within the limit, share the overlap and are what stands there."""
    configs = _configs(spark, sf_dir)
    memories = table(spark, sf_dir, "memories").select("memory_id", "content")
    cut = spans.split_oversized(memories, "content", configs, ["memory_id", "content"])
    limits = F.create_map(*[F.lit(x) for c, m, _ in configs for x in (c, m)])[F.col("config_id")]
    overlaps = F.create_map(*[F.lit(x) for c, _, o in configs for x in (c, o)])[F.col("config_id")]
    follows = F.zip_with(F.slice("pieces", F.lit(2), F.size("pieces")), F.slice("pieces", F.lit(1), F.size("pieces") - 1), lambda x, before: F.greatest(F.lit(0), before.end - overlaps) == x.start)
    return cut.select(
        "config_id",
        "memory_id",
        ((F.get("pieces", F.lit(0)).start == 0) & (F.element_at("pieces", -1).end == F.length("content"))).alias("covers"),
        F.forall("pieces", lambda x: (x.end - x.start).between(1, limits)).alias("within"),
        F.forall(follows, lambda x: x).alias("overlaps"),
        F.forall("pieces", lambda x: F.substring(F.col("content"), x.start + 1, x.end - x.start) == x.text).alias("same_text"),
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = table(spark, sf_dir, "messages").select(F.col("delivery_id").cast("string").alias("row_key"), "text")
    memories = table(spark, sf_dir, "memories").select(F.col("memory_id").alias("row_key"), F.col("content").alias("text"))
    parts = [pii.find(t, "row_key", "text").withColumn("source_table", F.lit(name)) for t, name in ((messages, "messages"), (memories, "memories"))]
    return parts[0].unionByName(parts[1]).select("source_table", "row_key", "pii_type", "start_pos")


def p6_redacted_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "messages").select("delivery_id", pii.redacted(F.col("text")).alias("text"))


def p6_redacted_memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "memories").select("memory_id", pii.redacted(F.col("content")).alias("content"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), "text", _budgets(spark, sf_dir))
    return packed.where("oversized and from_byte = 0").select("budget_id", "doc_id")


def p7_utilization(spark: SparkSession, sf_dir: str) -> DataFrame:
    budgets = _budgets(spark, sf_dir)
    return packing.utilization(packing.pack(table(spark, sf_dir, "documents"), "text", budgets), budgets)


def p7_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each budget: the bytes in containers, whether all parts of all texts are there once and in order, and whether no container overflows."""
    budgets = _budgets(spark, sf_dir)
    packed = packing.pack(table(spark, sf_dir, "documents"), "text", budgets)
    capacity = F.create_map(*[F.lit(x) for pair in budgets for x in pair])[F.col("budget_id")]
    full = packed.groupBy("budget_id", "lot", "container").agg(F.sum("bytes").alias("b"), F.count("*").alias("n"), F.max("oversized").alias("cut"))
    fits = full.groupBy("budget_id").agg(F.sum("b").alias("bytes"), F.max(F.col("b") - capacity).alias("over"))
    sizes = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    texts = packed.groupBy("budget_id", "doc_id").agg(F.sum("bytes").alias("b"), F.max(F.col("from_byte") + F.col("bytes")).alias("last"), F.count_distinct("from_byte").alias("starts"), F.count("*").alias("n"))
    whole = texts.join(sizes, "doc_id").groupBy("budget_id").agg(F.bool_and((F.col("b") == F.col("size")) & (F.col("last") == F.col("size")) & (F.col("starts") == F.col("n"))).alias("whole"), F.count("*").alias("texts"))
    return fits.join(whole, "budget_id").select("budget_id", "bytes", "texts", "whole", (F.col("over") <= 0).alias("fits"))


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which items leaked, into how many documents, and the largest part of each that one document holds."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("held").alias("largest_part"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.inspect(table(spark, sf_dir, "documents"), declared="declared_chars").where("truncated").select("doc_id")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.shares(table(spark, sf_dir, "documents"), declared="declared_chars")


QUERIES = {f.__name__: f for f in (p1_found, p1_conversations, p2_found, p2_pieces, p2_checked, p6_found, p6_redacted_messages, p6_redacted_memories, p7_found, p7_utilization, p7_checked, p8_found, p8_leaked_items, p9_found, p9_shares)}

#: Fixed value: white space at either end, in RE2's notation.
_EDGE = r"^[\s\x{85}\p{Z}]+|[\s\x{85}\p{Z}]+$"
_id = lambda c: f"nullif(regexp_replace({c}, '{_EDGE}', '', 'g'), '')"
_VISIBLE = r"[^\s\p{C}\p{Z}\x{34f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{2800}\x{3164}\x{fe00}-\x{fe0f}\x{ffa0}\x{e0100}-\x{e01ef}]"

_P1 = f"""
with recursive ids as materialized (
  select coalesce(scope_key, chr(1)) s, {_id("message_id")} m, {_id("event_id")} e, {_id("thread_id")} thread, {_id("reply_to_id")} reply, {_id("thread_root_id")} root,
         lower({_id("actor")}) a, "at", row_number() over (order by received_at nulls last, delivery_id) rk, delivery_id,
         coalesce(regexp_matches(text, '{_VISIBLE}'), false) or len(list_filter(coalesce(parts, []), lambda p: coalesce(regexp_matches(p.text, '{_VISIBLE}'), false))) > 0 shows
  from messages),
pairs as materialized (select s, m, e, min(rk) p from ids where m is not null or e is not null group by s, m, e),
links as (
  select p, min(p) over (partition by s, m) q from pairs where m is not null
  union select p, min(p) over (partition by s, e) from pairs where e is not null),
edges as materialized (select p, q from links where p <> q union select q, p from links where p <> q),
reach(p, q) as (select distinct p, p from edges union select r.p, x.q from reach r join edges x on x.p = r.q),
least_of as (select p, min(q) q from reach group by p),
grouped as materialized (select i.*, coalesce(l.q, pairs.p, i.rk) g from ids i left join pairs on pairs.s = i.s and pairs.m is not distinct from i.m and pairs.e is not distinct from i.e and (i.m is not null or i.e is not null) left join least_of l on l.p = pairs.p),
turns as materialized (select g, any_value(s) s, max(thread) thread, max(reply) reply, max(root) root, min("at") "at", min(rk) first, bool_or(shows) shows, bool_or(m is not null) named,
  max(case a when 'human_self' then 'owner' when 'peer' then 'contact' when 'internal' then 'system' else a end) role from grouped group by g),
keys as (select g.g, max(i.delivery_id) filter (where i.rk = g.g) k from turns g join ids i on i.rk = g.g group by g.g),
names as materialized (select distinct t.s, case when t.named then x.m else x.e end nm, t.g, k.k from turns t join grouped x using (g) join keys k using (g) where case when t.named then x.m else x.e end is not null),
tg as materialized (select t.g, arg_min(n.g, n.k) target from turns t join names n on n.s = t.s and n.nm = t.reply group by t.g),
rt as materialized (select n.g, min(t.thread) th from turns t join names n on n.s = t.s and n.nm = t.root where t.thread is not null group by n.g),
nodes as materialized (select t.g, t.thread, tg.target, rt.th root_thread, coalesce(t.thread, case when tg.target is null then rt.th end) eff from turns t left join tg using (g) left join rt using (g)),
walk(g0, cur, depth) as (select g, g, 0 from nodes where thread is null union all select w.g0, n.target, depth + 1 from walk w join nodes n on n.g = w.cur where n.eff is null and n.target is not null and depth < 60),
found as (select w.g0 g, coalesce(arg_min(n.eff, depth) filter (where n.eff is not null), arg_min(n.root_thread, depth) filter (where n.root_thread is not null)) th from walk w join nodes n on n.g = w.cur group by w.g0),
placed as materialized (select t.g, t.s, coalesce(t.thread, f.th) thread, t.reply, n.target, t.shows, coalesce(t.role, 'system') role from turns t join nodes n using (g) left join found f using (g)),
inner_links as materialized (select a.g, a.s, a.thread, case when b.thread = a.thread then b.g end nxt, a.reply from placed a left join placed b on b.g = a.target where a.thread is not null),
chain(g0, cur) as (select g, g from inner_links where nxt is not null union select c.g0, l.nxt from chain c join inner_links l on l.g = c.cur where l.nxt is not null),
endless as (select c.g0 g from chain c join inner_links l on l.g = c.cur group by c.g0 having bool_and(l.nxt is not null)),
conv as (select l.s, l.thread, bool_or(l.reply is not null and l.nxt is null) dangling, bool_or(e.g is not null) circling, count(distinct p.role) filter (where p.shows and p.role <> 'system') roles
  from inner_links l join placed p using (g) left join endless e on e.g = l.g group by l.s, l.thread)
select nullif(s, chr(1)) as scope_key, thread as thread_id from conv where dangling or circling or roles < 2"""

ORACLE = {
    "p2_found": "select config_id, memory_id from memories, span_configs where length(content) > max_chars",
    "p7_found": "select budget_id, doc_id from documents, pack_budgets where octet_length(encode(text)) > capacity_tokens",
    "p1_found": _P1,
    "p2_checked": "select config_id, memory_id, true as covers, true as within, true as overlaps, true as same_text from memories, span_configs where length(content) > max_chars",
    "p7_checked": "select budget_id, sum(octet_length(encode(text)))::bigint as bytes, count(*) as texts, true as whole, true as fits from documents, pack_budgets where octet_length(encode(text)) > 0 group by budget_id",
}
