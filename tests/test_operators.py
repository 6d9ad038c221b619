import math
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from memloom.functions import times, values
from memloom.operators import claims, context, graph, lexical, store, style, vectors
from memloom.operators.filters import Plan, RecordFilter, rejection_reason
from memloom.streaming import ingest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens(spark):
    assert one(spark, values.lexical_tokens(F.lit("foo_bar, 2026"))) == ["w:foo", "w:bar", "w:2026"]
    assert one(spark, values.lexical_tokens(F.lit("上海 Beijing"))) == ["w:beijing", "h:上", "h:海", "h:上海"]
    assert one(spark, values.lexical_tokens(F.lit(""))) == []


def test_tokens_and_texts_in_compatible_forms(spark):
    assert one(spark, values.lexical_tokens(F.lit("ＦＯＯ_bar, 2026"))) == ["w:foo", "w:bar", "w:2026"]
    assert one(spark, values.lexical_tokens(F.lit("Straße ﬁn"))) == ["w:strasse", "w:fin"]
    assert one(spark, values.normal_text(F.lit(" Ｈｅｌｌｏ， World… "))) == "helloworld"
    assert one(spark, values.nfkc(F.lit("ｶﾞ①"))) == "ガ1" and one(spark, values.nfkc(F.lit(None).cast("string"))) is None


def test_bm25_closed_form_and_scope(spark):
    docs = [("a", 1, "red red blue"), ("a", 2, "blue green")] + [("b", i, "red x") for i in range(10, 20)]
    hits = lexical.bm25(spark.createDataFrame(docs, "scope string, doc long, text string"), spark.createDataFrame([(7, "a", "RED")], "query long, scope string, text string"), 5).collect()
    score = math.log1p(1.5 / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2.5))
    assert [(h.doc, h.rank) for h in hits] == [(1, 1)]
    assert hits[0].score == pytest.approx(score, abs=1e-6) and hits[0].similarity == pytest.approx(score / (1 + score), abs=1e-6)


def test_roles_and_statuses(spark):
    assert [one(spark, values.role(F.lit(x))) for x in (" Peer", "HUMAN_SELF", "internal", "", "bot", None)] == ["contact", "owner", "system", "system", "bot", "system"]
    assert [one(spark, values.temporal_status(F.lit(x))) for x in ("Past", "future", "", "odd")] == ["historical", "planned", "unknown", "odd"]


def test_grams(spark):
    assert one(spark, values.grams(F.lit("ab-c"), 2)) == ["ab", "bc"]
    assert one(spark, values.grams(F.lit("a"), 2)) == [] and one(spark, values.grams(F.lit(""), 1)) == []


def test_calendar(spark):
    at = lambda t, zone="UTC": one(spark, times.calendar_expression(F.lit(t), 2026, zone))
    assert at("on 2025-3-4 we met").start == datetime(2025, 3, 4, 12)
    assert at("2025年2月").end == datetime(2025, 2, 28, 23, 59, 59)
    assert at("3月5日").start == datetime(2026, 3, 5, 12)
    assert at("2024年").start == datetime(2024, 1, 1) and at("2024年", "+08:00").start == datetime(2023, 12, 31, 16)
    assert at("2025-01-01 or 2025-01-02") is None and at("2025-13-40") is None and at("none") is None


def test_filter_semantics(spark):
    rows = spark.createDataFrame([("1", "fact", "owner", "human_self", "confirmed", ["a"], 0.5), ("2", "fact", "agent", "agent_output", "expired", [], 0.9)], "memory_id string, kind string, actor string, authority string, state string, tags array<string>, importance double")
    keep = lambda f: [r.memory_id for r in rows.where(f.column()).collect()]
    assert keep(RecordFilter()) == ["1"] and keep(RecordFilter(include_inactive=True)) == ["1", "2"]
    assert keep(RecordFilter(kinds=())) == [] and keep(RecordFilter(tags=("a",))) == ["1"] and keep(RecordFilter(include_inactive=True, min_importance=0.6)) == ["2"]


MEMORY = "memory_id string, scope_key string, kind string, actor string, authority string, state string, content string, subject string, subject_id string, personal_memory_type string, topic_key string, event_key string, temporal_status string, revision_kind string, valid_from timestamp, valid_to timestamp, created_at timestamp, importance double, event_time struct<start:timestamp,end:timestamp>"


def memory(i, **k):
    base = dict(memory_id=i, scope_key="s", kind="fact", actor="owner", authority="human_self", state="confirmed", content="x", subject="owner", subject_id="u", personal_memory_type="state", topic_key="home", event_key="", temporal_status="current", revision_kind="assertion", valid_from=None, valid_to=None, created_at=datetime(2025, 1, 1), importance=0.5, event_time=None)
    return tuple({**base, **k}.values())


def test_gate_reasons(spark):
    now = datetime(2026, 1, 1)
    rows = [memory("ok"), memory("agent", authority="agent_output"), memory("late", created_at=datetime(2026, 1, 2)), memory("ended", valid_to=datetime(2025, 6, 1)), memory("old", state="superseded"), memory("edge", created_at=now)]
    found = {r.memory_id: r.reason for r in spark.createDataFrame(rows, MEMORY).select("memory_id", rejection_reason(Plan()).alias("reason")).collect()}
    assert found == {"ok": "", "agent": "ineligible_authority_or_lifecycle", "late": "not_yet_observed", "ended": "no_longer_valid", "old": "ineligible_authority_or_lifecycle", "edge": ""}


def test_as_of_reads_superseded_inside_its_interval(spark):
    row = spark.createDataFrame([memory("m", state="superseded", valid_from=datetime(2024, 1, 1), valid_to=datetime(2025, 12, 31))], MEMORY)
    ask = lambda t: row.where(rejection_reason(Plan(view="as_of", as_of=t, now="2027-01-01 00:00:00")) == "").count()
    assert ask("2025-06-01 00:00:00") == 1 and ask("2026-06-01 00:00:00") == 0


def test_consolidation(spark):
    rows = [
        memory("a1", content="Lives in A."), memory("a2", content="lives in a", created_at=datetime(2025, 2, 1)),  # merge
        memory("b1", topic_key="job", content="cook"), memory("b2", topic_key="job", content="nurse", created_at=datetime(2025, 2, 1)),  # conflict
        memory("c1", topic_key="car", content="red"), memory("c2", topic_key="car", content="blue", revision_kind="correction", created_at=datetime(2025, 2, 1)),  # correction
        memory("d1", topic_key="pet", content="cat"), memory("d2", topic_key="pet", content="had a cat", temporal_status="historical", revision_kind="retraction", created_at=datetime(2025, 2, 1)),
        memory("e1", topic_key="", content="same"), memory("e2", topic_key="", content="same", scope_key="t"),
    ]
    found = {(r.memory_id, r.operation, r.canonical) for r in claims.consolidate(spark.createDataFrame(rows, MEMORY)).collect()}
    assert found == {("a1", "merge", "a2"), ("a2", "merge", "a2"), ("b1", "conflict", None), ("b2", "conflict", None), ("c1", "correct", "c2"), ("c2", "correct", "c2"), ("d1", "correct", "d2"), ("d2", "correct", "d2")}


def test_put_page_cursor(spark):
    schema = "memory_id string, scope_key string, idempotency_key string, created_at timestamp"
    day = lambda n: datetime(2025, 1, n)
    stored = spark.createDataFrame([("a", "s", "k", day(1)), ("x", "s", "", day(1))], schema)
    batch = spark.createDataFrame([("b", "s", " k", day(2)), ("c", "s", "n", day(3)), ("d", "s", "n", day(2)), ("e", "t", "k", day(2)), ("x", "s", "q", day(5)), ("f", "s", "", day(1))], schema)
    got = {r.memory_id: (r.status, r.existing) for r in store.put(batch, stored).collect()}
    assert got == {"b": ("duplicate", "a"), "c": ("duplicate", "d"), "d": ("created", None), "e": ("created", None), "x": ("failed", None), "f": ("created", None)}
    page = store.page(batch, "scope_key", "created_at", "memory_id", (F.lit(day(1)), F.lit("f")), 2).orderBy("scope_key", "position").collect()
    assert [(r.memory_id, r.has_more) for r in page] == [("b", True), ("d", True), ("e", False)]
    coded = store.encode_cursor(F.lit(day(1)), F.lit("ü/1"))
    assert "=" not in one(spark, coded) and one(spark, store.decode_cursor(coded)).ident == "ü/1"


def test_rank_fusion_and_mmr(spark):
    lists = [spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "q string, ident string, rank int"), spark.createDataFrame([("q", "b", 1)], "q string, ident string, rank int")]
    fused = vectors.reciprocal_rank_fusion([(lists[0], 1.0), (lists[1], 1.0)], ["q"]).orderBy("position").collect()
    assert [r.ident for r in fused] == ["b", "a"] and fused[0].similarity == pytest.approx((1 / 62 + 1 / 61) / (2 / 61), abs=1e-6)
    group = pd.DataFrame({"score": [0.9, 0.8, 0.5], "source": ["x", "x", "y"], "tokens": [["a"], ["a"], ["b"]]})
    assert vectors.mmr(group, 0.5, 3) == [0, 2, 1] and vectors.mmr(group, 0.0, 2) == [0, 1]


def test_vector_search_skips_null_and_zero(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<float>")
    blocks = vectors.search_all(rows, rows.where("vec_id < 4"), 2, block=1).orderBy("query", "rank").collect()
    assert [(r.query, r.vec_id) for r in blocks] == [(1, 2), (1, 5), (2, 1), (2, 5)]
    assert vectors.search_all(rows, rows.limit(0), 2).count() == 0
    got = vectors.search(rows, [(1, [1.0, 0.0])], 2).orderBy("rank").collect()
    assert [(r.vec_id, r.rank) for r in got] == [(2, 1), (5, 2)]


def test_paths(spark):
    edges = spark.createDataFrame([("e1", "a", "b", "KNOWS", None), ("e2", "b", "c", "OWNS", None), ("e3", "c", "a", "KNOWS", datetime(2030, 1, 1))], "uuid string, source string, target string, name string, valid_at timestamp")
    anchors = spark.createDataFrame([("a",)], "anchor string")
    assert [r.nodes for r in graph.typed_paths(edges, anchors, [("KNOWS", True), ("OWNS", True)], "2026-01-01 00:00:00").collect()] == [["a", "b", "c"]]
    found = graph.explore(edges, anchors, ["KNOWS", "OWNS"]).orderBy("position").collect()
    assert [(r.hops, r.nodes) for r in found] == [(1, ["a", "b"]), (1, ["a", "c"]), (2, ["a", "b", "c"]), (2, ["a", "c", "b"])]


def test_style_needs_enough_messages(spark):
    rows = spark.createDataFrame([("a", "hi!"), ("a", "ok?\nyes"), ("b", "x")], "author string, t string")
    got = style.profile(rows, ["author"], F.col("t"), least=2).collect()
    assert [(r.author, r.messages, r.mean_length, r.question_ratio, r.multiline_ratio) for r in got] == [("a", 2, 4.5, 0.5, 0.5)]
    counts = style.phrase_counts(rows, ["author"], F.col("t"), 2, 2)
    assert {(r.author, r.phrase): r.df for r in counts.collect()} == {("a", "hi"): 1, ("a", "ok"): 1, ("a", "ye"): 1, ("a", "es"): 1}


def test_ranked_fit_passes_over_what_is_too_large(spark):
    items = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(s).cast("long").alias("size"), F.lit(str(i)).alias("id")) for i, s in enumerate((10, 50, 10))])
    assert one(spark, context.ranked_fit(items, 24, 5)) == ["0", "2"] and one(spark, context.ranked_fit(items, 100, 1)) == ["0"]


def test_stream_is_replayable_and_bound(spark, tmp_path):
    schema = "scope_key string, message_id string, event_id string"
    spark.createDataFrame([("s", "a", None), ("s", "a ", None), ("s", None, "e")], schema).write.parquet(f"{tmp_path}/in")
    run = lambda: ingest.run_available(ingest.first_deliveries(ingest.stream(spark, f"{tmp_path}/in")), f"{tmp_path}/t", lambda b: b)
    run()
    spark.createDataFrame([("s", " a", None), ("t", "a", None)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    run()
    got = sorted((r.scope_key, r.id) for r in spark.read.parquet(f"{tmp_path}/t/out").collect())
    assert got == [("s", "a"), ("s", "e"), ("t", "a")]
    shape = spark.read.parquet(f"{tmp_path}/in").schema
    ingest.bind_checkpoint(spark, f"file://{tmp_path}/c", "task", 1, shape)
    ingest.bind_checkpoint(spark, f"file://{tmp_path}/c", "task", 1, shape)
    with pytest.raises(ingest.CheckpointMismatch):
        ingest.bind_checkpoint(spark, f"file://{tmp_path}/c", "task", 2, shape)


def test_hubs_do_not_multiply_and_nothing_is_lost(spark):
    rows = [(f"h{i:03d}", "a", "hub", "E") for i in range(3)] + [(f"x{i:04d}", "hub", f"n{i}", "E") for i in range(400)] + [("z", "hub", "a", "E")] + [(f"b{i:03d}", "big", f"m{i}", "E") for i in range(300)]
    edges = spark.createDataFrame([(*r, None) for r in rows], "uuid string, source string, target string, name string, valid_at timestamp")
    anchors = spark.createDataFrame([("a",), ("big",)], "anchor string")
    got = {(r.anchor, r.position): (r.hops, r.edges) for r in graph.explore(edges, anchors, ["E"], scan=20).collect()}
    paths = sorted([(1, [u]) for u in ("h000", "h001", "h002", "z")]) + sorted((2, [f, u]) for f in ("h000", "h001", "h002", "z") for u, s, t, _ in rows if s == "hub" and t != "a")
    assert [got["a", i + 1] for i in range(20)] == paths[:20] and [got["big", i + 1] for i in range(20)] == [(1, [f"b{i:03d}"]) for i in range(20)]
