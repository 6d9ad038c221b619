from datetime import datetime, timedelta

from memloom.llm import conversations as c

PART = "array<struct<type:string,text:string>>"
SCHEMA = f"delivery_id long, scope_key string, actor string, text string, event_id string, message_id string, message_type string, reply_to_id string, thread_id string, thread_root_id string, at timestamp, received_at timestamp, parts {PART}, turn string"
T0 = datetime(2025, 1, 1)


def rows(*given):
    out = []
    for i, (actor, text, message, reply, thread, *more) in enumerate(given):
        k = more[0] if more else {}
        at = T0 + timedelta(minutes=k.get("at", i))
        out.append((i, k.get("scope", "s"), actor, text, k.get("event"), message, k.get("type", "message"), reply, thread, k.get("root"), at, at, k.get("parts"), "clash"))
    return out


def run(spark, given):
    df = spark.createDataFrame(rows(*given), SCHEMA)
    return {r.thread_id for r in c.dropped(df).collect()}, [(r.thread_id, r.position, r.role, r.text) for r in c.rebuild(df).orderBy("thread_id", "position").collect()]


def test_sound_conversation_is_ordered_and_counted_once(spark):
    gone, turns = run(spark, [("owner", "hi", "a", None, "t"), ("Peer", "hello", "b", "a", " t "), ("Peer", "hello", "b", "a", "t", {"at": 9}), ("agent", "​\xa0", "c", "b", "t")])
    assert gone == set()
    assert turns == [("t", 1, "owner", "hi"), ("t", 2, "contact", "hello")]


def test_dangling_reply_one_role_and_parts(spark):
    gone, turns = run(spark, [
        ("owner", "x", "a", "nowhere", "dangling"), ("agent", "y", "b", None, "dangling"),
        ("owner", "x", "c", None, "lonely"), ("system", "y", "d", None, "lonely"), ("agent", " ", "e", None, "lonely"),
        ("owner", "x", "f", None, "parts"), ("agent", None, "g", "f", "parts", {"parts": [("text", "from part"), ("text", None)]}),
    ])
    assert gone == {"dangling", "lonely"}
    assert turns == [("parts", 1, "owner", "x"), ("parts", 2, "agent", "from part")]


def test_circles_are_found_and_long_chains_are_not(spark):
    circle = [("owner", "x", "a", "c", "circle"), ("agent", "y", "b", "a", "circle"), ("agent", "y", "c", "b", "circle")]
    # Clocks that run backwards all along the chain make every reply suspect.
    chain = [("owner" if i % 2 else "agent", "x", f"n{i}", f"n{i - 1}" if i else None, "chain", {"at": -i}) for i in range(70)]
    gone, turns = run(spark, circle + chain)
    assert gone == {"circle"} and len(turns) == 70


def test_threads_through_replies_and_roots(spark):
    gone, turns = run(spark, [
        ("owner", "1", "a", None, "t"), ("agent", "2", "b", "a", None), ("owner", "3", "c", "b", ""), ("owner", "4", "d", "c", " "),
        ("agent", "root", "r", None, None), ("owner", "5", "e", None, "u", {"root": "r"}), ("agent", "nobody's", "z", None, None),
    ])
    assert gone == set()
    assert [(t, text) for t, _, _, text in turns] == [("t", "1"), ("t", "2"), ("t", "3"), ("t", "4"), ("u", "root"), ("u", "5")]


def test_edits_and_deletions_fold_by_version(spark):
    _, turns = run(spark, [("owner", "frist", "a", None, "t"), ("owner", "first", "a", None, "t", {"at": 5}), ("agent", "ok", "b", None, "t"), ("agent", "secret", "d", None, "t"), ("agent", None, "d", None, "t", {"type": "recall", "at": 8})])
    assert [x[3] for x in turns] == ["first", "ok"]


def test_event_id_names_a_message_only_without_message_id(spark):
    gone, _ = run(spark, [("owner", "x", "a", None, "t", {"event": "ev"}), ("agent", "y", "b", "ev", "t"), ("owner", "x", None, None, "u", {"event": "e2"}), ("agent", "y", "c", "e2", "u")])
    assert gone == {"t"}


def test_empty_table(spark):
    assert run(spark, []) == (set(), [])
