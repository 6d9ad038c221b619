import pytest

from memloom import staging, storage
from memloom.operators import planning, proposals
from memloom.operators.ranks import positions

SCHEMA = "id string, at long, body string"


def test_inbox_takes_each_identity_once_and_replays_a_reserved_batch(spark, tmp_path):
    box = storage.Inbox(spark, f"file://{tmp_path}/in", ["id"], ["at"])
    assert box.rows() is None and box.reserve(5) == (1, 0)
    assert box.append(spark.createDataFrame([("a", 2, "x"), ("b", 1, "y"), ("b", 1, "y"), (" ", 1, "z"), (None, 1, "z")], SCHEMA)) == 2
    assert box.append(spark.createDataFrame([("a", 2, "x"), ("c", 0, "w")], SCHEMA)) == 1
    assert {(r.id, r.sequence) for r in box.rows().collect()} == {("b", 1), ("a", 2), ("c", 3)}
    assert box.reserve(2) == (1, 2) == box.reserve(9)  # the same again until it is acknowledged
    with pytest.raises(ValueError):
        box.acknowledge(3)
    box.acknowledge(2)
    assert box.reserve(9) == (3, 3) and [r.id for r in box.batch(3, 3).collect()] == ["c"]
    with pytest.raises(storage.PayloadConflict):
        box.append(spark.createDataFrame([("a", 2, "other")], SCHEMA))
    assert box.append(spark.createDataFrame([], SCHEMA)) == 0


def test_checkpoints_are_bound_and_move_on_once(spark, tmp_path):
    s = storage.CheckpointStore(spark, f"file://{tmp_path}/c")
    assert s.load("t", "scope", 1) is None
    s.save("t", "scope", 1, "p1", None)
    assert s.load("t", "scope", 1) == "p1"
    with pytest.raises(storage.ConcurrentWrite):
        s.save("t", "scope", 1, "p2", None)
    with pytest.raises(ValueError):
        s.load("t", "scope", 2)


def test_stages_run_once_and_resume(spark, tmp_path):
    ran = []

    def stage(name, fail=False):
        def f(df):
            ran.append(name)
            if fail:
                raise RuntimeError(name)
            return df.withColumnRenamed(df.columns[0], name)

        return name, f

    first = spark.range(3)
    with pytest.raises(RuntimeError):
        storage.run_stages(spark, f"file://{tmp_path}/s", [stage("a"), stage("b", True)], first)
    out = storage.run_stages(spark, f"file://{tmp_path}/s", [stage("a"), stage("b")], first)
    assert ran == ["a", "b", "b"] and out.columns == ["b"] and out.count() == 3
    with pytest.raises(ValueError):
        storage.run_stages(spark, f"file://{tmp_path}/s", [stage("b")], first)


def test_positions_in_a_group_over_many_pieces(spark):
    rows = [("hot", i, f"x{i}") for i in range(500)] + [(None, i, "n") for i in range(3)] + [("one", 7, "o")]
    df = spark.createDataFrame(rows, "k string, t long, _at string").repartition(6)
    got = {(r.k, r.t): r.n for r in positions(df, ["k"], ["t"], "n").collect()}
    assert got == {(k, t): (t + 1 if k != "one" else 1) for k, t, _ in rows}
    assert positions(df.limit(0), ["k"], ["t"], "n").count() == 0


def test_staged_tables_are_dropped(spark):
    import os

    df = staging.stage(spark.range(5))
    path = df.staged_path.removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    staging.drop(df, None)
    assert not os.path.exists(path)


def test_spans_cover_and_overlap(spark):
    text = "word " * 700 + "x" * 3000
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "short")], "k long, t string")
    got = sorted((r.k, r.start, r.end) for r in planning.text_spans(df, "k", "t").collect())
    mine = [x[1:] for x in got if x[0] == 1]
    assert (4, 0, 5) in got and {k for k, _, _ in got} == {1, 4} and mine[0][0] == 0 and mine[-1][1] == len(text)
    assert all(b - a <= 1200 for a, b in mine) and all(c == b - 160 for (_, b), (c, _) in zip(mine, mine[1:]))


def test_too_many_drafts_of_one_message_are_refused(spark):
    rows = [(1, "s", "owner", "plan", f"do {i}", 0.9) for i in range(9)] + [(2, "s", "owner", "plan", "walk", 0.9), (3, "s", "owner", "plan", "Walk!", 0.9), (4, "s", "owner", "plan", "x", 0.5), (5, "s", "owner", "plan", None, 0.9)]
    df = spark.createDataFrame(rows, "delivery_id long, scope_key string, actor string, memory_type string, content string, confidence double")
    got = {(r.delivery_id, r.outcome) for r in proposals.drafts_to_proposals(df).collect()}
    assert got == {(1, "too_many"), (2, "proposed"), (3, "duplicate"), (4, "low_confidence"), (5, "empty")}
