import random
from datetime import datetime, timedelta

from memloom.operators import history

SCHEMA = "log_id long, feed string, memory_id string, version int, state string, valid_from timestamp, valid_to timestamp, updated_at timestamp, recorded_at timestamp, slice string"
DAY = datetime(2025, 1, 1)


def at(n):
    return DAY + timedelta(days=n)


def brute(rows):
    chains = {}
    for r in sorted((r for r in rows if r[2] and r[7]), key=lambda r: (r[8], r[0])):
        v = chains.setdefault(r[2].strip(), {}).setdefault(r[7], [None, None, None])
        if r[4] and r[4].strip():
            v[0] = r[4].strip().lower()
        v[1:] = r[5], r[6]
    out = {}
    for k, vs in chains.items():
        state, prior, periods = None, None, []
        for t in sorted(vs):
            state = vs[t][0] or state
            now = (state, *vs[t][1:])
            if not periods or now != prior:
                periods.append((t, now))
            prior = now
        out[k] = periods
    return out


def made(seed, n=150):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        # What two reports of one version say about validity agrees.
        k, t = r.randrange(5), r.randrange(30)
        valid = at(t % 3) if t % 4 else None
        rows.append((i, r.choice(["update", "snapshot"]), r.choice([f"m{k}", f" m{k}"]), r.choice([None, t]), r.choice([None, "A", "a ", "b", ""]), valid, None, at(t), at(t + r.randrange(40)), "x"))
    return rows


def periods(df):
    out = {}
    for r in df.orderBy("memory_id", "started_us").collect():
        out.setdefault(r.memory_id, []).append((r.started_us, (r.state, r.valid_from, r.valid_to)))
    return out


def micros(t):
    return round((t - datetime(1970, 1, 1)).total_seconds() * 1e6)


def expected(rows):
    return {k: [(micros(t), v) for t, v in vs] for k, vs in brute(rows).items()}


def test_history_late_and_repeated_rows(spark):
    rows = made(1)
    assert periods(history.history(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_long_chains_in_slices_give_the_same(spark):
    rows = made(2, 300)
    found = history.build_chains(history.versions(spark.createDataFrame(rows, SCHEMA)), slice_rows=4)
    assert periods(found) == expected(rows)
    for vs in [found.where(f"memory_id = 'm{i}'").orderBy("started_us").collect() for i in range(5)]:
        assert [v.ended_us for v in vs] == [*[v.started_us for v in vs[1:]], None]


def test_empty_log_and_null_keys(spark):
    assert history.history(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "update", None, 1, "a", None, None, at(1), at(1), ""), (2, "update", "m", 1, None, None, None, at(1), at(2), ""), (3, "update", "m", 1, None, None, None, None, at(2), "")]
    assert periods(history.history(spark.createDataFrame(rows, SCHEMA))) == {"m": [(micros(at(1)), (None, None, None))]}


def test_table_replaces_affected_chains_only(spark, tmp_path):
    rows = made(4)
    table = history.HistoryTable(spark, f"file://{tmp_path}/h")
    assert table.apply(spark.createDataFrame(rows[:80], SCHEMA)) == 1
    assert table.apply(spark.createDataFrame(rows[80:], SCHEMA)) == 2
    assert periods(table.read()) == expected(rows)
    (tmp_path / "h" / "versions" / ".crashed").touch()  # a crash before the last rename
    assert table.current() == 2


def test_a_batch_rewrites_its_buckets_only_and_the_second_writer_fails(spark, tmp_path):
    import pytest

    rows = [(i, "update", f"m{i % 40}", 1, "a", None, None, at(i // 40), at(i // 40), "") for i in range(120)]
    table = history.HistoryTable(spark, f"file://{tmp_path}/h", buckets=8)
    table.apply(spark.createDataFrame(rows, SCHEMA))
    first = table._listed(1)["chains"]
    late = [(500, "update", "m7", 1, "b", None, None, at(1), at(9), "")]
    table.apply(spark.createDataFrame(late, SCHEMA))
    second = table._listed(2)["chains"]
    assert sum(first[b] != second[b] for b in first) == 1 and len(first) == len(second) > 1
    assert periods(table.read()) == expected(rows + late)
    other = history.HistoryTable(spark, f"file://{tmp_path}/h", buckets=8)
    other.current = lambda: 1  # started before the second batch was in force
    with pytest.raises(history.ConcurrentWrite):
        other.apply(spark.createDataFrame([(501, "update", "m8", 1, "c", None, None, at(1), at(9), "")], SCHEMA))
    assert table.current() == 2 and periods(table.read()) == expected(rows + late)
    assert table.apply(spark.createDataFrame([], SCHEMA)) == 3 and periods(table.read()) == expected(rows + late)
