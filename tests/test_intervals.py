import random

from pyspark.sql import functions as F

from memloom.operators import intervals

SCHEMA = "k string, a long, b long, cell long"


def brute(rows):
    periods, gaps = set(), set()
    for k in {r[0] for r in rows}:
        end = start = None
        for a, b in sorted((r[1], r[2]) for r in rows if r[0] == k and r[1] is not None and r[2] is not None and r[1] < r[2]):
            if end is not None and a > end:
                gaps.add((k, end, a))
                periods.add((k, start, end))
                start = a
            start = a if start is None else start
            end = b if end is None else max(end, b)
        if end is not None:
            periods.add((k, start, end))
    return periods, gaps


def run(spark, rows):
    m = intervals.Merged(spark.createDataFrame(rows, SCHEMA), ["k"], "a", "b")
    return {tuple(r) for r in m.periods().collect()}, {tuple(r) for r in m.gaps().collect()}


def test_blocks_are_canonical(spark):
    found = spark.range(1).select(intervals.blocks(F.lit(3).cast("long"), F.lit(12).cast("long"), 4).alias("x")).first().x
    assert sorted((b["index"] << b["level"], (b["index"] + 1) << b["level"]) for b in found) == [(3, 4), (4, 8), (8, 12)]


def test_small_and_huge_intervals_against_brute_force(spark):
    r = random.Random(5)
    rows = []
    for _ in range(300):
        k, a = r.choice(["x", "y", None]), r.randrange(1 << r.choice([4, 20, 45, 57]))
        rows.append((k, a, a + r.randrange(1 << r.choice([3, 18, 41, 46])), 1))
    assert run(spark, rows) == brute(rows)


def test_open_ends_nested_touching_impossible(spark):
    low, top = -(1 << 63), (1 << 63) - 1
    rows = [("x", low, 50, 0), ("x", 50, 60, 0), ("x", 55, 57, 0), ("x", 100, top, 0), ("x", 90, 80, 0), ("x", None, 70, 0), ("x", 70, 70, 0), ("y", 5, 5, 0)]
    assert run(spark, rows) == ({("x", low, 60), ("x", 100, top)}, {("x", 60, 100)})


def test_cells_fill_and_merge_over_tiers(spark):
    # Touching intervals make full cells of the second tier; one long interval covers many small cells.
    rows = [("x", i, i + 1, 0) for i in range(5000)] + [("x", 6000 + 2 * i, 6001 + 2 * i, 0) for i in range(300)] + [("y", 0, 9000, 0)] + [("y", 3 * i, 3 * i + 1, 0) for i in range(2900)]
    assert run(spark, rows) == brute(rows)


def test_a_key_with_a_third_of_the_rows(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot", "hot", f"k{i % 200}"]), a, a + r.randrange(1, 900), 0) for i in range(3000) for a in [r.randrange(1_000_000)]]
    assert run(spark, rows) == brute(rows)


def test_empty(spark):
    assert run(spark, []) == (set(), set())
