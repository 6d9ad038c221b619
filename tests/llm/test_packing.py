import numpy as np

from memloom.llm import packing




def test_every_placement_is_a_least_sum_of_squares():
    r = np.random.default_rng(1)
    for capacity in (7, 16):
        sizes = r.integers(1, capacity + 1, 120)
        at = packing.place(sizes, capacity)
        levels = {}
        for s, b in zip(sizes, at):
            squares = lambda d: sum(n * n for h in range(1, capacity) if (n := list(d.values()).count(h)))
            options = [squares({**levels, k: levels.get(k, 0) + s}) for k in [*levels, max(levels, default=-1) + 1] if levels.get(k, 0) + s <= capacity]
            levels[b] = levels.get(b, 0) + s
            assert squares(levels) == min(options)
        assert max(levels.values()) <= capacity


def test_pack_whole_parts_and_edges(spark):
    rows = [(i, "é" * n, "clash") for i, n in enumerate([3, 8, 5, 21, 10, 1, 0])] + [(99, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lot string")
    got = packing.pack(df, "text", [(1, 20), (2, 100)], lot_texts=3).toPandas()
    assert set(got[got.oversized].doc_id) == {3} and set(got[got.oversized].budget_id) == {1}
    filled = got.groupby(["budget_id", "lot", "container"])["bytes"].sum().reset_index()
    assert (filled["bytes"] <= filled.budget_id.map({1: 20, 2: 100})).all()
    assert got.groupby(["budget_id", "doc_id"])["bytes"].sum().loc[1].to_dict() == {0: 6, 1: 16, 2: 10, 3: 42, 4: 20, 5: 2}
    assert sorted(got[(got.doc_id == 3) & (got.budget_id == 1)].from_byte) == [0, 20, 40]
    assert packing.utilization(packing.pack(df, "text", [(1, 20)]), [(1, 20)]).first().used <= 1


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), "text", [(1, 5)]).count() == 0
