import random

from memloom.operators import copies

SCHEMA = "row long, scope string, m string, e string, t long, _s string"


def brute(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for row, scope, m, e, *_ in rows:
        for kind, v in (("m", m), ("e", e)):
            if v and v.strip():
                parent[find((scope, kind, v.strip()))] = find(("row", row))
    first = {}
    for r in sorted(rows, key=lambda r: (r[4] is None, r[4] or 0, r[0])):
        first.setdefault(find(("row", r[0])), r[0])
    return {r[0] for r in rows} - set(first.values())


def surplus(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.row for r in copies.surplus_of_links(df, "scope", ["m", "e"], "t", "row").collect()}


def test_chain_over_two_identifiers(spark):
    rows = [(1, "s", "a", None, 5, "x"), (2, "s", "a", "p", 4, "x"), (3, "s", None, " p ", 9, "x"), (4, "s", "b", "q", 1, "x"), (5, "t", "a", "p", 0, "x")]
    assert surplus(spark, rows) == {1, 3}


def test_long_chain_against_brute_force(spark):
    links = list(range(60))
    random.Random(7).shuffle(links)
    rows = []
    for i in links:
        rows.append((len(rows), "s", f"m{i}", f"e{i}", i * 7 % 13, ""))
        rows.append((len(rows), "s", f"m{i + 1}", f"e{i}", i * 5 % 11, ""))
    assert surplus(spark, rows) == brute(rows)


def test_random_groups_nulls_ties_blanks(spark):
    r = random.Random(3)
    pick = lambda p, n: r.choice([None, "", "  ", *(f"{p}{i}" for i in range(n))])
    rows = [(i, r.choice(["s", "t", None]), pick("m", 25), pick("e", 40), r.choice([None, 1, 2, 3]), "clash") for i in range(200)]
    assert surplus(spark, rows) == brute(rows)


def test_empty_table_and_rows_without_identity(spark):
    assert surplus(spark, []) == set()
    rows = [(1, "s", None, "", 1, ""), (2, "s", " ", None, 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert surplus(spark, rows) == set()
    assert copies.keep_one(df, "scope", ["m", "e"], "t", "row").count() == 2


def test_one_key_keeps_first_and_columns(spark):
    df = spark.createDataFrame([(1, "s", "k", "e", 2, "v"), (2, "s", " k", "e", 1, "w"), (3, "s", "", "e", 1, "u")], SCHEMA)
    kept = copies.keep_one(df, "scope", ["m"], "t", "row")
    assert kept.columns == df.columns
    assert {r.row for r in kept.collect()} == {2, 3}
