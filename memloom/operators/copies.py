"""Messages delivered more than once: one row of each, whichever identifiers its copies share.

Method: hash aggregation by identifier, keeping with ``min_by`` the key of the row that comes first by (delivery time,
tie-break), combined on the map side before any shuffle. Spark hashes only on buffers of fixed size, so the struct of time
and tie-break is packed into one decimal. A tie-break that is a string can't be packed: there the time is aggregated first,
and strings are compared only among rows that share an identifier.

With several identifiers, rows may be one message through a chain of shared ones. Each distinct combination of identifiers is
a node; nodes that meet no other are settled at once. The others take the least label of any node they share an identifier
or a label with, until no label changes.

Nothing is ever grouped into a list, so an identifier that holds a third of the rows costs one partial row a task.
Labels come back to their nodes by equi-joins with one row an identifier on the small side; it is hashed, and adaptive
execution splits the large side where it skews.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.keys import clean_id
from memloom.staging import drop, stage

#: A null scope is a scope of its own; no cleaned scope can contain this value.
NO_SCOPE = "\u0000"


def scope_id(scope: Column | str) -> Column:
    """16 bytes that stand for a scope: its MD5, as scopes are long strings that would fill the shuffles."""
    return F.unhex(F.md5(F.coalesce(scope, F.lit(NO_SCOPE))))

_WHOLE = ("bigint", "int", "smallint", "tinyint")


def _big(n: int) -> Column:
    return F.lit(str(n)).cast("decimal(20,0)")


def moment(df: DataFrame, time: str) -> Column:
    """Microseconds of a timestamp, or a whole number as it is; both must be within 2^58 of 0, as all of Spark's timestamps are."""
    return F.col(time).cast("long") if dict(df.dtypes)[time] in _WHOLE else F.unix_micros(time)


def packed(micros: Column, key: Column) -> Column:
    """Decimal that sorts by ``micros`` (null last), then by ``key``, both whole numbers."""
    micros = F.coalesce(micros, F.lit(1 << 58)) + F.lit(1 << 58)
    return (micros.cast("decimal(20,0)") * _big(1 << 64) + (key.cast("decimal(20,0)") + _big(1 << 63))).cast("decimal(38,0)")


def _identified(df: DataFrame, scope: str, identifier: str, time: str, key: str) -> DataFrame:
    return df.select(F.coalesce(scope, F.lit(NO_SCOPE)).alias("_s"), clean_id(identifier).alias("_i"), key, moment(df, time).alias("_t")).where("_i is not null")


def _tied(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """For string keys: rows that share their identifier with others, and the first of them for each identifier."""
    many = rows.groupBy("_s", "_i").agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    shared = rows.join(many.hint("shuffle_hash"), ["_s", "_i"], "left_semi")
    return shared, shared.groupBy("_s", "_i").agg(F.min_by(F.col(key), F.struct(F.col("_t").isNull(), F.col("_t"), F.col(key))).alias(key))


def keep_first(df: DataFrame, scope: str, identifier: str, time: str, key: str) -> DataFrame:
    """The key of the row to keep for each (scope, identifier); rows with a blank identifier identify nothing."""
    rows = _identified(df, scope, identifier, time, key)
    if dict(df.dtypes)[key] in _WHOLE:
        return rows.groupBy("_s", "_i").agg(F.min_by(F.col(key), packed(F.col("_t"), F.col(key))).alias(key))
    # The first time of each identifier, and how many rows have it, by hash aggregation; only equal times compare keys.
    timed = rows.withColumn("_o", packed(F.col("_t"), F.lit(0)))
    first = timed.groupBy("_s", "_i").agg(F.min("_o").alias("_o"))
    return timed.join(first.hint("shuffle_hash"), ["_s", "_i", "_o"], "left_semi").groupBy("_s", "_i").agg(F.min(key).alias(key))


def surplus_of_key(df: DataFrame, scope: str, identifier: str, time: str, key: str) -> DataFrame:
    """Keys of all rows but the first of each (scope, identifier).

    ``key`` must be unique. The keepers are taken away by an anti-join on ``key``, which is spread evenly however
    the identifiers are.
    """
    if dict(df.dtypes)[key] in _WHOLE:
        rows = df.where(clean_id(identifier).isNotNull()).select(key)
        return rows.join(keep_first(df, scope, identifier, time, key), key, "left_anti")
    shared, kept = _tied(_identified(df, scope, identifier, time, key), key)
    return shared.select(key).join(kept, key, "left_anti")


def combinations(rows: DataFrame, by: Sequence[str], *more: Column) -> DataFrame:
    """Distinct combinations of ``by`` in ``rows`` (which have ``key`` and ``t``, microseconds): ``by``, node (the key of the
    combination's first row), t (its time) and ``more`` aggregates of fixed size."""
    return rows.groupBy(*by).agg(F.min_by("key", packed(F.col("t"), F.col("key"))).alias("node"), F.min("t").alias("t"), *more)


def id_rows(df: DataFrame, scope: str, ids: Sequence[str], time: str, key: str, *more: Column) -> DataFrame:
    """scope_id, id0, id1, ... (trimmed, '' if blank), key, t (microseconds) and ``more``."""
    cleaned = [F.coalesce(clean_id(x), F.lit("")).alias(f"id{i}") for i, x in enumerate(ids)]
    return df.select(scope_id(scope).alias("scope_id"), *cleaned, F.col(key).cast("long").alias("key"), moment(df, time).alias("t"), *more)


def mark_linked(nodes: DataFrame, names: Sequence[str]) -> DataFrame:
    """``nodes`` (scope_id, ``names``, node and more) with ``label``: null for a node that shares no identifier with another
    one, else the least node among those it shares one with directly. Staged.

    Only identifiers and nodes are shuffled to find out who meets; the other columns move once, with the result.
    """
    met = None
    for c in names:
        given = nodes.where(F.col(c) != "").select("scope_id", c, "node")
        many = given.groupBy("scope_id", c).agg(F.count("*").alias("_n"), F.min("node").alias("_l")).where("_n > 1").drop("_n")
        found = given.join(many.hint("shuffle_hash"), ["scope_id", c]).select("node", "_l")
        met = found if met is None else met.unionByName(found)
    linked = stage(met.groupBy("node").agg(F.min("_l").alias("_l")))
    marked = stage(nodes.join(linked.hint("shuffle_hash"), "node", "left").select(*nodes.columns, F.when(F.col("_l").isNotNull(), F.least("node", "_l")).alias("label")))
    drop(linked)
    return marked


def close_links(marked: DataFrame, names: Sequence[str]) -> DataFrame:
    """(node, keeper) for the linked nodes of ``mark_linked``: ``keeper`` is the first node of the whole group by (t, node)."""
    linked = marked.where("label is not null").select("scope_id", *names, "node", "t", "label")
    now = stage(linked.withColumn("moved", F.col("label") < F.col("node")))
    while now.where("moved").limit(1).count():
        step = now
        for c in names:
            least = now.where(F.col(c) != "").groupBy("scope_id", c).agg(F.min("label").alias(f"_l_{c}"))
            step = step.join(least, ["scope_id", c], "left")
        step = step.withColumn("_best", F.least("label", *[f"_l_{c}" for c in names]))
        # What any member of a group has found goes to all of it, so chains of any length close in few rounds.
        whole = step.groupBy("label").agg(F.min("_best").alias("_whole"))
        step = step.join(whole, "label").select("scope_id", *names, "node", "t", F.col("_whole").alias("label"), (F.col("_whole") < F.col("label")).alias("moved"))
        new = stage(step)
        drop(now)
        now = new
    first = now.groupBy("label").agg(F.min_by("node", packed(F.col("t"), F.col("node"))).alias("keeper"))
    return now.select("node", "label").join(first, "label").select("node", "keeper")


def surplus_of_links(df: DataFrame, scope: str, ids: Sequence[str], time: str, key: str) -> DataFrame:
    """Keys of all rows but the first of each group linked by ``ids``; ``key`` must be unique and a whole number."""
    if dict(df.dtypes)[key] not in _WHOLE:
        raise TypeError(f"{key} must be a whole number")
    names = [f"id{i}" for i in range(len(ids))]
    rows = id_rows(df, scope, ids, time, key).where(F.greatest(*names) != "")
    marked = mark_linked(stage(combinations(rows, ["scope_id", *names])), names)
    links = close_links(marked, names)
    every = df.where(F.coalesce(*[clean_id(x) for x in ids]).isNotNull()).select(key)
    within = every.join(marked.select(F.col("node").alias(key)), key, "left_anti")
    return within.unionByName(links.where("node != keeper").select(F.col("node").alias(key)))


def keep_one(df: DataFrame, scope: str, ids: Sequence[str], time: str, key: str) -> DataFrame:
    """``df`` with exactly one row of each message; rows without identifiers all stay.

    Defined results: null delivery times sort last; ids of white space are no ids; a null scope is one scope; an empty
    table gives an empty table; any further columns are carried through untouched.
    """
    gone = surplus_of_links(df, scope, ids, time, key) if len(ids) > 1 else surplus_of_key(df, scope, ids[0], time, key)
    return df.join(gone, key, "left_anti").select(*df.columns)
