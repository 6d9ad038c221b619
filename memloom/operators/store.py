"""Store verbs over a table of records: idempotent writes, pages, lookups, transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions.keys import clean_id
from memloom.operators.copies import keep_first


def put(batch: DataFrame, stored: DataFrame, scope: str = "scope_key", key: str = "idempotency_key", time: str = "created_at", ident: str = "memory_id") -> DataFrame:
    """Outcome of writing ``batch`` into ``stored``: ident, status, existing (the row that was there first).

    A key that is stored, or that comes again within the batch, is a duplicate; an ident that is stored under another
    key is a conflict and fails; everything else is created. Blank keys never collide.
    """
    there = keep_first(stored, scope, key, time, ident).withColumnRenamed(ident, "stored_row")
    first = keep_first(batch, scope, key, time, ident).withColumnRenamed(ident, "batch_row")
    known = stored.select(F.col(ident), F.lit(True).alias("taken"))
    rows = batch.select(ident, F.coalesce(scope, F.lit("\u0000")).alias("_s"), clean_id(key).alias("_i")).join(there, ["_s", "_i"], "left").join(first, ["_s", "_i"], "left").join(known, ident, "left")
    earlier = F.coalesce("stored_row", F.when(F.col("batch_row") != F.col(ident), F.col("batch_row")))
    return rows.select(ident, F.when(earlier.isNotNull(), "duplicate").when(F.col("taken"), "failed").otherwise("created").alias("status"), earlier.alias("existing"))


def page(df: DataFrame, scope: str, time: str, ident: str, after: tuple[Column, Column], limit: int) -> DataFrame:
    """The next ``limit`` rows of each scope after a cursor, oldest first, with ``has_more``; one row more is read to know."""
    ahead = df.where((F.col(time) > after[0]) | ((F.col(time) == after[0]) & (F.col(ident) > after[1])))
    order = Window.partitionBy(scope).orderBy(time, ident)
    read = ahead.withColumn("position", F.row_number().over(order)).where(F.col("position") <= limit + 1)
    more = read.groupBy(scope).agg((F.max("position") > limit).alias("has_more"))
    return read.where(F.col("position") <= limit).join(more, scope)


def encode_cursor(time: Column, ident: Column) -> Column:
    """URL-safe base64, without padding, of the JSON array of time and ident."""
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")
    text = F.concat(F.lit('["'), stamp, F.lit('","'), ident, F.lit('"]'))
    return F.rtrim(F.translate(F.base64(F.encode(text, "utf-8")), "+/=\r\n", "-_"))


def decode_cursor(cursor: Column) -> Column:
    """Struct (time, ident) of a cursor; null if it is none."""
    padded = F.rpad(F.translate(cursor, "-_", "+/"), (F.ceil(F.length(cursor) / 4) * 4).cast("int"), F.lit("="))
    parts = F.from_json(F.decode(F.unbase64(padded), "utf-8"), "array<string>")
    return F.when(F.size(parts) == 2, F.struct(F.try_to_timestamp(F.get(parts, F.lit(0))).alias("time"), F.get(parts, F.lit(1)).alias("ident")))


def fold_transitions(log: DataFrame, ident: str = "memory_id") -> DataFrame:
    """Latest state of each record from an append-only log of versions; a compare-and-set that came too late is not in force."""
    return log.groupBy(ident).agg(F.max_by(F.struct("version", "state", "updated_at"), F.struct("version", "updated_at", "log_id")).alias("r")).select(ident, "r.*")


def transition(rows: DataFrame, requests: DataFrame, ident: str = "memory_id") -> DataFrame:
    """Outcome of compare-and-set requests (ident, expected, target): applied with the next version, or not and why."""
    met = requests.join(rows.select(ident, "state", "version"), ident, "left")
    applied = F.col("state") == F.col("expected")
    return met.select(
        ident,
        F.when(F.col("state").isNull(), "missing").when(applied, "applied").when(F.col("state") == F.col("target"), "already_applied").otherwise("conflict").alias("outcome"),
        F.when(applied, F.col("target")).otherwise(F.col("state")).alias("state"),
        F.when(applied, F.col("version") + 1).otherwise(F.col("version")).alias("version"),
    )
