"""Reading the tables a query runs on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table; timestamps without zone are taken as UTC (the session's zone)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    plain = {f.name: F.col(f.name).cast("timestamp") for f in df.schema if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(plain) if plain else df


def small_table(spark: SparkSession, sf_dir: str, name: str, limit: int = 10_000) -> list:
    """Rows of a table of parameters or held-out items. Raises if it has more than ``limit`` rows: then it isn't one."""
    rows = table(spark, sf_dir, name).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{name} has more than {limit} rows; it is read as a table of parameters")
    return rows
