"""Incremental processing: bounded runs over what has arrived, replayable by batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from memloom.functions.keys import clean_id


class CheckpointMismatch(ValueError):
    """A checkpoint belongs to another task, version or schema."""


def bind_checkpoint(spark: SparkSession, folder: str, task: str, version: int, schema: StructType) -> None:
    """Bind ``folder`` to a task, its version and input schema, or raise if it is bound otherwise."""
    wanted = json.dumps({"task": task, "version": version, "schema": json.loads(schema.json())}, sort_keys=True)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{folder}/binding.json")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        found = "\n".join(r.value for r in spark.read.text(f"{folder}/binding.json").collect())
        if found != wanted:
            raise CheckpointMismatch(f"{folder} is bound to {found[:200]}")
        return
    out = fs.create(path, False)
    out.write(bytearray(wanted.encode()))
    out.close()


def run_available(source: DataFrame, folder: str, process: Callable[[DataFrame], DataFrame]) -> None:
    """Process all that has arrived at a streaming ``source``, batch by batch, into ``folder``/out.

    Each batch overwrites its own folder, so a batch that is replayed after a crash replaces its first attempt. The
    stream's checkpoint is only moved on after the batch's write; nothing is dropped as late.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    source.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A parquet folder or file as a stream, with the schema it has now."""
    # As a pattern, a single file will do too; the last letter in brackets keeps neighbours with a longer name out.
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def first_deliveries(messages: DataFrame) -> DataFrame:
    """Rows of a stream whose (scope, id) has not been seen before; the state has no horizon, as late copies come at any time."""
    keyed = messages.select("scope_key", F.coalesce(clean_id("message_id"), clean_id("event_id")).alias("id")).where("id is not null")
    return keyed.dropDuplicates(["scope_key", "id"])


def tumbling(events: DataFrame, time: str, width: str, lateness: str, keys: list[str]) -> DataFrame:
    """Counts by window; windows close once the watermark has passed them."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
