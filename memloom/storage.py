"""State kept on storage as numbered versions, each put in force by one rename that never replaces another."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.functions.keys import clean_id
from memloom.operators.ranks import positions


class ConcurrentWrite(RuntimeError):
    """Another writer has put the next version in force first; read again and repeat."""


class PayloadConflict(ValueError):
    """The same identity came with another payload."""


class Versions:
    """A small JSON state in numbered versions under ``path``; of two writers of one number, the second fails."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._hadoop.Path(self.path).getFileSystem(self._conf)

    def current(self) -> int:
        """The number of the version in force; 0 if there is none."""
        at = self._hadoop.Path(self.path)
        names = [f.getPath().getName() for f in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return max([int(n) for n in names if n.isdigit()], default=0)

    def read(self, version: int) -> dict | None:
        return json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/{version}").collect())) if version else None

    def put(self, version: int, state: dict) -> None:
        made, final = self._hadoop.Path(f"{self.path}/.{uuid.uuid4().hex}"), self._hadoop.Path(f"{self.path}/{version}")
        out = self._fs.create(made, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        files = self._hadoop.FileContext.getFileContext(made.toUri(), self._conf)
        never = self.spark.sparkContext._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        try:
            files.rename(made, final, never)
        except Exception as e:
            self._fs.delete(made, False)
            if self._fs.exists(final):
                raise ConcurrentWrite(f"version {version} of {self.path} is in force already") from e
            raise


class CheckpointStore:
    """Checkpoints by task and scope, bound to the task's version."""

    def __init__(self, spark: SparkSession, path: str):
        self._versions = lambda key: Versions(spark, f"{path.rstrip('/')}/{key}")

    def load(self, task: str, scope: str, task_version: int) -> str | None:
        v = self._versions(f"{task}/{scope}")
        found = v.read(v.current())
        if found is not None and found["task_version"] != task_version:
            raise ValueError(f"the checkpoint of {task} is of version {found['task_version']}, not {task_version}")
        return found and found["cursor"]

    def save(self, task: str, scope: str, task_version: int, cursor: str, previous: str | None) -> None:
        """Moves on from ``previous``; fails if the checkpoint has moved since."""
        v = self._versions(f"{task}/{scope}")
        n = v.current()
        if self.load(task, scope, task_version) != previous:
            raise ConcurrentWrite(f"the checkpoint of {task} has moved on")
        v.put(n + 1, {"task_version": task_version, "cursor": cursor})


class Inbox:
    """Rows as they arrive, each identity once, in a durable sequence; taken in frozen batches that are acknowledged.

    ``path``/data holds one folder an append, never changed; the state lists them, the last sequence number, what is reserved and
    what is acknowledged.
    """

    def __init__(self, spark: SparkSession, path: str, identity: list[str], order: list[str]):
        self.spark, self.path, self.identity, self.order = spark, path.rstrip("/"), identity, order
        self.versions = Versions(spark, f"{self.path}/versions")

    def _state(self) -> tuple[int, dict]:
        n = self.versions.current()
        return n, self.versions.read(n) or {"folders": [], "last": 0, "reserved": 0, "acked": 0}

    def rows(self) -> DataFrame | None:
        _, state = self._state()
        return self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in state["folders"]]) if state["folders"] else None

    def append(self, batch: DataFrame) -> int:
        """Returns how many rows were new. Raises ``PayloadConflict`` if a known identity comes with another payload."""
        n, state = self._state()
        payload = F.sha2(F.to_json(F.struct(*sorted(batch.columns))), 256)
        rows = batch.where(F.coalesce(*[clean_id(c) for c in self.identity]).isNotNull()).withColumn("payload", payload)
        kept = rows.groupBy(*self.identity).agg(F.min_by(F.struct(*rows.columns), F.struct(*self.order, "payload")).alias("r"), F.count_distinct("payload").alias("_p")).select("r.*", "_p")
        there = self.rows()
        if there is not None:
            known = there.select(*self.identity, F.col("payload").alias("_known"))
            met = kept.join(known, self.identity, "left")
            if met.where("_known is not null and _known != payload").limit(1).count():
                raise PayloadConflict("a known identity came with another payload")
            kept = met.where("_known is null").drop("_known")
        if kept.where("_p > 1").limit(1).count():
            raise PayloadConflict("one identity came with two payloads")
        folder = uuid.uuid4().hex
        fresh = positions(kept.drop("_p").withColumn("_one", F.lit(1)), ["_one"], [*self.order, "payload"], "sequence", base=state["last"] + 1).drop("_one")
        fresh.write.parquet(f"{self.path}/data/{folder}")
        added = self.spark.read.parquet(f"{self.path}/data/{folder}").count()
        if added:
            self.versions.put(n + 1, state | {"folders": state["folders"] + [folder], "last": state["last"] + added})
        return added

    def reserve(self, most: int) -> tuple[int, int]:
        """(first, last) of the next batch; the same again until it is acknowledged."""
        n, state = self._state()
        if state["reserved"] > state["acked"]:
            return state["acked"] + 1, state["reserved"]
        last = min(state["last"], state["acked"] + most)
        if last > state["acked"]:
            self.versions.put(n + 1, state | {"reserved": last})
        return state["acked"] + 1, last

    def batch(self, first: int, last: int) -> DataFrame:
        return self.rows().where(F.col("sequence").between(first, last))

    def acknowledge(self, last: int) -> None:
        n, state = self._state()
        if last != state["reserved"]:
            raise ValueError(f"{last} is not what is reserved")
        self.versions.put(n + 1, state | {"acked": last})


def run_stages(spark: SparkSession, path: str, stages: list[tuple[str, object]], first: DataFrame) -> DataFrame:
    """Run (name, function) stages one after the other, each on what the one before wrote; finished ones are not run again.

    The names are fixed by the first run; a stage's output is written to a folder of its own, and counts once its version is put in force.
    """
    versions = Versions(spark, f"{path}/versions")
    names = [n for n, _ in stages]
    state = versions.read(versions.current()) or {"plan": names, "done": {}}
    if state["plan"] != names:
        raise ValueError(f"{path} was planned as {state['plan']}, not {names}")
    df = first
    for name, f in stages:
        if name not in state["done"]:
            folder = f"{name}-{uuid.uuid4().hex}"
            f(df).write.parquet(f"{path}/{folder}")
            state = state | {"done": state["done"] | {name: folder}}
            versions.put(versions.current() + 1, state)
        df = spark.read.parquet(f"{path}/{state['done'][name]}")
    return df
