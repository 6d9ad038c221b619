"""History of changing attributes: for each entity, the successive values and the period each was on record.

Method: affected-chain rebuild. A chain is all periods of one entity. When a batch of reports arrives, in whatever
order and however late, only the entities named in it are touched: their raw reports are retrieved, their chains are
built anew from all of them, and the new chains take the place of the old ones. ``HistoryTable`` keeps chains and raw reports in
buckets of entities; a batch adds its reports, writes the buckets it touches to a folder of its own, and then puts them in force
by one rename of the list of folders. A reader sees the old chains or the new ones, never a mixture; of two writers that
started from one version, the second fails and loses nothing.

A chain is read in order, so an entity with very many versions would make one long task. Its versions are cut into
slices of equal length; each slice is scanned on its own and hands over only its last known state and last values.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memloom.functions.keys import clean_id, micros
from memloom.operators.ranks import positions
from memloom.staging import scratch, stage
from memloom.storage import ConcurrentWrite, Versions

#: Versions of one entity that are scanned in one piece (parameter of ``build_chains``).
SLICE_ROWS = 50_000
#: Buckets of a history table (parameter of ``HistoryTable``): a batch rewrites those that hold an entity of it. A few thousand suit 100 TB.
BUCKETS = 32
#: What is kept of a report.
REPORT = ["log_id", "memory_id", "version", "state", "valid_from", "valid_to", "updated_at", "recorded_at"]


def versions(log: DataFrame) -> DataFrame:
    """One row for each (memory_id, updated_at): all reports of one version, folded.

    ``state`` is trimmed and lower-cased; null only if no report of the version has one. Of reports that disagree, the
    one recorded last counts (then the one with the larger ``log_id``). Rows without ``memory_id`` or ``updated_at``
    describe no version and are left out.
    """
    when = F.struct("recorded_at", "log_id")
    state = F.lower(clean_id("state"))
    return (
        log.select(clean_id("memory_id").alias("memory_id"), micros("updated_at").alias("started_us"), state.alias("state"), "valid_from", "valid_to", "version", when.alias("_w"))
        .where("memory_id is not null and started_us is not null")
        .groupBy("memory_id", "started_us")
        .agg(
            F.max_by("state", F.when(F.col("state").isNotNull(), F.col("_w"))).alias("state"),
            F.max_by(F.struct("valid_from", "valid_to"), F.col("_w")).alias("valid"),
            F.max("version").alias("version"),
        )
    )


def build_chains(found: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Chains of all entities in ``found`` (rows of ``versions``).

    Columns: memory_id, started_us, ended_us (null for the last), state, valid_from, valid_to, version (the largest
    version number reported in the period).
    """
    found = stage(found)
    sizes = found.groupBy("memory_id").agg(F.count("*").alias("_n")).where(F.col("_n") > slice_rows).select("memory_id")
    cut = found.withColumn("slice", F.lit(0).cast("long"))
    if sizes.limit(1).count():
        # Only entities with more versions than a slice holds are numbered.
        long = positions(found.join(sizes, "memory_id", "left_semi"), ["memory_id"], ["started_us"], "_at", base=0)
        cut = found.join(sizes, "memory_id", "left_anti").withColumn("slice", F.lit(0).cast("long")).unionByName(long.withColumn("slice", F.floor(F.col("_at") / slice_rows).cast("long")).drop("_at"))
    order = Window.partitionBy("memory_id", "slice").orderBy("started_us")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = cut.withColumns({"known": F.last("state", ignorenulls=True).over(so_far), "at": F.row_number().over(order)})

    # Slices after the first take the state and values that the slice before ends with. One row a slice, few in all.
    ends = filled.groupBy("memory_id", "slice").agg(F.max_by("known", "at").alias("last_known"), F.max_by("valid", "at").alias("last_valid"))
    before = Window.partitionBy("memory_id").orderBy("slice")
    carried = ends.select(
        "memory_id",
        "slice",
        F.last("last_known", ignorenulls=True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("carried_state"),
        F.lag("last_valid").over(before).alias("carried_valid"),
    ).where("slice > 0")
    full = filled.join(carried, ["memory_id", "slice"], "left").withColumn("state", F.coalesce("known", "carried_state"))
    values = F.struct("state", "valid.valid_from", "valid.valid_to")
    marked = full.withColumn("v", values).withColumn("prior", F.coalesce(F.lag("v").over(order), F.when(F.col("slice") > 0, F.struct(F.col("carried_state").alias("state"), F.col("carried_valid.valid_from").alias("valid_from"), F.col("carried_valid.valid_to").alias("valid_to")))))
    starts = marked.where(F.col("prior").isNull() | ~F.col("v").eqNullSafe(F.col("prior")))

    # The end of a period is the next start: within the slice, else the first start of a later slice.
    firsts = starts.groupBy("memory_id", "slice").agg(F.min("started_us").alias("_first"))
    after = firsts.select("memory_id", "slice", F.lead("_first").over(before).alias("_next"))
    ended = starts.join(after, ["memory_id", "slice"]).withColumn("ended_us", F.coalesce(F.lead("started_us").over(order), "_next"))
    return ended.select("memory_id", "started_us", "ended_us", "v.state", "v.valid_from", "v.valid_to", "version")


def rebuild_affected(chains: DataFrame, log: DataFrame, batch: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``chains`` with the chains of all entities in ``batch`` rebuilt from their raw reports in ``log`` and ``batch``.

    ``log`` is what had been received before ``batch``. Untouched chains are passed through, not read again.
    """
    touched = batch.select(clean_id("memory_id").alias("memory_id")).where("memory_id is not null").distinct()
    columns = ["log_id", "memory_id", "version", "state", "valid_from", "valid_to", "updated_at", "recorded_at"]
    raw = log.select(*columns).withColumn("memory_id", clean_id("memory_id")).join(touched, "memory_id", "left_semi").select(*columns)
    rebuilt = build_chains(versions(raw.unionByName(batch.select(*columns))), slice_rows)
    return chains.join(touched, "memory_id", "left_anti").unionByName(rebuilt)


def history(log: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """The history after the whole log, received as a first load and then one batch of what was recorded later.

    The first load is what was recorded in the first half of the log's time; what follows corrects and prolongs it, and
    replaces the chains it touches in a ``HistoryTable`` in the shared folder.
    Defined results: an empty log gives an empty history; repeated reports change nothing; states of white space
    are unknown; a version that changes neither state nor validity starts no period.
    """
    span = log.agg(F.min("recorded_at").alias("a"), F.max("recorded_at").alias("b")).first()
    if span is None or span.a is None:
        return build_chains(versions(log), slice_rows)
    middle = F.lit(span.a + (span.b - span.a) / 2)
    early = F.coalesce(F.col("recorded_at") <= middle, F.lit(True))
    table = HistoryTable(log.sparkSession, scratch(log.sparkSession, "history"), slice_rows=slice_rows)
    table.apply(log.where(early))
    table.apply(log.where(~early))
    return table.read()


class HistoryTable:
    """A history kept on storage; ``apply`` folds in a batch of reports and puts the chains it touches in force in one rename.

    ``path``/data holds folders of written buckets, each written once and never changed; ``path``/versions holds for each
    version the list of those in force: of the reports, all ever added; of the chains, for each bucket its folder.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, slice_rows: int = SLICE_ROWS):
        self.spark, self.path, self.buckets, self.slice_rows = spark, path.rstrip("/"), buckets, slice_rows
        self._versions = Versions(spark, f"{self.path}/versions")

    def current(self) -> int:
        """The number of the version in force; 0 if there is none."""
        return self._versions.current()

    def _listed(self, version: int) -> dict:
        return self._versions.read(version) or {"reports": [], "chains": {}}

    def _read(self, folders: list[str], kind: str, buckets: list[int] | None = None) -> DataFrame | None:
        """Written folders together, ``buckets`` of them only; None if there are none."""
        out = None
        for f in folders:
            part = self.spark.read.parquet(f"{self.path}/data/{f}/{kind}")
            part = part if buckets is None else part.where(F.col("bucket").isin(buckets))
            out = part if out is None else out.unionByName(part)
        return out

    def _chains(self, listed: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """The chains in force: of each folder, the buckets that are listed for it."""
        of: dict[str, list[int]] = {}
        for b, folder in listed["chains"].items():
            if buckets is None or int(b) in buckets:
                of.setdefault(folder, []).append(int(b))
        out = None
        for folder, its in of.items():
            part = self._read([folder], "chains", its)
            out = part if out is None else out.unionByName(part)
        return out

    def read(self) -> DataFrame | None:
        """The chains in force."""
        found = self._chains(self._listed(self.current()))
        return None if found is None else found.drop("bucket")

    def reports(self) -> DataFrame | None:
        found = self._read(self._listed(self.current())["reports"], "reports")
        return None if found is None else found.drop("bucket")

    def _write(self, df: DataFrame, folder: str, kind: str) -> None:
        # One more hash than the buckets have, so that a bucket with a long chain isn't one task's; a file a task and bucket.
        spread = df.repartition("bucket", F.pmod(F.xxhash64("memory_id", *df.columns[:1]), F.lit(8)))
        spread.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{self.path}/data/{folder}/{kind}")

    def apply(self, batch: DataFrame) -> int:
        """Returns the number of the new version. A crash before the rename leaves the old version in force.

        Raises ``ConcurrentWrite`` if another writer was first; then nothing of ``batch`` is in force.
        """
        n = self.current()
        listed, folder = self._listed(n), uuid.uuid4().hex
        bucket = F.pmod(F.xxhash64("memory_id"), F.lit(self.buckets)).cast("int")
        known = batch.select(*REPORT).withColumn("memory_id", clean_id("memory_id")).where("memory_id is not null").withColumn("bucket", bucket)
        self._write(known, folder, "reports")
        added = self.spark.read.schema(known.schema).parquet(f"{self.path}/data/{folder}/reports")
        touched = sorted(r.bucket for r in added.select("bucket").distinct().collect())
        before, chains = self._read(listed["reports"], "reports", touched), self._chains(listed, touched)
        if before is None or chains is None:
            new = build_chains(versions(added), self.slice_rows)
        else:
            new = rebuild_affected(chains.drop("bucket"), before.drop("bucket"), added.drop("bucket"), self.slice_rows)
        self._write(new.withColumn("bucket", bucket), folder, "chains")
        written = sorted(r.bucket for r in self.spark.read.parquet(f"{self.path}/data/{folder}/chains").select("bucket").distinct().collect()) if touched else []
        chains_now = {b: f for b, f in listed["chains"].items() if int(b) not in touched} | {str(b): folder for b in written}
        self._versions.put(n + 1, {"reports": listed["reports"] + [folder] * bool(touched), "chains": chains_now})
        return n + 1
