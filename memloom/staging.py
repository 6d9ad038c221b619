"""Cutting lineage with tables written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: The setting by which Spark deletes the shuffle files of a query as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where it is unset, a folder of this process, if all of Spark runs in it; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="memloom-")
        _file_system(spark, _OWN[app])[0].deleteOnExit(_file_system(spark, _OWN[app])[1])
    return _OWN[app]


def _file_system(spark: SparkSession, path: str) -> tuple:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


@contextmanager
def _short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run in here leave no shuffle files behind; else those stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The files are on storage that every executor reaches, so a lost executor costs nothing but a re-read. The
    schema is given to the reader: no inference job, and no surprise on an empty table.
    """
    spark = df.sparkSession
    path = scratch(spark, "stage")
    with _short_shuffles(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_path = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared folder; its file system deletes it when the driver ends."""
    path = f"{shared_dir(spark)}/memloom/{name}-{uuid.uuid4().hex}"
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    return path


def drop(*tables: DataFrame | None) -> None:
    """Delete the files behind staged tables that no later plan reads."""
    for df in tables:
        path = getattr(df, "staged_path", None)
        if path:
            fs, p = _file_system(df.sparkSession, path)
            fs.delete(p, True)
            fs.cancelDeleteOnExit(p)
