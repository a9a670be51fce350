"""Staged tables, and a versioned table store with one writer."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None
_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or what SparkContext.setCheckpointDir was given.

    Only a local master, whose executors are this process, may do without: it gets a folder of its own.
    """
    global _own
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if (given := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        return given.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    _own = _own or "file://" + tempfile.mkdtemp(prefix="lattica-")
    return _own


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes the rows once to the shared folder and reads them back, which cuts the lineage.

    The files outlive every executor, so a lost one costs only the tasks that it was running.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_path = path
    return out


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for files of any format; drop_staged deletes it like a staged table."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small named file, through the file system that the path belongs to."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def get_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; where there is none, what build() gives is written there first."""
    if not exists(spark, f"{path}/_SUCCESS"):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again; what staged() didn't return is left alone."""
    for df in tables:
        if path := getattr(df, "_staged_path", None):
            _delete(df.sparkSession, path)
            if path in _written:
                _written.remove(path)


def drop_staged(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> int:
    """Deletes what this driver has staged (after mark `since`, but not `keep`); call it when the results that read it
    are written. Gives the number."""
    kept = getattr(keep, "_staged_path", None)
    gone = [p for p in _written[since:] if p != kept]
    for p in gone:
        _delete(spark, p)
        _written.remove(p)
    return len(gone)


def staged_mark() -> int:
    """How much is staged now, for drop_staged to go back to."""
    return len(_written)


class VersionedTables:
    """Named tables under one folder, a new version for each commit.

    A version is written in full before the commit row that names it; readers see the last committed one. The
    commit log is itself a table, so any store that Spark can write will do. Versions older than the last `keep` go.
    """

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep

    def version(self) -> int:
        log = f"{self.root}/_commits"
        return self.spark.read.parquet(log).agg(F.max("version")).first()[0] if exists(self.spark, log) else 0

    def commit(self, tables: dict[str, DataFrame]) -> int:
        v = self.version() + 1
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={v}")
        self.spark.range(1).select(F.lit(v).alias("version"), F.lit(",".join(tables)).alias("tables")).coalesce(1).write.mode("append").parquet(f"{self.root}/_commits")
        for name in tables:  # readers of the last `keep` versions are safe
            if v > self.keep and exists(self.spark, old := f"{self.root}/{name}/v={v - self.keep}"):
                _delete(self.spark, old)
        return v

    def read(self, name: str, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v={version or self.version()}")
