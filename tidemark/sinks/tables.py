"""Output tables: the current forecast and the history of all runs.

The snapshot is a folder of versions and a small file that names the one to read. A run
writes its version beside the others and switches the name last, by a rename, so that
readers have the old forecast until the new one is whole, and keep it if a run dies.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import format_day, format_local, thousands

FORECAST_COLUMNS = ("entity", "latest_date", "level", "forecast_date", "forecast")


def stamped(scored: DataFrame, run_at: datetime | str) -> DataFrame:
    """The forecast with its run timestamp (UTC, without zone)."""
    moment = F.lit(str(run_at)).cast("timestamp_ntz")
    return scored.select(moment.alias("run_at"), *FORECAST_COLUMNS)


#: Names the current version of a snapshot. Spark's readers pass over such a name.
POINTER = "_current"


class _Folder:
    """A folder in whichever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
        self.jvm, self.fs_package = jvm, jvm.org.apache.hadoop.fs
        self.path = self.fs_package.Path(path)
        self.fs = self.path.getFileSystem(hadoop)
        self.context = self.fs_package.FileContext.getFileContext(self.fs.getUri(), hadoop)

    def at(self, name: str):
        return self.fs_package.Path(self.path, name)

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file under another name first; nobody sees half of it."""
        fresh = self.at(f"{name}-{uuid.uuid4().hex}")
        stream = self.fs.create(fresh)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        overwrite = self.jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(overwrite, 0, options.OVERWRITE)
        self.context.rename(self.fs.makeQualified(fresh), self.fs.makeQualified(self.at(name)), overwrite)

    def versions(self) -> list[str]:
        return [f.getPath().getName() for f in self.fs.listStatus(self.path) if f.isDirectory()]

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


def write_snapshot(scored: DataFrame, path: str, run_at: datetime | str) -> None:
    """Make this run's forecast the current one of the snapshot at `path`.

    The version before stays for readers that have begun; older ones, and what runs that
    died have left, are dropped once the new one is current. One run writes at a time.
    """
    version = f"version-{uuid.uuid4().hex}"
    stamped(scored, run_at).write.mode("errorifexists").parquet(f"{path}/{version}")
    folder = _Folder(scored.sparkSession, path)
    before = folder.read(POINTER)
    folder.replace(POINTER, version)
    for old in folder.versions():
        if old.startswith("version-") and old not in (version, before):
            folder.drop(old)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The current forecast in order of entity."""
    version = _Folder(spark, path).read(POINTER)
    if version is None:
        raise ValueError(f"no forecast was written to {path}")
    return spark.read.parquet(f"{path}/{version}").orderBy("entity")


def append_history(scored: DataFrame, path: str, run_at: datetime | str) -> None:
    """Add this run's forecast to the table at `path`, one partition per run.

    A run that is retried at the same `run_at` replaces its own rows.
    """
    rows = stamped(scored, run_at).withColumns(
        {"run_date": F.to_date("run_at"), "run": F.date_format("run_at", "'at' HH-mm-ss.SSSSSS")}
    )
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("run_date", "run").parquet(path)


def read_run_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs, the newest first, each in order of entity."""
    return spark.read.parquet(path).drop("run_date", "run").orderBy(F.desc("run_at"), "entity")


def presented(rows: DataFrame) -> DataFrame:
    """A forecast or history table as text: local run time, ISO days, grouped digits."""
    return rows.select(
        format_local(F.col("run_at")).alias("run_at"),
        "entity",
        format_day(F.col("latest_date")).alias("latest_date"),
        thousands(F.col("level")).alias("level"),
        format_day(F.col("forecast_date")).alias("forecast_date"),
        thousands(F.col("forecast")).alias("forecast"),
    )
