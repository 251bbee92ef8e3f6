"""Intermediate tables that several jobs read.

They are written, not cached: a table in shared storage outlives lost executors,
is read with column pruning, and has a size that the planner knows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SINGLE_PROCESS = re.compile(r"local(\[[^\]]*\])?$")


def staging_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir.

    Where none is named, a session that is one process on one machine uses its
    warehouse folder; any other session has to name a folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if SINGLE_PROCESS.match(spark.conf.get("spark.master", "")):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/staging"
    raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


#: Folders that each application has staged and not yet dropped.
_written: dict[str, list[str]] = {}


def written(spark: SparkSession) -> list[str]:
    """The folders staged by this application that are still there."""
    return _written.setdefault(spark.sparkContext.applicationId, [])


def new_table_path(spark: SparkSession, name: str) -> str:
    path = f"{staging_folder(spark)}/{name}-{uuid.uuid4().hex}"
    written(spark).append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    written(spark).remove(path)


def drop_staged(spark: SparkSession) -> None:
    """Remove all tables that this application has staged, once the results that read them are written."""
    for path in list(written(spark)):
        drop(spark, path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """For work whose result is staged last: the tables that it staged before are dropped at the end.

    Where the work fails, all of its tables are.
    """
    before, whole = set(written(spark)), False
    try:
        yield
        whole = True
    finally:
        made = [path for path in written(spark) if path not in before]
        for path in made[:-1] if whole else made:
            drop(spark, path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the staging folder and read it back."""
    path = new_table_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
