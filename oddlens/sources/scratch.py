"""Tables between jobs, written to the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; where that is unset, on one machine only (tests), a temporary one is set."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="oddlens-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Queries that are planned within delete their shuffle files when they end, not when the driver's heap is collected."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


@contextmanager
def setting(spark: SparkSession, key: str, value: str | int) -> Iterator[None]:
    """Queries that are run within have this setting; the session's own comes back after."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batch_limits(spark: SparkSession, rows: int):
    """Queries that are run within send so many rows at a time to Python."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage, fixes row ids and random draws, survives lost executors.

    The shuffle files of the write go with it: what is left on disk is the table.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{uuid.uuid4().hex}"
    with _shuffles_deleted(spark):
        df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.settled_at = path
    return found


def discard(*tables: DataFrame) -> None:
    """Delete settled tables once everything made of them is settled too."""
    for df in tables:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.settled_at)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def with_row_id(df: DataFrame, name: str = "id") -> DataFrame:
    """A fixed long id for each row, for tables whose keys aren't unique."""
    return settle(df.withColumn(name, F.monotonically_increasing_id()))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
