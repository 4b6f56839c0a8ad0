"""Cutting lineage in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (a local master, as in tests) a temporary
    folder is made and set. On a cluster that is an error, as executors would write to their own disks.
    """
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = f"file://{tempfile.mkdtemp(prefix='cut-')}"
        atexit.register(shutil.rmtree, at.removeprefix("file://"), ignore_errors=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that nothing will read again; one that isn't there is no error."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a cut table that are broadcast without asking the optimizer.
NEAR = 200_000


def near(df: DataFrame) -> DataFrame:
    """A table that was cut, broadcast in joins if it has few rows, so that the other side stays where it is; else as it is."""
    return F.broadcast(df) if df.count() <= NEAR else df


#: Ids that a task may have for files of its pairs to stay small: half of what a Parquet dictionary of 1 MB holds.
TILE = 65_536


def tiled(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """df dealt out by columns to as many tasks that each gets about TILE of so many rows, or ids, and every core one.

    For sides of joins that list many pairs. A Parquet column with more ids than its dictionary holds is written in full, pair by pair.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TILE)), *by)


def in_order(df: DataFrame, *by: str) -> DataFrame:
    """The rows of each task in an order that a join with a broadcast table keeps.

    The same run of ids then follows row after row, which compresses to a fraction. The optimizer drops a sort below a join
    unless a condition that it can't reason about, here always true, stands between.
    """
    return df.sortWithinPartitions(*by).where(F.monotonically_increasing_id() >= 0)


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder: lineage ends there, and a lost executor costs no recomputation.

    The shuffle files that the rows came from are removed at once, as nothing can need them again.
    """
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        return df.select("*").checkpoint()  # a new frame: the setting is read when a frame is made
    finally:
        spark.conf.set(CLEAN, before)
