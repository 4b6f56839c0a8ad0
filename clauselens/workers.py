"""How work reaches the executors: settings for Python stages, and rows from few splits."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def python_ready(spark: SparkSession) -> None:
    """Arrow batches bounded by rows and bytes, so that long texts can't fill a worker, and this
    package's folder on the workers' path (where it isn't installed)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, have) if x)


def spread(df: DataFrame) -> DataFrame:
    """df dealt out to all cores if its source has fewer splits than half of them (a small file of one
    row group); as it is otherwise, so a large table is never shuffled for this."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df
