"""Running sums and places in an order over any number of rows, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut, near


def running(rows: DataFrame, keys: list[str], order: list[str | Column], **sums: str | Column) -> DataFrame:
    """rows with, for each name in sums, that column's sum over the rows before in the order, within the keys.

    Rows are dealt out by ranges of (keys, order), so a hot key is split over tasks; each task sums its
    own rows, and the totals of the tasks before, a row for each task and key, are added. The order
    must be total, or rows that tie stand in any order.
    """
    by = [F.col(o) if isinstance(o, str) else o for o in order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = {f"_x{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(sums.values())}
    dealt = rows.withColumns(parts).repartitionByRange(n, *keys, *by).sortWithinPartitions(*keys, *by)
    dealt = cut(dealt.withColumn("_m", F.monotonically_increasing_id())).withColumn("_t", F.shiftright("_m", 33))
    inside = Window.partitionBy("_t", *keys).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = dealt.groupBy("_t", *keys).agg(*(F.sum(x).alias(x) for x in parts))
    base = totals.select("_t", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *(zero(F.sum(x).over(before)).alias("_b" + x) for x in parts))
    same = F.col("_t") == F.col("_t2")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = dealt.withColumns({"_s" + x: zero(F.sum(x).over(inside)) for x in parts}).join(base.withColumnRenamed("_t", "_t2"), same)
    return out.select(*rows.columns, *((F.col("_s" + x) + F.col("_b" + x)).alias(name) for x, name in zip(parts, sums, strict=True)))


def in_blocks(rows: DataFrame, by: str) -> DataFrame:
    """rows without repeats, dealt out by blocks, ranges of a column, with the block's number: grouping by block and more shuffles nothing."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(rows.repartitionByRange(4 * n, by).distinct().withColumn("block", F.spark_partition_id()))
    return ranged.repartition(4 * n, "block")


def placed_in_blocks(rows: DataFrame, key: str, level: str, by: str, name: str = "rank") -> DataFrame:
    """rows of in_blocks() with their place from 1 within the key, by falling level, then by the blocks' column.

    For rows of few distinct levels: each block counts its own, and the totals, a row for each block, key and level, are added.
    The rows stay where they are.
    """
    each = cut(rows.groupBy("block", key, level).agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(key).orderBy(F.desc(level), "block").rowsBetween(Window.unboundedPreceding, -1)
    base = cut(each.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    inside = Window.partitionBy("block", key, level).orderBy(by)
    return rows.withColumn("_i", F.row_number().over(inside)).join(near(base), ["block", key, level]).withColumn(name, F.col("_before") + F.col("_i")).drop("_before", "_i")


def placed(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """rows with their place from 1 within the keys."""
    return running(rows, keys, order, _before=F.lit(1)).withColumn(name, F.col("_before") + 1).drop("_before")
