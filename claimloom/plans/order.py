"""Global order without a single task: running totals over a range partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch


def running_before(df: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Add the total of ``value`` over all rows before each row in the given order, which must be unique.

    Rows are range-partitioned by the order, so partitions are balanced whatever the values; inside a partition a window runs, and the partitions'
    totals (one row each) are cumulated and broadcast.  The partitioned rows are written once, so that partition numbers stay what they are.
    """
    scratch = Scratch(df.sparkSession, "order")
    rows = scratch.write(df.withColumn("_v", value).repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranged")
    totals = rows.groupBy("_p").agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_p", F.coalesce(before, F.lit(0)).alias("_o"))
    inside = F.sum("_v").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.join(F.broadcast(offsets), "_p").withColumn(name, F.coalesce(inside, F.lit(0)) + F.col("_o")).drop("_p", "_v", "_o")


def running_within(df: DataFrame, by: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """``running_before`` within each value of ``by`` (few values): the global running total less that of the values before."""
    total = running_before(df, [F.asc(c) for c in by] + order, value, "_all")
    start = total.groupBy(*by).agg(F.min("_all").alias("_start"))
    return total.join(F.broadcast(start), by).withColumn(name, F.col("_all") - F.col("_start")).drop("_all", "_start") if by else total.withColumnRenamed("_all", name)
