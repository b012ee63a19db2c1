"""Running sums over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def running_sum(df: DataFrame, order: str, value: Column, out: str, width: int = 1 << 16) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all rows of smaller ``order`` (an integer key).

    Keys are cut into ranges of ``width``; the table of range totals, a
    ``width``-th of the key range, is summed first and joined back.
    """
    cut = df.withColumn("_range", F.floor(F.col(order) / width)).withColumn("_value", value)
    totals = cut.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.join(offsets, "_range").withColumn(out, F.col("_offset") + F.coalesce(F.sum("_value").over(inner), F.lit(0)))
    return summed.drop("_range", "_value", "_offset")


def numbered(df: DataFrame, group: str, order: list[Column], out: str) -> DataFrame:
    """Number rows from 0 by ``group`` (few or many values, ascending) and, inside
    a group, by ``order``: one row number per group plus the groups' offsets."""
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inner = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("_inner", F.row_number().over(inner) - 1).join(offsets, group).withColumn(out, F.col("_offset") + F.col("_inner")).drop("_inner", "_offset")
