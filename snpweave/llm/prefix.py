"""Distributed running totals: a window inside each chunk, and one small table of chunk totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, value: str, chunk: str, order: list[str], out: str) -> DataFrame:
    """Add `out`: the sum of `value` over all rows before this one, by chunk and then by `order`.

    Chunks are a data column (not a task number), so the same rows give the same totals after a retry.
    """
    inside = Window.partitionBy(chunk).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(chunk).agg(F.sum(value).alias("__total"))
    before = totals.select(chunk, F.coalesce(F.sum("__total").over(Window.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("__before"))
    here = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    return here.join(before, chunk).withColumn(out, F.col("__inside") + F.col("__before")).drop("__inside", "__before")


def running_total_in(df: DataFrame, value: str, group: list[str], chunk: str, order: list, out: str) -> DataFrame:
    """`running_total` that begins anew in each group: by chunk inside the group and then by `order`, so that a group that
    holds most rows is still summed by many tasks. Group and chunk columns hold no nulls."""
    keys = [*group, chunk]
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys).agg(F.sum(value).alias("__total"))
    before = totals.select(*keys, F.coalesce(F.sum("__total").over(earlier), F.lit(0)).cast("long").alias("__before"))
    here = df.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)).cast("long"))
    return here.join(before, keys).withColumn(out, F.col("__inside") + F.col("__before")).drop("__inside", "__before")
