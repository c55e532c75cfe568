"""Running sums and places in an order, without a task that sees a whole group.

Rows are dealt to ranges of the order and written; a range's sum for each group is one row, and what stands before a
range is the sum of those. A group of any size is split as its ranges are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import written


def running(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """df with the sum of value over the rows of its group up to each row, itself included; no null keys or order."""
    ranges = df.withColumn("_value", value).repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn("_range", F.spark_partition_id())
    dealt = written(ranges, "ordered")
    sums = dealt.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))  # a row for each group, and one more for each range
    before = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1) if keys else W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*keys, "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    local = F.sum("_value").over(W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return dealt.withColumn(name, local).join(starts, [*keys, "_range"]).withColumn(name, F.col(name) + F.col("_before")).drop("_value", "_range", "_before")


def placed(df: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """df with each row's place in its group, from 0."""
    return running(df, keys, order, F.lit(1), name).withColumn(name, F.col(name) - 1)
