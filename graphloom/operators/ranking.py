"""Prefix sums and dense numbers over ids, without one task that sees all rows.

Ids are cut into blocks of consecutive values.  Blocks are summed on their own, a running sum over
the few blocks gives each block's offset, and a window inside each block does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def prefix_sum(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """df with ``out``: the sum of value over all rows with a smaller key.  Keys are distinct longs from 0."""
    block = F.floor(F.col(key) / BLOCK)
    blocked = df.withColumn("_block", block)
    totals = blocked.groupBy("_block").agg(F.sum(value).alias("_sum"))
    offsets = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return blocked.join(offsets, "_block").withColumn(out, F.col("_base") + inside).drop("_block", "_base")


def dense_numbers(df: DataFrame, key: str, out: str) -> DataFrame:
    """Distinct keys (longs from 0) with their place, from 0, in ascending order."""
    return prefix_sum(df.select(key).distinct().withColumn("_one", F.lit(1).cast("long")), key, "_one", out).drop("_one")
