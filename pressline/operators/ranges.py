"""Prefix sums over a global order, without one window over all rows.

Rows are laid out in contiguous ranges of the order (``repartitionByRange``,
about ``rows_per_range`` rows each) and written once with their range number.
Range totals (one row per range) give each range its offset, and a window
inside each range finishes the sum. The number of ranges follows the number of
rows, so a task's share stays the same as the data grows. The order may be of
any sortable type; it should be unique, since equal keys share a range.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pressline.plans.stage import stage

ROWS_PER_RANGE = 1_000_000


def prefix_sums(df: DataFrame, order: Sequence[Column], value: Column, out: str,
                rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with ``out`` = sum of ``value`` (a whole number) over all rows
    before this one in ``order``. ``df`` is counted and then laid out, so it
    should be a staged table and hold only the columns that are needed."""
    ranges = max(1, math.ceil(df.count() / rows_per_range))
    laid = df.withColumn("_value", value.cast("bigint")).repartitionByRange(ranges, *order)
    ranged = stage(laid.withColumn("_range", F.spark_partition_id()), "ranges")
    if ranges == 1:
        before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return (ranged.withColumn(out, F.coalesce(F.sum("_value").over(before), F.lit(0)))
                      .drop("_value", "_range"))
    totals = ranged.groupBy("_range").agg(F.sum("_value").alias("_total"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)   # one row per range
    offsets = totals.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (ranged.withColumn(out, F.coalesce(F.sum("_value").over(inside), F.lit(0)))
                  .join(offsets, "_range")
                  .withColumn(out, F.col(out) + F.col("_offset"))
                  .drop("_value", "_range", "_offset"))
