"""Places of rows inside ordered groups of any size, and keys of groups that are never null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwork.llm.common import cut


def group_key(c: Column) -> Column:
    """A string for each value, null included, in the bytewise order of the values' strings with null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def number(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``index`` (from 0, inside ``group`` by ``order``, nulls first) and ``size`` (rows of the group), both long.

    Rows are sorted into ranges of (group, order, row number), so that a group of any size, or of any number of equal rows, lies
    in many slices. Rows are numbered inside each slice and group; the counts of (group, slice), at most one per group and
    slice, give where each slice begins. ``rows`` must not have columns named tie, slice, place, before, index or size.
    """
    tied = cut(rows.withColumn("tie", F.monotonically_increasing_id()))
    keys = [group, *order, "tie"]
    sliced = tied.repartitionByRange(*(F.col(c).asc_nulls_first() for c in keys)).withColumn("slice", F.spark_partition_id())
    within = Window.partitionBy(group, "slice")
    local = cut(sliced.withColumn("place", F.row_number().over(within.orderBy(*(F.col(c).asc_nulls_first() for c in keys[1:])))))
    counts = local.groupBy(group, "slice").agg(F.count(F.lit(1)).alias("n"))
    groups = Window.partitionBy(group)
    starts = counts.select(
        F.col(group).alias("of"),
        F.col("slice").alias("at"),
        F.coalesce(F.sum("n").over(groups.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(groups).alias("size"),
    )
    placed = local.join(starts, (F.col(group) == F.col("of")) & (F.col("slice") == F.col("at")))
    return placed.withColumn("index", F.col("before") + F.col("place") - 1).drop("of", "at", "before", "place", "slice", "tie")
