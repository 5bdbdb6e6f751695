"""Ordering plans that stay distributed.

``global_row_number`` numbers rows in a total order without the single
partition that ``row_number().over(Window.orderBy(..))`` forces: one
range-partitioned sort, written with each row's task and place in it, then
per-task row counts (one row per task) turned into offsets. Both sides of the
offset join read the written table: two range exchanges would draw their own
bounds, and task numbers would not mean the same rows.

``top_k_per_group`` is a plain ranked window: Spark puts a group limit ahead
of the shuffle, so every task sends at most ``k`` rows of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palaver.plans.staging import stored

_PART_SHIFT = 33  # monotonically_increasing_id = partition index << 33 | row index


def global_row_number(df: DataFrame, order: list[Column], name: str = "row_number") -> DataFrame:
    """Add a 1-based position in the total order ``order`` (ties must not occur)."""
    tagged = stored(df.orderBy(*order)
                      .withColumn("_pid", F.spark_partition_id())
                      .withColumn("_idx", F.monotonically_increasing_id()
                                  - F.shiftleft(F.spark_partition_id().cast("long"), _PART_SHIFT)), "ordered")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    # one row per task of the sort: bounded by spark.sql.shuffle.partitions
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .withColumn(name, F.coalesce(F.col("_off"), F.lit(0)) + F.col("_idx") + 1)
                  .drop("_pid", "_idx", "_off"))


def top_k_per_group(df: DataFrame, group: list[str], order: list[Column], k: int,
                    name: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group by ``order`` (a total order)."""
    w = Window.partitionBy(*[F.col(g) for g in group]).orderBy(*order)
    return (df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
              .withColumn(name, F.col(name).cast("long")))
