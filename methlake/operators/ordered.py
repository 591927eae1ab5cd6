"""Ordered scans that stay parallel when one group holds most of the rows.

A window over a huge group runs in one task. These operators cut each group into blocks of `block`
consecutive order values, scan inside blocks, and carry the (much smaller) block totals forward.
The order column is a non-negative integer, unique within its group, so a block never exceeds `block` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 65_536


def running_sum(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, block: int = BLOCK
) -> DataFrame:
    """Inclusive running sum of `value` per group, in `order`."""
    blocked = df.withColumn("_block", F.floor(F.col(order) / block).cast("bigint")).withColumn("_value", value)
    per_block = blocked.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    carried = per_block.withColumn(
        "_carry",
        F.coalesce(
            F.sum("_total").over(
                Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            ),
            F.lit(0),
        ),
    ).drop("_total")
    inside = F.sum("_value").over(
        Window.partitionBy(*keys, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        blocked.withColumn("_inside", inside)
        .join(carried, [*keys, "_block"])
        .withColumn(name, F.col("_inside") + F.col("_carry"))
        .drop("_block", "_value", "_inside", "_carry")
    )


def row_ordinal(df: DataFrame, keys: list[str], order: str, name: str, block: int = BLOCK) -> DataFrame:
    """Zero-based position of each row in its group, in `order`."""
    return running_sum(df, keys, order, F.lit(1).cast("bigint"), name, block).withColumn(name, F.col(name) - 1)


def merge_intervals(
    df: DataFrame, keys: list[str], start: str = "start", end: str = "stop", block: int = BLOCK
) -> DataFrame:
    """Sort by start and merge overlapping or touching intervals: one row per island.

    Equal starts are collapsed first, which makes `start` unique in its group. The running maximum of the
    ends is taken inside blocks of starts and carried across block summaries; islands are numbered the
    same way.
    """
    distinct = df.groupBy(*keys, start).agg(F.max(end).alias(end))
    blocked = distinct.withColumn("_block", F.floor(F.col(start) / block).cast("bigint"))
    before_blocks = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocked.groupBy(*keys, "_block")
        .agg(F.max(end).alias("_far"))
        .withColumn("_carry", F.max("_far").over(before_blocks))
        .drop("_far")
    )
    before_rows = Window.partitionBy(*keys, "_block").orderBy(start).rowsBetween(Window.unboundedPreceding, -1)
    reach = (
        blocked.withColumn("_near", F.max(end).over(before_rows))
        .join(carried, [*keys, "_block"])
        .withColumn("_reach", F.greatest("_near", "_carry"))
        .withColumn("_opens", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0))
        .select(*keys, start, end, "_opens")
    )
    numbered = running_sum(reach, keys, start, F.col("_opens").cast("bigint"), "island", block)
    return numbered.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end))


def last_per_group(df: DataFrame, keys: list[str], rank: Column, columns: list[str]) -> DataFrame:
    """Duplicates resolved in favour of the row of greatest `rank`."""
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*columns), rank).alias("_row"))
    return picked.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in columns])
