"""Point-in-interval join by coarse bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def with_bins(
    intervals: DataFrame, width: int, start: str = "ref_start", end: str = "ref_end", keep_empty: bool = False
) -> DataFrame:
    """One row per bin an interval [start, end) touches; with `keep_empty`, one of bin null where start is null.

    The bin of start - 1 is included: a reverse-strand read sees a site one base to its right.
    """
    explode = F.explode_outer if keep_empty else F.explode
    return intervals.withColumn(
        "bin",
        explode(
            F.sequence(
                F.floor((F.col(start) - 1) / width).cast("bigint"), F.floor((F.col(end) - 1) / width).cast("bigint")
            )
        ),
    )


def interval_join(
    intervals: DataFrame,
    points: DataFrame,
    width: int,
    on: Column,
    group: str = "contig",
    start: str = "ref_start",
    end: str = "ref_end",
    point: str = "pos",
    replicas: int = 1,
    how: str = "inner",
) -> DataFrame:
    """intervals x points within the same group for which `on` holds.

    A bare range condition is planned as a nested loop; an equality on (group, bin) lets Catalyst hash it,
    and AQE picks broadcast or sort-merge by the size it measures. Take `width` near the median interval
    length: an interval lands in about two bins, and a point lands in exactly one, so no pair repeats.
    `replicas` salts the intervals of a hot bin and repeats the (small) point side as often. With `how="left"`
    intervals without a point stay, once per bin.
    """
    left = with_bins(intervals, width, start, end, keep_empty=how != "inner")
    right = points.withColumn("_bin", F.floor(F.col(point) / width).cast("bigint")).withColumnRenamed(group, "_group")
    same = (F.col(group) == F.col("_group")) & (F.col("bin") == F.col("_bin"))
    if replicas > 1:
        left = left.withColumn("salt", F.pmod(F.xxhash64(start, end, "bin"), F.lit(replicas)).cast("int"))
        right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1))))
        same = same & (F.col("salt") == F.col("_salt"))
    return left.join(right, same & on, how).drop("bin", "salt", "_bin", "_group", "_salt")
