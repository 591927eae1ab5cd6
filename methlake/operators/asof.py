"""As-of join of two tables of any size: every left row with the last right row at or before it (or the first at or after).

Both sides are united and sorted into ranges of (keys, place). Inside a range the last right row is carried along; what a range
ends with is carried to the ranges behind it by a table of one row for each range and key. Nothing is gathered into arrays,
and a key that holds most of the rows is spread over many ranges.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F

from methlake.session import shared_dir


def asof_join(
    left: DataFrame, right: DataFrame, left_at: Column, right_at: Column, columns: list[str], keys: list[str] = [],  # noqa: B006
    direction: str = "backward", tie: str | None = None,
) -> DataFrame:
    """left with `columns` of its right row: of equal keys, the last with right_at <= left_at, or (forward) the first with
    right_at >= left_at; nulls where there is none. Of right rows at one place the greatest `tie` counts (forward: the least).

    A null place or key meets nothing. Columns of left named as in `columns` are replaced. Both places need one type.
    """
    if direction not in ("backward", "forward"):
        raise ValueError(f"direction {direction}: expected backward or forward")
    forward = direction == "forward"
    left = left.drop(*columns)
    named = [f"_k{i}" for i in range(len(keys))]
    key_columns = [F.col(k).alias(n) for k, n in zip(keys, named)]
    rank = F.col(tie) if tie else F.lit(0)
    rights = right.select(*key_columns, right_at.alias("_at"), F.lit(0).alias("_side"), rank.alias("_tie"), F.struct(*columns).alias("_hit")).filter(F.col("_at").isNotNull())
    lefts = left.select(*key_columns, left_at.alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"))
    both = rights.unionByName(lefts, allowMissingColumns=True)
    way = (lambda c: F.col(c).desc_nulls_first()) if forward else (lambda c: F.col(c).asc_nulls_first())
    order = [way("_at"), F.col("_side").asc(), way("_tie")]
    ranged = _stored(both.repartitionByRange(*named, *order).withColumn("_part", F.spark_partition_id()))

    before = Window.partitionBy("_part", *named).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.struct("_at", "_tie")
    last = (F.min_by if forward else F.max_by)("_hit", F.when(F.col("_side") == 0, nearest))
    earlier = Window.partitionBy(*named).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("_part", *named).agg(last.alias("_last"))
    ends = ends.select("_part", *named, F.last("_last", ignorenulls=True).over(earlier).alias("_carried"))
    near = ranged.withColumn("_near", F.last("_hit", ignorenulls=True).over(before)).filter("_side = 1")
    met = near.join(ends, ["_part", *named], "left")
    known = F.lit(True)
    for n in named:
        known = known & F.col(n).isNotNull()
    hit = F.when(known & F.col("_at").isNotNull(), F.coalesce("_near", "_carried"))
    return met.select("_row", hit.alias("_found")).select("_row.*", *[F.col("_found")[c].alias(c) for c in columns])


def _stored(df: DataFrame) -> DataFrame:
    """Written once: ranges are drawn from a sample, so two evaluations could cut them at other places."""
    path = f"{shared_dir(df.sparkSession)}/asof-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
