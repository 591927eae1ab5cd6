"""Connected components of a link table by alternating star joins.

Every round hooks each node's neighbours to the least node it sees (large star, then small star); rounds end when the links
no longer change. Links stay rows of Spark tables, stored in the shared folder after every round. A node with very many
links is aggregated before the shuffle, and its rows in the join can be split by AQE.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methlake.llm.shared import stored


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a").agg(F.min("b").alias("least"))


def components(links: DataFrame) -> DataFrame:
    """links: a, b (comparable, not null). Returns node, root for every linked node; root is its component's least node."""
    now = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or tuple(state) == seen:
            break
        seen = tuple(state)
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = both.join(_least(both).select("a", F.least("a", "least").alias("least")), "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
        down = large.distinct()  # every row points to a smaller node
        least = _least(down)
        small = down.join(least, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(least.select("a", F.col("least").alias("b")))
        now = stored(small.distinct(), "links")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
