"""Row weights computed from the targets: leaf-balanced, scaled by how definite a label is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from methlake.functions.numeric import clip

TIE = 1e-6  # masses closer than this count as equal


@dataclass(frozen=True)
class RowBalance:
    power: float = 0.5
    lo: float = 0.3
    hi: float = 8.0
    mean: float = 1.0
    commit: float = 0.5
    certainty_power: float = 1.0


def top_two(targets: DataFrame, keys: list[str], leaf: str = "leaf", order: str = "leaf_idx", value: str = "q") -> DataFrame:
    """(keys, leaf, best, second): heaviest leaf (earliest on ties) and the mass of the runner-up.

    A row has no more parts than there are leaves, so they are gathered in one shuffle and ranked in place.
    """
    parts = F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("neg"), order, F.col(leaf).alias("leaf"))))
    gathered = targets.groupBy(*keys).agg(parts.alias("_parts"))
    first, second = F.get("_parts", F.lit(0)), F.get("_parts", F.lit(1))
    return gathered.select(
        *keys, first["leaf"].alias(leaf), (-first["neg"]).alias("best"), F.coalesce(-second["neg"], F.lit(0.0)).alias("second")
    )


def committed(tops: DataFrame, commit: float = 0.5) -> DataFrame:
    """Rows whose heaviest leaf holds the required mass and beats every other leaf."""
    return tops.filter((F.col("best") >= commit - TIE) & (F.col("best") > F.col("second") + TIE))


def leaf_weights(tops: DataFrame, leaves: DataFrame, cfg: RowBalance) -> DataFrame:
    """(leaf, n, weight): (median / n)^power, clipped; a leaf nobody commits to gets the upper limit."""
    counts = committed(tops, cfg.commit).groupBy("leaf").agg(F.count("*").alias("n"))
    median = counts.agg(F.coalesce(F.median("n"), F.lit(1.0)).alias("median"))
    ratio = F.pow(F.col("median") / F.col("n"), F.lit(cfg.power))
    return (
        leaves.join(counts, "leaf", "left")
        .crossJoin(median)  # one row
        .select(
            "leaf",
            F.coalesce("n", F.lit(0)).alias("n"),
            F.when(F.col("n").isNull(), F.lit(cfg.hi)).otherwise(clip(ratio, cfg.lo, cfg.hi)).alias("weight"),
        )
    )


def row_weights(targets: DataFrame, weights: DataFrame, cfg: RowBalance) -> DataFrame:
    """(row, weight) of training rows: sum of q * leaf weight, times (largest q)^certainty, mean rescaled."""
    raw = (
        targets.join(F.broadcast(weights.select("leaf", "weight")), "leaf")  # one row per leaf
        .groupBy("row")
        .agg((F.sum(F.col("q") * F.col("weight")) * F.pow(F.max("q"), F.lit(cfg.certainty_power))).alias("x"))
    )
    scale = raw.agg((F.lit(cfg.mean) * F.count("*") / F.sum("x")).alias("scale"))
    return raw.crossJoin(scale).select("row", (F.col("x") * F.col("scale")).alias("weight"))  # one row
