"""Read depth of a covered site: zero-truncated negative binomial, rescaled, as inverse-CDF tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# ---- fixed values ---------------------------------------------------------------------------------
MAX_DEPTH = 30
TABLE_BINS = 4096
# ---------------------------------------------------------------------------------------------------


def base_pmf(spark: SparkSession, mu: float, r: float) -> DataFrame:
    """(depth, p) for depth 1..30: proportional to gamma(d + r) / (gamma(r) d!) (1 - s)^d, s = r / (r + mu)."""
    d = F.col("depth")
    s = r / (r + mu)
    # log of the product of (k - 1 + r) / k * (1 - s) over k <= d, as an ordered fold
    log_p = F.aggregate(
        F.sequence(F.lit(1), d), F.lit(0.0), lambda acc, k: acc + F.ln((k - 1 + F.lit(r)) / k * F.lit(1 - s))
    )
    raw = spark.range(1, MAX_DEPTH + 1).select(F.col("id").cast("int").alias("depth")).withColumn("w", F.exp(log_p))
    total = raw.agg(F.sum("w").alias("total"))
    return raw.crossJoin(total).select("depth", (F.col("w") / F.col("total")).alias("p"))


def scaled_cdf(pmf: DataFrame, scales: list[float]) -> DataFrame:
    """(table, cdf): one array of 30 cumulative masses per scale; depth d moves to round(d * scale), kept in 1..30."""
    tables = [F.struct(F.lit(i).alias("table"), F.lit(float(s)).alias("scale")) for i, s in enumerate(scales)]
    moved = pmf.select("depth", "p", F.explode(F.array(*tables)).alias("t")).select("depth", "p", "t.*").select(
        "table",
        F.greatest(F.lit(1), F.least(F.lit(MAX_DEPTH), F.floor(F.col("depth") * F.col("scale") + 0.5).cast("int"))).alias("depth"),
        "p",
    )
    mass = moved.groupBy("table", "depth").agg(F.sum("p").alias("p"))
    per_table = mass.groupBy("table").agg(F.map_from_entries(F.collect_list(F.struct("depth", "p"))).alias("m"))
    grid = F.sequence(F.lit(1), F.lit(MAX_DEPTH))
    dense = F.transform(grid, lambda k: F.coalesce(F.element_at("m", k), F.lit(0.0)))
    return per_table.withColumn("dense", dense).select(
        "table",
        F.transform(
            grid,
            lambda k: F.aggregate(F.slice("dense", F.lit(1), k), F.lit(0.0), lambda a, x: a + x).cast("float"),
        ).alias("cdf"),
    )


def depth_table(cdfs: DataFrame) -> DataFrame:
    """(table, bin, depth): 4096 inverse-CDF bins per scale; depth = 1 + number of masses below the bin's centre."""
    u = (F.col("bin").cast("float") + F.lit(0.5).cast("float")) / F.lit(float(TABLE_BINS)).cast("float")
    return cdfs.select("table", "cdf", F.explode(F.sequence(F.lit(0), F.lit(TABLE_BINS - 1))).alias("bin")).select(
        "table",
        "bin",
        (
            F.lit(1) + F.size(F.filter(F.slice("cdf", 1, MAX_DEPTH - 1), lambda c: u.cast("float") > c))
        ).alias("depth"),
    )


def depth_bin(u: Column) -> Column:
    return F.least(F.floor(u * TABLE_BINS), F.lit(TABLE_BINS - 1)).cast("int")


def draw_depth(draws: DataFrame, table: DataFrame) -> DataFrame:
    """Depth of every draw (table, u) by an equality join on the table's bin."""
    return draws.withColumn("bin", depth_bin(F.col("u"))).join(table, ["table", "bin"]).drop("bin")
