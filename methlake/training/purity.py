"""Background bank and eligibility for mixing tumour profiles with normal tissue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from methlake.functions.numeric import clip, uniform
from methlake.functions.reads import byte_at
from methlake.operators.ordered import row_ordinal

# ---- fixed values ---------------------------------------------------------------------------------
TOP_CODE = 250            # codes 0..250 are betas (code + 0.5) / 250; 255 is missing
MISSING_CODE = 255
SCORE_SOFTENER = 0.05
MIN_COVERED_MARKERS = 200  # more than this many are needed to place a candidate
# ---------------------------------------------------------------------------------------------------


# ---- fixed values: the defaults of a recipe's purity block are those below ------------------------
@dataclass(frozen=True)
class PurityConfig:
    prob: float
    pi_lo: float
    pi_hi: float
    immune_leaves: tuple[str, ...]
    tissue_leaves: tuple[str, ...]
    domains: tuple[int, ...]
    bank_size: int = 384
    immune_share: float = 0.70
    min_rows_per_leaf: int = 8
    max_immune_fraction: float = 0.20
    marker_probes: int = 4000
    min_target_peak: float = 0.99
    non_tumour_prefixes: tuple[str, ...] = ("Normal ", "Reactive ", "Non-neoplastic")
    seed: int = 0


def decode_beta(code):
    """Beta of a code column; null above the top code."""
    return F.when(code <= TOP_CODE, (code + 0.5) / float(TOP_CODE))


def explode_codes(corpus: DataFrame, columns: DataFrame | None = None) -> DataFrame:
    """(row, col, code) of a corpus (row, codes binary); with `columns` (col), only those are taken out.

    The column list is gathered into one array first (it is a bounded model choice), so a row of hundreds of
    thousands of codes is only unpacked where it is needed.
    """
    if columns is None:
        return corpus.select(
            "row", F.posexplode(F.regexp_extract_all(F.hex("codes"), F.lit("(..)"), F.lit(1))).alias("col", "h")
        ).select("row", "col", F.conv("h", 16, 10).cast("int").alias("code"))
    wanted = columns.agg(F.collect_set("col").alias("cols"))
    return corpus.crossJoin(wanted).select("row", F.explode("cols").alias("col"), "codes").select(
        "row", "col", byte_at(F.col("codes"), F.col("col")).alias("code")
    )


def bank(pool: DataFrame, cfg: PurityConfig) -> DataFrame:
    """(row, leaf, kind, cum_weight): rows drawn per leaf without replacement, in seeded hash order.

    pool: row, leaf, kind ('immune' / 'tissue'). Each kind's budget is split evenly over its leaves with enough
    rows. A per-group limit on a row number is pushed below the shuffle, so a leaf that holds most rows
    contributes only its picks.
    """
    spark = pool.sparkSession
    n_immune = int(cfg.bank_size * cfg.immune_share + 0.5)
    budgets = spark.createDataFrame(
        [("immune", 0, n_immune, cfg.immune_share), ("tissue", 1, cfg.bank_size - n_immune, 1 - cfg.immune_share)],
        "kind string, kind_rank int, budget int, share double",
    )
    sizes = pool.groupBy("kind", "leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= cfg.min_rows_per_leaf)
    per_kind = sizes.groupBy("kind").agg(F.count("*").alias("n_leaves")).join(budgets, "kind").select(
        "kind", "kind_rank", "share", F.greatest(F.lit(1), F.floor(F.col("budget") / F.col("n_leaves"))).alias("quota")
    )
    by_draw = Window.partitionBy("kind", "leaf").orderBy(uniform(cfg.seed, F.col("row")), "row")
    limited = (
        pool.withColumn("pick", F.row_number().over(by_draw))
        .filter(F.col("pick") <= cfg.bank_size)
        .join(sizes, ["kind", "leaf"])
        .join(per_kind, "kind")
        .filter(F.col("pick") <= F.col("quota"))
    )
    # from here on there are at most bank_size rows per leaf of a bounded leaf list
    order = Window.orderBy("kind_rank", "leaf", "row")
    kept = limited.withColumn("ord", F.row_number().over(order)).filter(F.col("ord") <= cfg.bank_size)
    weighed = kept.withColumn("w", F.col("share") / F.count("*").over(Window.partitionBy("kind")))
    return weighed.select(
        "row", "leaf", "kind", (F.col("ord") - 1).cast("int").alias("bank_idx"),
        F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("cum_weight"),
    )


def profile(codes: DataFrame) -> DataFrame:
    """(col, mean, sd): per column over the rows that cover it; population deviation. Codes are added as integers, so that
    the order of rows tells nothing: a beta is (2 code + 1) / (2 TOP_CODE)."""
    odd = F.when(F.col("code") <= TOP_CODE, 2 * F.col("code").cast("long") + 1)
    mean, square = (F.col(s) / F.col("n") / float((2 * TOP_CODE) ** p) for s, p in (("s1", 1), ("s2", 2)))
    return (
        codes.withColumn("odd", odd)
        .groupBy("col")
        .agg(F.count("odd").alias("n"), F.sum("odd").alias("s1"), F.sum(F.col("odd") * F.col("odd")).alias("s2"))
        .filter("n > 0")
        .select("col", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), square - mean * mean)).alias("sd"))
    )


def markers(background: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(col, mean_bg, mean_cand, score): the k columns that separate two profiles best."""
    both = background.select("col", F.col("mean").alias("mean_bg"), F.col("sd").alias("sd_bg")).join(
        candidates.select("col", F.col("mean").alias("mean_cand"), F.col("sd").alias("sd_cand")), "col"
    )
    score = F.abs(F.col("mean_bg") - F.col("mean_cand")) / (F.col("sd_bg") + F.col("sd_cand") + SCORE_SOFTENER)
    return both.withColumn("score", score).orderBy(F.desc("score"), "col").limit(k).select(
        "col", "mean_bg", "mean_cand", "score"
    )


def background_fraction(
    codes: DataFrame, marks: DataFrame, min_covered: int = MIN_COVERED_MARKERS
) -> DataFrame:
    """(row, fraction): where each row lies between the two means along the marker axis, in [0, 1].

    Rows with too few covered markers count as pure background.
    """
    axis = F.col("mean_bg") - F.col("mean_cand")
    sums = (
        codes.withColumn("b", decode_beta(F.col("code")))
        .join(marks, "col")
        .groupBy("row")
        .agg(
            F.sum((F.col("b") - F.col("mean_cand")) * axis).alias("num"),
            F.sum(F.when(F.col("b").isNotNull(), axis * axis)).alias("den"),
            F.count("b").alias("covered"),
        )
    )
    placed = (F.col("covered") > min_covered) & (F.col("den") > 0)
    return sums.select("row", F.when(placed, clip(F.col("num") / F.col("den"), 0, 1)).otherwise(F.lit(1.0)).alias("fraction"))


def pools(tops: DataFrame, leaves: DataFrame, cfg: PurityConfig) -> tuple[DataFrame, DataFrame]:
    """Background pool (row, leaf, kind) and tumour candidates (row, leaf).

    tops: committed training rows (row, leaf, best); leaves: leaf, domain.
    """
    kind = F.when(F.col("leaf").isin(*cfg.immune_leaves), "immune").when(F.col("leaf").isin(*cfg.tissue_leaves), "tissue")
    pool = tops.withColumn("kind", kind).filter("kind is not null").select("row", "leaf", "kind")
    normal = F.lit(False)
    for prefix in cfg.non_tumour_prefixes:
        normal = normal | F.col("leaf").startswith(prefix)
    tumour = leaves.filter(~normal & F.coalesce("domain", F.lit(-1)).isin(*cfg.domains)).select("leaf")
    cand = tops.filter(F.col("best") >= cfg.min_target_peak - 1e-6).join(tumour, "leaf").select("row", "leaf")
    return pool, cand


def eligibility(
    corpus: DataFrame, pool: DataFrame, cand: DataFrame, cfg: PurityConfig, min_covered: int = MIN_COVERED_MARKERS
) -> DataFrame:
    """(row, fraction, eligible) of every candidate. Profiles are sums over all rows of their group."""
    big = pool.filter("kind = 'immune'").groupBy("leaf").agg(F.count("*").alias("n")).filter(F.col("n") >= cfg.min_rows_per_leaf)
    immune = pool.filter("kind = 'immune'").join(big, "leaf").select("row")
    codes_of = lambda rows: explode_codes(corpus.join(rows, "row"))
    marks = markers(profile(codes_of(immune)), profile(codes_of(cand.select("row"))), cfg.marker_probes)
    codes = explode_codes(corpus.join(cand.select("row"), "row", "left_semi"), marks.select("col"))
    return background_fraction(codes, marks, min_covered).withColumn(
        "eligible", F.col("fraction") <= cfg.max_immune_fraction
    )
