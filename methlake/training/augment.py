"""Training examples from beta codes: which probes are kept, how deep they are read, what is called.

Row-level draws are columns of a counter-based uniform. The per-probe draws (hundreds of thousands per row)
run in one Arrow-batched function with a counter-based numpy generator per (seed, row, level), so a retried
task repeats them.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from methlake.functions.numeric import uniform
from methlake.operators.asof import asof_join
from methlake.operators.ordered import row_ordinal
from methlake.training.depth import TABLE_BINS
from methlake.training.purity import TOP_CODE


SHUFFLE_BLOCKS = 4096  # blocks an epoch's order is sorted in


@dataclass(frozen=True)
class AugmentConfig:
    nano_prob: float = 0.5
    probe_mask_prob: float = 0.0
    read_error: float = 0.0
    depth_weights: tuple[float, ...] = (1.0,)
    seed: int = 0


def coverage_pairs(rows: DataFrame, levels: list[int]) -> DataFrame:
    """Every training row at every coverage level (the level list is a short setting)."""
    return rows.withColumn("coverage", F.explode(F.array(*[F.lit(int(c)) for c in levels])))


def epoch_order(pairs: DataFrame, seed: int, epoch: int) -> Column:
    """Seeded shuffle key of an epoch."""
    return uniform(f"{seed}:{epoch}", F.col("row"), F.col("coverage"))


def epoch_batches(pairs: DataFrame, batch_size: int, seed: int, epoch: int) -> DataFrame:
    """Pairs in the epoch's shuffled order, cut into batches, of which the last may be smaller: adds `batch`.

    The order value is split into blocks, so no task ever sorts the whole epoch; only block totals are carried.
    """
    keyed = pairs.withColumn("_all", F.lit(0)).withColumn(
        "_key", (epoch_order(pairs, seed, epoch) * float(1 << 52)).cast("bigint")
    )
    ranked = row_ordinal(keyed, ["_all"], "_key", "_rank", block=(1 << 52) // SHUFFLE_BLOCKS)
    return ranked.withColumn("batch", F.floor(F.col("_rank") / batch_size)).drop("_all", "_key", "_rank")


def dropout_scale(u: Column, p: float) -> Column:
    """Factor of one activation: zero with probability p, else the inverse of the kept share."""
    return F.when(u >= p, 1.0 / (1.0 - p)).otherwise(0.0)


def cosine_rate(lr: float, epoch: Column, t_max: int) -> Column:
    return F.lit(lr) * 0.5 * (1 + F.cos(F.pi() * epoch / t_max))


def shallow_coverage(u: Column, lo: float, hi: float, own: Column) -> Column:
    """Log-uniform between lo and hi, never above the row's own level."""
    return F.least(F.exp(F.ln(F.lit(lo)) + (F.ln(F.lit(hi)) - F.ln(F.lit(lo))) * u), own.cast("double"))


def cumulative_index(u: Column, weights: tuple[float, ...]) -> Column:
    """Index of the weight interval u falls in."""
    edges = np.cumsum(np.asarray(weights, float) / sum(weights))[:-1]
    return sum([F.when(u >= float(e), 1).otherwise(0) for e in edges], F.lit(0))


def row_draws(pairs: DataFrame, cfg: AugmentConfig, n_probes: int) -> DataFrame:
    """Adds sequenced, table, keep_p and the raw draws u_mix, u_pi, u_bg."""
    key = (F.col("row"), F.col("coverage"))
    draw = lambda name: uniform(f"{cfg.seed}:{name}", *key)
    return pairs.select(
        "*",
        (draw("noise") < cfg.nano_prob).alias("sequenced"),
        cumulative_index(draw("scale"), cfg.depth_weights).alias("table"),
        (F.col("coverage") / float(n_probes) * (1.0 - cfg.probe_mask_prob)).alias("keep_p"),
        draw("mix").alias("u_mix"),
        draw("pi").alias("u_pi"),
        draw("bg").alias("u_bg"),
    )


def pick_background(draws: DataFrame, bank: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """Adds bank_idx: the first bank row whose cumulative weight reaches the draw, the last one at most.

    Draws and bank may be of any size. `keys` tell several banks apart, and a draw of no bank gets none.
    """
    top = bank.groupBy(*keys).agg(F.max(F.struct("cum_weight", "bank_idx")).alias("_top"))
    aimed = draws.drop("bank_idx").join(F.broadcast(top), keys, "left") if keys else draws.drop("bank_idx").crossJoin(top)  # one row a bank
    aimed = aimed.withColumn("_target", F.col("u_bg") * F.col("_top")["cum_weight"])
    found = asof_join(aimed, bank, F.col("_target"), F.col("cum_weight"), ["bank_idx"], keys, "forward", tie="bank_idx")
    return found.withColumn("bank_idx", F.coalesce("bank_idx", F.col("_top")["bank_idx"])).drop("_top", "_target")


def purity_of(draws: DataFrame, prob: float, pi_lo: float, pi_hi: float, eligible: str = "eligible") -> Column:
    """Tumour fraction of a row: below one only for eligible rows, with probability `prob`."""
    mixed = F.col(eligible) & (F.col("u_mix") < prob)
    return F.when(mixed, F.lit(pi_lo) + F.lit(pi_hi - pi_lo) * F.col("u_pi")).otherwise(F.lit(1.0))


def mix_beta(beta: Column, background: Column, purity: Column) -> Column:
    """purity * beta + (1 - purity) * background; a missing background keeps beta."""
    return F.when((purity < 1) & background.isNotNull(), purity * beta + (1 - purity) * background).otherwise(beta)


def noisy_beta(beta: Column, error: float) -> Column:
    return beta * (1 - error) + (1 - beta) * error


def majority(k: Column, depth: Column) -> Column:
    return F.signum((2 * k - depth).cast("double")).cast("tinyint")


def call_codes(codes: np.ndarray, background: np.ndarray | None, sequenced: bool, depths: np.ndarray, keep_p: float,
               purity: float, error: float, rng: np.random.Generator) -> np.ndarray:
    """Ternary calls of one profile. depths: the row's inverse-CDF table of TABLE_BINS read depths."""
    keep = (codes <= TOP_CODE) & (rng.random(len(codes)) <= keep_p)
    at = np.flatnonzero(keep)
    beta = (codes[at] + 0.5) / TOP_CODE
    if background is not None and purity < 1:
        bg = background[at]
        mixed = purity * beta + (1 - purity) * ((bg + 0.5) / TOP_CODE)
        beta = np.where(bg <= TOP_CODE, mixed, beta)
    out = np.zeros(len(codes), np.int8)
    if not sequenced:
        out[at] = np.sign(beta - 0.5)
        return out
    d = depths[(rng.random(len(at)) * TABLE_BINS).astype(int) % TABLE_BINS]
    k = rng.binomial(d, beta * (1 - error) + (1 - beta) * error)
    out[at] = np.sign(2 * k - d)
    return out


def simulate(examples: DataFrame, depth_tables: np.ndarray, cfg: AugmentConfig) -> DataFrame:
    """(row, coverage, plus, minus): probe indices called +1 and -1 of every example.

    examples: row, coverage, codes, sequenced, table, keep_p, purity, bg_codes (nullable).
    """
    tables, error, seed = np.asarray(depth_tables, np.int64), cfg.read_error, cfg.seed

    def run(batches):
        for pdf in batches:
            plus, minus = [], []
            for e in pdf.itertuples(index=False):
                rng = np.random.Generator(np.random.Philox(key=[seed, (int(e.row) << 20) ^ int(e.coverage)]))
                codes = np.frombuffer(e.codes, np.uint8).astype(np.int64)
                bg = None if e.bg_codes is None else np.frombuffer(e.bg_codes, np.uint8).astype(np.int64)
                x = call_codes(codes, bg, bool(e.sequenced), tables[e.table], e.keep_p, e.purity, error, rng)
                plus.append(np.flatnonzero(x > 0).astype(np.int32))
                minus.append(np.flatnonzero(x < 0).astype(np.int32))
            yield pd.DataFrame({"row": pdf["row"], "coverage": pdf["coverage"], "plus": plus, "minus": minus})

    columns = ["row", "coverage", "codes", "sequenced", "table", "keep_p", "purity", "bg_codes"]
    return examples.select(*columns).mapInPandas(run, "row bigint, coverage int, plus array<int>, minus array<int>")


