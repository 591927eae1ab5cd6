"""Sparse ternary features to class probabilities."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from methlake.model import network, weights as W
from methlake.model.artifact import Model


def sample_vectors(features: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, n_covered, plus, minus): probe indices called +1 and -1; no longer than the dictionary."""
    idx = F.col("probe_idx").cast("int")
    return features.filter("t != 0").groupBy(key).agg(
        F.count("*").alias("n_covered"),
        F.collect_list(F.when(F.col("t") > 0, idx)).alias("plus"),
        F.collect_list(F.when(F.col("t") < 0, idx)).alias("minus"),
    )


def signed_sums(terms: DataFrame, rank: int, key: str) -> DataFrame:
    """(key, z): the sum of t * w over the rows (key, t, w) of each key, w a vector of `rank` values.

    One running sum per component, combined before the only shuffle, so rows are never multiplied by the rank.
    """
    parts = [F.sum(F.col("t") * F.get("w", F.lit(k)).cast("double")).alias(f"_{k}") for k in range(rank)]
    return terms.groupBy(key).agg(*parts).select(key, F.array(*[f"_{k}" for k in range(rank)]).alias("z"))


def project(features: DataFrame, model: Model, key: str = "sample_id", samples: DataFrame | None = None) -> DataFrame:
    """(key, n_covered, z): every sample through the first matrix, which each worker reads once from the published table.

    samples: key; with it, exactly these samples come out, one without features as the empty vector.
    """
    vectors = sample_vectors(features, key)
    if samples is not None:
        none = F.array().cast("array<int>")
        vectors = samples.select(key).distinct().join(vectors, key, "left").select(
            key, F.coalesce("n_covered", F.lit(0).cast("bigint")).alias("n_covered"), F.coalesce("plus", none).alias("plus"), F.coalesce("minus", none).alias("minus")
        )
    path, kind = model.published, features.schema[key].dataType.simpleString()

    def run(batches):
        w0 = W.load(path, (network.FIRST,))[network.FIRST]
        for pdf in batches:
            z = [network.project(w0, p.astype(int), m.astype(int)) for p, m in zip(pdf["plus"], pdf["minus"])]
            yield pd.DataFrame({key: pdf[key], "n_covered": pdf["n_covered"], "z": z})

    return vectors.mapInPandas(run, f"{key} {kind}, n_covered bigint, z array<double>")


def predict(projected: DataFrame, model: Model, key: str = "sample_id") -> DataFrame:
    """(key, n_covered, head, temperature, logits, probs) of projected samples, one row per head."""
    path, depth, kind = model.published, model.depth, projected.schema[key].dataType.simpleString()
    heads = model.heads
    names = sorted({n for h in heads for n in network.trainable_names(h, depth)})
    calibrated = [h for h in heads if f"{h}_bin_centers" in model.shapes and f"{h}_log_temps" in model.shapes]
    names += [f"{h}_{part}" for h in calibrated for part in ("bin_centers", "log_temps")]

    def run(batches):
        w = W.load(path, tuple(names))
        for pdf in batches:
            if pdf.empty:
                continue
            z, n = np.stack(pdf["z"].to_numpy()), pdf["n_covered"].to_numpy(np.float64)
            for head in heads:
                logits, _ = network.forward(w, z, head, depth)
                t = np.ones(len(n))
                if head in calibrated:
                    nearest = np.abs(w[f"{head}_bin_centers"][None, :] - n[:, None]).argmin(1)
                    t = np.exp(w[f"{head}_log_temps"][nearest].astype(np.float64))
                yield pd.DataFrame({
                    key: pdf[key], "n_covered": pdf["n_covered"], "head": head, "temperature": t,
                    "logits": list(logits), "probs": list(network.softmax(logits, t[:, None]).astype(np.float32)),
                })

    return projected.mapInPandas(
        run, f"{key} {kind}, n_covered bigint, head string, temperature double, logits array<double>, probs array<float>"
    )


def nearest_temperature(n_covered: Column, centers: list[float], log_temps: list[float]) -> Column:
    """Temperature of the coverage bin whose centre is nearest, the first one on ties; 1 without bins."""
    if not centers:
        return F.lit(1.0)
    gaps = [F.struct(F.abs(F.lit(float(c)) - n_covered).alias("gap"), F.lit(i).alias("i")) for i, c in enumerate(centers)]
    return F.exp(F.element_at(F.array(*[F.lit(float(t)) for t in log_temps]), F.array_min(F.array(*gaps))["i"] + 1))
