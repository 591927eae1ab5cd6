"""Federated rounds: sites contribute summed gradients, a hub merges them, sites apply the patch."""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from methlake.model import gradients as G, network, weights as W
from methlake.model.artifact import LINEAGE, Model, load_model
from methlake.model.predict import project
from methlake.operators import tree as TR
from methlake.sources.files import copy, file_size, list_files, read_text, sha256_of, write_text
from methlake.sources.tensors import read_tensor_files, read_tensors, write_tensors

PREFIX = "grad."
NORM_TOLERANCE = 1e-3
OUTLIER = 10.0


def sidecar(path: str) -> str:
    """The JSON next to a tensor file."""
    stem, dot, _ = path.rpartition(".")
    return (stem if dot and "/" not in path[len(stem) :] else path) + ".json"


# ---- site -----------------------------------------------------------------------------------------


def class_masks(labels: DataFrame, model: Model, head: str, key: str = "sample_id") -> DataFrame:
    """(key, mask): indices of the classes a label allows, which are one class or all under a tree node."""
    classes = model.classes(head)
    expanded = TR.expand_labels(labels, model.nodes(), classes.select("class")).join(classes, "class", "left")
    unknown = F.raise_error(F.concat(F.lit("label is neither a class nor a tree node: "), F.first("label"))).cast("array<int>")
    found = F.sort_array(F.collect_set("class_idx"))
    return expanded.groupBy(key).agg(F.when(F.size(found) > 0, found).otherwise(unknown).alias("mask"))


def gradient_sums(projected: DataFrame, masks: DataFrame, model: Model, head: str, key: str = "sample_id") -> DataFrame:
    """Block table of gradients summed over all samples, and the (n, loss) sums under the name STATS."""
    path, depth, k = model.published, model.depth, len(model.class_names(head))
    names = tuple(network.trainable_names(head, depth))

    def run(batches):
        w, total = W.load(path, names), {}
        for pdf in batches:
            if pdf.empty:
                continue
            z, mask = np.stack(pdf["z"].to_numpy()), np.zeros((len(pdf), k))
            for i, allowed in enumerate(pdf["mask"]):
                mask[i, allowed.astype(int)] = 1.0
            logits, trace = network.forward(w, z, head, depth)
            loss, dlogits = network.set_nll(logits, mask)
            grads, _ = network.backward(w, trace, dlogits, head, depth)
            G.add_into(total, {**grads, G.STATS: np.array([len(pdf), loss])})
        if total:
            yield G.rows_of(total)

    return G.sum_blocks(projected.join(masks, key).select("z", "mask").mapInPandas(run, G.PARTS_SCHEMA))


def contribute(features: DataFrame, labels: DataFrame, model: Model, out: str, head: str | None = None) -> dict:
    """Write a site's update (gradients and sidecar). labels: sample_id, label. Returns the sidecar's content.

    Every labelled sample takes part, one without covered probes as the empty vector; features of others do not.
    """
    head = head or model.lineage.head
    sums = gradient_sums(project(features, model, samples=labels), class_masks(labels, model, head), model, head)
    table = W.publish(sums)
    written = model.spark.read.parquet(table)
    stats = written.filter(F.col("name") == G.STATS).first()
    if stats is None:
        raise ValueError("no labelled sample to learn from")
    n, loss = int(stats["values"][0]), stats["values"][1]
    grads = written.filter(F.col("name") != G.STATS).select(
        F.concat(F.lit(PREFIX), "name").alias("name"), "shape", "block", F.col("values").cast("array<float>").alias("values")
    )
    write_tensors(grads, out)
    counts = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}  # one row per class label
    meta = {
        "head": head,
        "base_sha256": sha256_of(model.weights),
        "n_samples": n,
        "label_counts": counts,
        "class_names": model.class_names(head),
        "loss": loss / n,
        "grad_norm": W.l2_norm(grads).first()["norm"],
    }
    write_text(sidecar(out), json.dumps(meta, indent=2))
    return meta


# ---- hub ------------------------------------------------------------------------------------------


def upper_median(values: DataFrame, column: str, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, median): the middle value, and of an even number the higher of the two in the middle."""
    return values.groupBy(*keys).agg(F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)").alias("median"))


def sum_updates(updates: DataFrame) -> DataFrame:
    """Element-wise sums over sites, in long form, of gradients (site, name, i, g)."""
    return updates.groupBy("name", "i").agg(F.sum("g").alias("g"))


def descend_weights(base: DataFrame, grads: DataFrame, scale: float) -> DataFrame:
    """Changed blocks only: w - g * scale. Both sides are block tables of the same names and shapes."""
    step = F.lit(scale).cast("float")
    moved = F.zip_with("values", "g", lambda w, g: (w - g.cast("float") * step).cast("float"))
    return base.join(grads.select("name", "block", F.col("values").alias("g")), ["name", "block"]).select(
        "name", "shape", "block", moved.alias("values")
    )


def replace_blocks(base: DataFrame, changed: DataFrame) -> DataFrame:
    return base.join(changed.select("name", "block"), ["name", "block"], "left_anti").unionByName(
        changed.select("name", "shape", "block", "values")
    )


def check_shapes(blocks: DataFrame, base: dict[str, tuple[int, ...]], what: str) -> None:
    for name, shape in W.shapes(blocks).items():
        if name not in base:
            raise ValueError(f"{what} carries {name}, which the model does not have")
        if base[name] != shape:
            raise ValueError(f"{what}: {name} is {shape}, the model has {base[name]}")


def _copy_rest(base: Model, target: str) -> None:
    for name in list_files(base.folder):
        if name != base.weights_name:
            copy(base.path(name), f"{target}/{name}")


def merge(
    spark: SparkSession, base: Model, updates: list[str], out: str, lr: float = 0.01, max_grad_norm: float = 0.0,
    patch: str | None = None,
) -> dict:
    """Check every update, step the weights against their sum, and write the new model folder (and a patch)."""
    base_sha, metas = sha256_of(base.weights), []
    for path in updates:
        meta = json.loads(read_text(sidecar(path)))
        if meta["base_sha256"] != base_sha:
            raise ValueError(f"{path} belongs to base {meta['base_sha256'][:12]}, not {base_sha[:12]}")
        if meta["class_names"] != base.class_names(meta["head"]):
            raise ValueError(f"{path}: class names differ from the base")
        if meta["n_samples"] == 0:
            raise ValueError(f"{path}: no samples")
        metas.append(meta)
    if not metas:
        raise ValueError("no updates")
    every = read_tensor_files(spark, updates).withColumnRenamed("file", "site")
    for r in every.filter("block = 0").select("site", "name", "shape").orderBy("site", "name").collect():  # tensors of the update files
        path, name = updates[r["site"]], r["name"].removeprefix(PREFIX)
        if name == r["name"]:
            raise ValueError(f"{path}: {name} is not a gradient")
        if base.shapes.get(name) != tuple(r["shape"]):
            raise ValueError(f"{path}: {name} is {tuple(r['shape'])}, the model has {base.shapes.get(name, 'none of this name')}")
    every = every.withColumn("name", F.expr(f"substr(name, {len(PREFIX) + 1})"))
    norms = {r["site"]: r["norm"] for r in W.l2_norm(every, ["site"]).collect()}  # one row per update file
    per_sample = []
    for i, (path, meta) in enumerate(zip(updates, metas)):
        norm = norms[i]
        if not math.isfinite(norm):
            raise ValueError(f"{path}: the gradient norm is not finite")
        if abs(norm - meta["grad_norm"]) > NORM_TOLERANCE * max(norm, 1.0):
            raise ValueError(f"{path}: declares a gradient norm of {meta['grad_norm']:.4f}, holds {norm:.4f}")
        per_sample.append(norm / meta["n_samples"])
        if 0 < max_grad_norm < per_sample[-1]:
            raise ValueError(f"{path}: gradient norm per sample {per_sample[-1]:.3f} exceeds {max_grad_norm:.3f}")
    median = sorted(per_sample)[len(per_sample) // 2]
    n = sum(m["n_samples"] for m in metas)
    doubled = every.withColumn("values", F.col("values").cast("array<double>")).drop("site")
    changed = spark.read.parquet(W.publish(descend_weights(base.blocks(), G.sum_blocks(doubled), lr / n)))
    _copy_rest(base, out)
    write_tensors(replace_blocks(base.blocks(), changed), f"{out}/{base.weights_name}", base.shapes)
    counts: dict[str, int] = {}
    for meta in metas:
        for label, c in meta["label_counts"].items():
            counts[label] = counts.get(label, 0) + c
    names = sorted(W.shapes(changed))
    federated = {
        "base_sha256": base_sha, "merged_updates": len(updates), "n_samples": n, "lr": lr,
        "heads_updated": sorted({m["head"] for m in metas}), "label_counts": counts, "tensors_changed": len(names),
        "per_sample_grad_norm": per_sample, "max_grad_norm": max_grad_norm, "new_sha256": sha256_of(f"{out}/{base.weights_name}"),
    }
    doc = json.loads(read_text(base.path(LINEAGE)))
    write_text(f"{out}/{LINEAGE}", json.dumps({**doc, "federated": federated}, indent=2, ensure_ascii=False))
    if patch:
        write_tensors(changed, patch)
        content = {
            "base_sha256": base_sha, "new_sha256": federated["new_sha256"], "tensors": names,
            "n_params": sum(int(np.prod(base.shapes[t])) for t in names), "federated": federated,
        }
        write_text(sidecar(patch), json.dumps(content, indent=2, ensure_ascii=False))
    outliers = [u for u, v in zip(updates, per_sample) if median > 0 and v > OUTLIER * median]
    return {**federated, "outliers": outliers}


def apply_patch(spark: SparkSession, base: Model, patch: str, out: str) -> Model:
    """Replace the tensors a hub moved and make sure the result is the hub's, bit for bit."""
    meta = json.loads(read_text(sidecar(patch)))
    have = sha256_of(base.weights)
    if have != meta["base_sha256"]:
        raise ValueError(f"the patch is for weights {meta['base_sha256'][:12]}; these are {have[:12]}")
    changed = read_tensors(spark, patch)
    check_shapes(changed, base.shapes, patch)
    _copy_rest(base, out)
    write_tensors(replace_blocks(base.blocks(), changed), f"{out}/{base.weights_name}", base.shapes)
    got = sha256_of(f"{out}/{base.weights_name}")
    if got != meta["new_sha256"]:
        raise ValueError(f"patching gave weights {got[:12]} where the hub has {meta['new_sha256'][:12]}: the result is not the hub's model")
    doc_name = "manifest.json" if file_size(base.path("manifest.json")) is not None else LINEAGE
    doc = json.loads(read_text(base.path(doc_name)))
    write_text(f"{out}/{doc_name}", json.dumps({**doc, "federated": meta["federated"]}, indent=2, ensure_ascii=False))
    return load_model(spark, out)
