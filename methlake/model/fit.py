"""Training on Spark: tables from the recipe, simulated examples per epoch, one gradient job per batch.

Parameters and optimiser moments live in block tables in the shared folder. A step reads a batch of examples, sums
gradients over tasks, and joins them with the parameters into the next table, so neither the corpus nor the model
passes through the driver and every step starts from stored data.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from methlake.model import gradients as G, network, weights as W
from methlake.operators import tree as TR
from methlake.session import shared_dir
from methlake.sources.codes import read_codes
from methlake.sources.files import remove_folder, write_text
from methlake.sources.tensors import BLOCK, BLOCKS_SCHEMA, write_tensors
from methlake.sources.training import Spec, count_probes, load_spec, load_tree, read_labels
from methlake.training import augment as AUG, balance as BAL, depth as DEPTH, purity as PUR, targets as TG

PARAMS = ("values", "m", "v")


@dataclass
class Tables:
    n_rows: int
    classes: list[str]
    n_probes: int
    corpus: DataFrame            # row, codes
    examples: DataFrame          # row, weight, log_q (array over classes): training rows only
    levels: np.ndarray           # nodes of all levels x classes, 0/1
    level_sizes: list[int]
    depth_tables: np.ndarray     # scales x inverse-CDF bins
    eligible: DataFrame | None   # row, mix (index of the purity block)
    bank: DataFrame | None       # mix, bank_idx, cum_weight, row, leaf, kind


class Store:
    """Tables of one run in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/fit-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"


# ---- tables ---------------------------------------------------------------------------------------


def build_tables(spark: SparkSession, spec: Spec, store: Store) -> Tables:
    tree = load_tree(spec.tree)
    nodes, leaves = tree.tables(spark)
    k, n_probes = len(tree.leaves), count_probes(spark, spec.probes)
    closure = TR.leaf_closure(nodes, tree.height())
    labels = store.keep(read_labels(spark, spec.labels), "labels")
    problem = TG.target_issues(labels, closure).first() or TG.row_order_issues(labels).first()
    if problem is not None:
        raise ValueError(f"{spec.labels}: row {problem['row']}: {problem.asDict().get('issue', 'rows are not 0..n-1 in order')}")
    n_rows = labels.count()
    corpus = read_codes(spark, spec.beta_u8, n_probes)
    if corpus.select("row").count() != n_rows:
        raise ValueError(f"{spec.beta_u8} and {spec.labels} differ in their number of rows")
    training = labels.filter("in_training = '1'")
    targets = store.keep(
        TG.normalised(TG.target_distribution(training, closure)).join(leaves.select("leaf", "leaf_idx"), "leaf"), "targets"
    )
    tops = store.keep(BAL.top_two(targets, ["row"]), "tops")
    weights = BAL.leaf_weights(tops, leaves.select("leaf"), spec.row_balance)
    weighed = BAL.row_weights(targets, weights, spec.row_balance)
    examples = store.keep(weighed.join(TG.log_target_rows(targets, weighed, k), "row"), "examples")
    rows = tree.level_rows()
    levels = np.zeros((len(rows), k), np.float32)
    for i, (_, _, members) in enumerate(rows):
        levels[i, members] = 1.0
    depths = [d for d, _, _ in rows]
    pmf = DEPTH.base_pmf(spark, spec.read_depth.mu, spec.read_depth.r)
    lut = DEPTH.depth_table(DEPTH.scaled_cdf(pmf, list(spec.read_depth.scales))).toPandas()  # scales x 4096 values
    grid = lut.pivot(index="table", columns="bin", values="depth").to_numpy()
    eligible, bank = _mixing(spec, tops, leaves, corpus, store)
    return Tables(
        n_rows, tree.leaves, n_probes, corpus, examples, levels, [depths.count(d) for d in sorted(set(depths))], grid, eligible, bank
    )


def _mixing(spec: Spec, tops: DataFrame, leaves: DataFrame, corpus: DataFrame, store: Store):
    """Eligible rows and background rows of every purity block."""
    banks, rows = [], []
    committed = BAL.committed(tops)
    for i, cfg in enumerate(spec.blocks()):
        known = {r["leaf"] for r in leaves.filter(F.col("leaf").isin(*cfg.immune_leaves, *cfg.tissue_leaves)).collect()}
        strangers = [x for x in (*cfg.immune_leaves, *cfg.tissue_leaves) if x not in known]
        if strangers:
            raise ValueError(f"purity block {i}: no such leaves: {strangers}")
        pool, cand = PUR.pools(committed, leaves, cfg)
        bank = store.keep(PUR.bank(pool, cfg), f"bank_{i}")
        if bank.isEmpty():
            raise ValueError(f"purity block {i} has nothing to mix with")
        fit = PUR.eligibility(corpus, pool, cand, cfg)
        rows.append(store.keep(fit.filter("eligible").select("row", F.lit(i).alias("mix")), f"eligible_{i}"))
        banks.append(bank.withColumn("mix", F.lit(i)))
    if not banks:
        return None, None
    every_row, every_bank = rows[0], banks[0]
    for r, b in zip(rows[1:], banks[1:]):
        every_row, every_bank = every_row.unionByName(r), every_bank.unionByName(b)
    return every_row, every_bank


# ---- examples -------------------------------------------------------------------------------------


def view(batches: DataFrame, spec: Spec, tables: Tables, seed: int, stream: str) -> DataFrame:
    """(row, coverage, plus, minus) of every planned pair. batches: row, coverage, depth (covered probes)."""
    cfg = AUG.AugmentConfig(
        spec.nano_prob, spec.probe_mask_prob, spec.read_error, tuple(spec.read_depth.weights), f"{seed}:{stream}"
    )
    keep_p = F.col("depth") / float(tables.n_probes) * (1.0 - spec.probe_mask_prob)
    draws = AUG.row_draws(batches, cfg, tables.n_probes).withColumn("keep_p", keep_p)
    if tables.eligible is None:
        mixed = draws.withColumn("purity", F.lit(1.0)).withColumn("bg_codes", F.lit(None).cast("binary"))
    else:
        settings = spec.blocks()
        purity = F.lit(1.0)
        for i, b in enumerate(settings):
            one = AUG.purity_of(draws, b.prob, b.pi_lo, b.pi_hi, eligible="eligible")
            purity = F.when(F.col("mix") == i, one).otherwise(purity)
        marked = draws.join(tables.eligible, "row", "left").withColumn("eligible", F.col("mix").isNotNull())
        placed = AUG.pick_background(marked.withColumn("purity", purity), tables.bank, ["mix"])
        # a profile is only fetched where it is mixed in
        wanted = placed.withColumn("bank_idx", F.when(F.col("purity") < 1, F.col("bank_idx")))
        profiles = tables.bank.join(tables.corpus, "row").select("mix", "bank_idx", F.col("codes").alias("bg_codes"))
        mixed = wanted.join(profiles, ["mix", "bank_idx"], "left")
    return AUG.simulate(mixed.join(tables.corpus, "row"), tables.depth_tables, replace(cfg, seed=_number(seed, stream)))


def _number(seed: int, stream: str) -> int:
    return (seed * 1_000_003 + sum(ord(c) * 257**i for i, c in enumerate(stream))) % (1 << 62)


def epoch_examples(spec: Spec, tables: Tables, epoch: int, store: Store, max_batches: int | None = None) -> tuple[DataFrame, int]:
    """The epoch's examples, stored by batch, and the number of batches."""
    size, seed = spec.optim.batch_size, spec.optim.seed
    pairs = AUG.coverage_pairs(tables.examples.select("row"), list(spec.coverage_levels))
    plan = AUG.epoch_batches(pairs, size, seed, epoch)
    if max_batches is not None:
        plan = plan.filter(F.col("batch") < max_batches)
    plan = store.keep(plan, f"plan_{epoch}")
    n = -(-plan.count() // size)
    pair = ["row", "coverage"]
    deep = view(plan.withColumn("depth", F.col("coverage").cast("double")), spec, tables, seed, f"deep{epoch}")
    whole = plan.join(deep, pair).join(tables.examples, "row")
    if spec.consistency is not None:
        u = AUG.uniform(f"{seed}:cons{epoch}", F.col("row"), F.col("coverage"))
        shallow = AUG.shallow_coverage(u, spec.consistency.lo, spec.consistency.hi, F.col("coverage"))
        other = view(plan.withColumn("depth", shallow), spec, tables, seed, f"shallow{epoch}")
        whole = whole.join(other.select(*pair, F.col("plus").alias("plus2"), F.col("minus").alias("minus2")), pair)
    return store.keep(whole.repartition("batch"), f"epoch_{epoch}", by="batch"), n


# ---- parameters -----------------------------------------------------------------------------------


def parameter_shapes(spec: Spec, k: int, n_probes: int) -> dict[str, tuple[int, ...]]:
    m, head = spec.model, spec.head
    shapes: dict[str, tuple[int, ...]] = {network.FIRST: (m.rank, n_probes)}
    width = m.rank
    for i, (lin, norm) in enumerate(network.stage_names(head, m.depth)):
        out = m.hidden if i <= m.depth else m.hidden // 2
        shapes |= {f"{lin}.weight": (out, width), f"{lin}.bias": (out,), f"{norm}.weight": (out,), f"{norm}.bias": (out,)}
        width = out
    return shapes | {f"heads.{head}.4.weight": (k, width), f"heads.{head}.4.bias": (k,)}


def initial_parameters(spark: SparkSession, shapes: dict[str, tuple[int, ...]], seed: int) -> DataFrame:
    """Kaiming-normal matrices, biases uniform within 1/sqrt(fan in), norms at one and zero, and zero moments.

    Every block draws from its own counter-based stream, so blocks are made in parallel and always alike.
    """
    plan = []
    for t, (name, shape) in enumerate(shapes.items()):
        matrix = shapes.get(name.rsplit(".", 1)[0] + ".weight", ())
        if len(shape) == 2:
            kind, scale = "normal", float(np.sqrt(2.0 / shape[1]))
        elif len(matrix) == 2:
            kind, scale = "uniform", float(1.0 / np.sqrt(matrix[1]))
        else:
            kind, scale = ("ones" if name.endswith(".weight") else "zeros"), 0.0
        n = int(np.prod(shape))
        plan += [(t, name, list(shape), b, kind, scale, min(BLOCK, n - b * BLOCK)) for b in range(-(-n // BLOCK))]
    rows = spark.createDataFrame(plan, "t int, name string, shape array<bigint>, block int, kind string, scale double, n int")

    def draw(batches):
        for pdf in batches:
            values = []
            for r in pdf.itertuples(index=False):
                g = np.random.Generator(np.random.Philox(key=[seed, (int(r.t) << 32) | int(r.block)]))
                if r.kind == "normal":
                    a = g.standard_normal(r.n) * r.scale
                elif r.kind == "uniform":
                    a = g.uniform(-r.scale, r.scale, r.n)
                else:
                    a = np.full(r.n, 1.0 if r.kind == "ones" else 0.0)
                values.append(a.astype(np.float32))
            yield pd.DataFrame({"name": pdf["name"], "shape": pdf["shape"], "block": pdf["block"], "values": values})

    drawn = rows.repartition(max(1, min(len(plan), 256))).mapInPandas(draw, BLOCKS_SCHEMA)
    zeros = F.transform("values", lambda _: F.lit(0.0).cast("float"))
    return drawn.select("*", zeros.alias("m"), zeros.alias("v"))


def adamw(params: DataFrame, grads: DataFrame, step: int, lr: float, betas: tuple[float, float], eps: float, wd: float,
          scale: float = 1.0, kind: str = "float") -> DataFrame:
    """The next parameter table: decoupled weight decay and bias-corrected moments, block by block."""
    b1, b2 = betas
    g = grads.select("name", "block", F.transform("values", lambda x: x * scale).alias("g"))
    kept = lambda c: c.cast(kind)
    # no gradient for a block is a gradient of zeros: moments fade and weights decay all the same
    g = params.select("name", "block", F.size("values").alias("n")).join(g, ["name", "block"], "left").select(
        "name", "block", F.coalesce("g", F.array_repeat(F.lit(0.0), F.col("n"))).alias("g")
    )
    moved = params.join(g, ["name", "block"]).select(
        "name", "shape", "block", "values",
        F.zip_with("m", "g", lambda m, x: kept(m * b1 + x * (1.0 - b1))).alias("m"),
        F.zip_with("v", "g", lambda v, x: kept(v * b2 + x * x * (1.0 - b2))).alias("v"),
    )
    push = F.zip_with("m", "v", lambda m, v: adam_push(m, v, step, b1, b2, eps))
    return moved.select(
        "name", "shape", "block", F.zip_with("values", push, lambda w, p: kept(w * (1.0 - lr * wd) - p * lr)).alias("values"), "m", "v"
    )


def adam_push(m, v, step: int, b1: float, b2: float, eps: float):
    """Bias-corrected direction of one parameter."""
    return (m / (1.0 - b1**step)) / (F.sqrt(v / (1.0 - b2**step)) + eps)


def batch_gradients(examples: DataFrame, params_path: str, spec: Spec, tables: Tables, seed: int) -> DataFrame:
    """Summed gradients of one batch and, under STATS, its summed losses."""
    head, depth, levels, cons = spec.head, spec.model.depth, tables.levels, spec.consistency
    n_probes, drop_p, temperature, lam = tables.n_probes, spec.model.dropout, spec.kd_temperature, spec.hier_level_weight
    dims = [spec.model.hidden] * (depth + 1) + [spec.model.hidden // 2]

    def dropout(rows, coverage, stream):
        """Factors per stage; each row has its own stream."""
        if drop_p <= 0:
            return None
        out = [np.empty((len(rows), d)) for d in dims]
        for i, (r, c) in enumerate(zip(rows, coverage)):
            u = np.random.Generator(np.random.Philox(key=[seed * 2 + stream, (int(r) << 20) ^ int(c)])).random(sum(dims))
            for o, part in zip(out, np.split(u, np.cumsum(dims)[:-1])):
                o[i] = np.where(part >= drop_p, 1.0 / (1.0 - drop_p), 0.0)
        return out

    def one_view(w, pdf, plus, minus, stream):
        idx = [(p.astype(int), m.astype(int)) for p, m in zip(pdf[plus], pdf[minus])]
        z = np.stack([network.project(w[network.FIRST], p, m) for p, m in idx])
        drop = dropout(pdf["row"], pdf["coverage"], stream)
        logits, trace = network.forward(w, z, head, depth, drop)
        return idx, drop, logits, trace

    def back(w, total, first, viewed, dlogits):
        idx, drop, _, trace = viewed
        grads, dz = network.backward(w, trace, dlogits, head, depth, drop)
        G.add_into(total, grads)
        first.add(dz, [p for p, _ in idx], [m for _, m in idx])

    def run(batches):
        w, total = W.load(params_path), {}
        first = G.Columns(network.FIRST, w[network.FIRST].shape[0], n_probes)  # only the probes that the task's examples have
        for pdf in batches:
            if pdf.empty:
                continue
            log_t, weight = np.stack(pdf["log_q"].to_numpy()).astype(np.float64), pdf["weight"].to_numpy(np.float64)
            deep = one_view(w, pdf, "plus", "minus", 0)
            other = one_view(w, pdf, "plus2", "minus2", 1) if cons else None
            loss, extra, dz, dz2 = network.training_loss(
                deep[2], log_t, weight, levels, temperature, lam, other[2] if cons else None,
                (weight > 0).astype(float), cons.weight if cons else 0.0,
            )
            back(w, total, first, deep, dz)
            if cons:
                back(w, total, first, other, dz2)
            G.add_into(total, {G.STATS: np.array([len(pdf), loss.sum(), extra.sum()])})
        if total:
            yield G.rows_of(total)
            yield first.rows()

    return G.sum_blocks(examples.mapInPandas(run, G.PARTS_SCHEMA))


# ---- runs -----------------------------------------------------------------------------------------


def train(spark: SparkSession, spec_dir: str, out: str, epochs: int | None = None, max_batches: int | None = None) -> list[dict]:
    """Run the recipe; writes the model each epoch, the log, and the settings. Returns the log."""
    spec, store = load_spec(spec_dir), Store(spark)
    tables = build_tables(spark, spec, store)
    shapes = parameter_shapes(spec, len(tables.classes), tables.n_probes)
    opt = spec.optim
    n_epochs = opt.epochs if epochs is None else epochs
    t_max = opt.sched_tmax if opt.sched_tmax > 0 else n_epochs
    store.keep(initial_parameters(spark, shapes, opt.seed), "step_0")
    step, log = 0, []
    for epoch in range(n_epochs):
        started = time.time()
        rate = opt.lr * 0.5 * (1.0 + np.cos(np.pi * epoch / t_max))
        examples, n_batches = epoch_examples(spec, tables, epoch, store, max_batches)
        tasks = spark.sparkContext.defaultParallelism
        seen = np.zeros(2)
        for b in range(n_batches):
            batch = examples.filter(F.col("batch") == b).repartition(min(tasks, opt.batch_size), "row")
            sums = store.keep(batch_gradients(batch, store.path(f"step_{step}"), spec, tables, opt.seed + step), f"sums_{step}")
            n, cls, cons = sums.filter(F.col("name") == G.STATS).first()["values"]
            params = spark.read.parquet(store.path(f"step_{step}"))
            grads = sums.filter(F.col("name") != G.STATS)
            store.keep(adamw(params, grads, step + 1, rate, opt.betas, opt.eps, opt.wd, 1.0 / n), f"step_{step + 1}")
            for old in (f"step_{step}", f"sums_{step}"):  # superseded by the table just stored
                remove_folder(store.path(old))
            step += 1
            seen += np.array([cls, cons]) / n
        cls, cons = seen / max(1, n_batches)
        log.append({
            "epoch": epoch, "total": float(cls + cons), "consistency": float(cons), "lr": float(rate),
            "wall_s": time.time() - started, spec.head: float(cls),
        })
        now = spark.read.parquet(store.path(f"step_{step}")).select("name", "shape", "block", "values")
        write_tensors(now, f"{out}/model.safetensors", shapes)
        write_text(f"{out}/log.json", json.dumps(log, indent=2))
        if (epoch + 1) % 10 == 0:
            write_tensors(now, f"{out}/epochs/model_ep{epoch + 1}.safetensors", shapes)
    m = spec.model
    settings = {
        "corpus": spec.corpus, "probes_in": tables.n_probes, "rank": m.rank, "hidden": m.hidden, "depth": m.depth,
        "dropout": m.dropout, "n_classes": {spec.head: len(tables.classes)}, "epochs": n_epochs, "n_rows": tables.n_rows,
        "n_params": int(sum(np.prod(s) for s in shapes.values())), "spec": spec.plain(),
    }
    write_text(f"{out}/config.json", json.dumps(settings, indent=2))
    return log


def check(spark: SparkSession, spec_dir: str, out: str | None = None, dump: str | None = None) -> Tables:
    """Build every table a run would use; `out` gets row weights, bank and eligible rows, `dump` the tables themselves."""
    spec, store = load_spec(spec_dir), Store(spark)
    tables = build_tables(spark, spec, store)
    if dump:
        tables.examples.write.mode("overwrite").parquet(f"{dump}/examples")
        level = spark.createDataFrame(
            [(i, int(c)) for i, r in enumerate(tables.levels) for c in np.flatnonzero(r)], "node int, leaf_idx int"
        )
        level.write.mode("overwrite").parquet(f"{dump}/levels")
        grid = [(t, row.tolist()) for t, row in enumerate(tables.depth_tables)]
        spark.createDataFrame(grid, "table int, depth array<bigint>").write.mode("overwrite").parquet(f"{dump}/depth")
    if out:
        tables.examples.select("row", "weight").write.mode("overwrite").json(f"{out}/row_weights")
        if tables.eligible is not None:
            tables.eligible.write.mode("overwrite").json(f"{out}/eligible")
            tables.bank.write.mode("overwrite").json(f"{out}/bank")
    return tables
