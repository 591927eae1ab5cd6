"""Training inputs: the recipe, the class tree, labels and the probe list."""

from __future__ import annotations

import json
from dataclasses import MISSING, asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession, functions as F

from methlake.functions.parse import field, strict_uint
from methlake.operators.tree import ROOT
from methlake.sources.files import read_text
from methlake.sources.text import is_blank, read_lines, with_line_numbers
from methlake.training.balance import RowBalance
from methlake.training.purity import PurityConfig


@dataclass(frozen=True)
class ModelShape:
    rank: int
    hidden: int
    depth: int
    dropout: float


@dataclass(frozen=True)
class Optimiser:
    lr: float
    wd: float
    epochs: int
    sched_tmax: int
    batch_size: int
    seed: int
    betas: tuple[float, float]
    eps: float


@dataclass(frozen=True)
class Consistency:
    weight: float
    lo: float
    hi: float


@dataclass(frozen=True)
class ReadDepth:
    mu: float
    r: float
    scales: tuple[float, ...]
    weights: tuple[float, ...]


@dataclass(frozen=True)
class Spec:
    corpus: str
    beta_u8: str
    probes: str
    labels: str
    tree: str
    model: ModelShape
    optim: Optimiser
    kd_temperature: float
    hier_level_weight: float
    coverage_levels: tuple[int, ...]
    probe_mask_prob: float
    nano_prob: float
    read_error: float
    read_depth: ReadDepth
    row_balance: RowBalance
    head: str = "cell_origin"
    consistency: Consistency | None = None
    purity_mix: PurityConfig | None = None
    purity_mix_extra: tuple[PurityConfig, ...] = ()

    def blocks(self) -> list[PurityConfig]:
        return [b for b in (self.purity_mix, *self.purity_mix_extra) if b is not None]

    def plain(self) -> dict:
        return asdict(self)


def _strict(kind: type, doc: dict, where: str):
    """A settings object from a JSON object: no unknown keys, none missing, lists as tuples."""
    if not isinstance(doc, dict):
        raise ValueError(f"{where}: expected an object")
    known = {f.name: f for f in fields(kind)}
    unknown = sorted(set(doc) - set(known))
    absent = sorted(n for n, f in known.items() if n not in doc and f.default is MISSING)
    if unknown or absent:
        raise ValueError(f"{where}: unknown keys {unknown}, missing keys {absent}")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in doc.items()})


def load_spec(folder: str) -> Spec:
    doc = json.loads(read_text(f"{folder}/spec.json"))
    nested = {
        "model": ModelShape, "optim": Optimiser, "read_depth": ReadDepth, "row_balance": RowBalance,
        "consistency": Consistency, "purity_mix": PurityConfig,
    }
    for key, kind in nested.items():
        if doc.get(key) is not None:
            doc[key] = _strict(kind, doc[key], key)
    doc["purity_mix_extra"] = [_strict(PurityConfig, b, "purity_mix_extra") for b in doc.get("purity_mix_extra") or []]
    for key in ("beta_u8", "probes", "labels", "tree"):
        if key in doc and not doc[key].startswith("/") and "://" not in doc[key]:
            doc[key] = f"{folder}/{doc[key]}"
    spec = _strict(Spec, doc, "spec.json")
    domains = [d for b in spec.blocks() for d in b.domains]
    if len(set(domains)) != len(domains):
        raise ValueError("a domain is named by two purity blocks")
    if spec.purity_mix_extra and spec.purity_mix is None:
        raise ValueError("purity_mix_extra is given without purity_mix")
    if not spec.read_depth.scales or len(spec.read_depth.scales) != len(spec.read_depth.weights):
        raise ValueError("read_depth: scales and weights must pair up")
    return spec


@dataclass
class ClassTree:
    leaves: list[str]
    nodes: list[tuple[str, str]]  # (node, parent) in document order, the top node under ROOT
    domains: dict[str, int]

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        """nodes (node, parent, ord) and leaves (leaf, leaf_idx, domain)."""
        nodes = spark.createDataFrame([(n, p, i) for i, (n, p) in enumerate(self.nodes)], "node string, parent string, ord int")
        leaves = spark.createDataFrame(
            [(leaf, i, self.domains.get(leaf)) for i, leaf in enumerate(self.leaves)], "leaf string, leaf_idx int, domain int"
        )
        return nodes, leaves

    def height(self) -> int:
        parent = dict(self.nodes)

        def level(n: str) -> int:
            return 0 if n == ROOT else 1 + level(parent[n])

        return max(map(level, parent))

    def level_rows(self) -> list[tuple[int, str, list[int]]]:
        """(depth, node, leaf indices) of every node below the top that holds a leaf, per depth in document order."""
        parent, at = dict(self.nodes), {}
        for i, leaf in enumerate(self.leaves):
            trail = [leaf]
            while parent.get(trail[-1], ROOT) != ROOT:
                trail.append(parent[trail[-1]])
            for depth, node in enumerate(reversed(trail[:-1]), 1):
                at.setdefault((depth, node), []).append(i)
        order = {n: i for i, (n, _) in enumerate(self.nodes)}
        return [(d, n, at[d, n]) for d, n in sorted(at, key=lambda k: (k[0], order.get(k[1], -1)))]


def load_tree(path: str) -> ClassTree:
    doc = json.loads(read_text(path))
    nodes = [(n, p or ROOT) for n, p in doc["nodes"].items()]
    return ClassTree(list(doc["leaves"]), nodes, {k: int(v) for k, v in (doc.get("leaf_domain") or {}).items()})


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(row, line, target, in_training) of a labels table with named columns; rows of another width are an error."""
    lines = read_lines(spark, path)
    header = spark.read.text(path).first()
    names = header["value"].split("\t") if header else []
    absent = [c for c in ("row", "target", "in_training") if c not in names]
    if absent:
        raise ValueError(f"{path}: no columns {absent}")
    f = F.split("line", "\t")
    numbered = with_line_numbers(lines, lines).filter("line_no > 1 and line != ''")
    width = F.raise_error(
        F.concat(F.lit(f"{path}: {len(names)} fields expected at line "), F.col("line_no").cast("string"))
    ).cast("string")
    return numbered.select(
        strict_uint(field(f, names.index("row"))).alias("row"),
        (F.col("line_no") - 2).alias("line"),
        F.when(F.size(f) != len(names), width).otherwise(F.trim(field(f, names.index("target")))).alias("target"),
        F.trim(field(f, names.index("in_training"))).alias("in_training"),
    )


def count_probes(spark: SparkSession, path: str) -> int:
    """Lines of a probe list after its header."""
    lines = read_lines(spark, path)
    n = with_line_numbers(lines, lines).filter((F.col("line_no") > 1) & ~is_blank(F.col("line"))).count()
    if n == 0:
        raise ValueError(f"the probe list {path} is empty")
    return n
