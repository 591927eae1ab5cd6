"""A model folder: `lineage.json` (classes, tree, thresholds, alerts), one `.safetensors` file, probe maps."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from methlake.model import network, weights as W
from methlake.operators.references import PROBE_FILE, T2T
from methlake.operators.tree import ROOT
from methlake.sources.files import file_size, list_files, read_text
from methlake.sources.tensors import read_tensor_header, read_tensors
from methlake.sources.text import read_probe_bed

# Names inside a model folder
LINEAGE, TENSORS = "lineage.json", ".safetensors"
DEFAULT_HEAD = "cell_origin"


@dataclass
class Lineage:
    name: str
    version: str
    head: str
    classes: list[str]                      # in output order
    nodes: list[tuple[str, str]]            # (node, parent), document order
    thresholds: dict[int, float] = field(default_factory=dict)
    alerts: list[tuple[str, float, str | None]] = field(default_factory=list)

    def children(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for node, parent in self.nodes:
            out.setdefault(parent, []).append(node)
        return out


def parse_lineage(text: str) -> Lineage:
    doc = json.loads(text)
    out = Lineage(
        doc["name"], doc["version"], doc.get("head", DEFAULT_HEAD), list(doc["leaves"]), [],
        {int(d): float(t) for d, t in (doc.get("descent_thresholds") or {}).items()},
    )
    seen = {ROOT}
    pending = [(n, ROOT) for n in reversed(doc["hierarchy"])]
    while pending:
        node, parent = pending.pop()
        name, kids, alert = node["name"], node.get("children") or [], node.get("alert")
        if name in seen:
            raise ValueError(f"{LINEAGE}: node {name!r} appears twice")
        seen.add(name)
        out.nodes.append((name, parent))
        if alert:
            if kids:
                raise ValueError(f"{LINEAGE}: alert on the inner node {name!r}")
            out.alerts.append((name, float(alert["p_min"]), alert.get("note")))
        pending.extend((k, name) for k in reversed(kids))
    inner = {p for _, p in out.nodes}
    missing = sorted({n for n, _ in out.nodes} - inner - set(out.classes))
    if missing:
        raise ValueError(f"{LINEAGE}: leaves that are no output class: {missing}")
    return out


@dataclass
class Model:
    spark: SparkSession
    folder: str
    lineage: Lineage
    weights_name: str

    @property
    def weights(self) -> str:
        return self.path(self.weights_name)

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    @cached_property
    def shapes(self) -> dict[str, tuple[int, ...]]:
        return {n: tuple(e["shape"]) for n, e in read_tensor_header(self.weights)[0].items()}

    @cached_property
    def published(self) -> str:
        """The weights as a block table in the shared folder."""
        return W.publish(self.blocks())

    def blocks(self) -> DataFrame:
        return read_tensors(self.spark, self.weights)

    @property
    def heads(self) -> list[str]:
        return network.head_names(self.shapes)

    @property
    def depth(self) -> int:
        return network.trunk_depth(self.shapes)

    @property
    def n_probes(self) -> int:
        return self.shapes[network.FIRST][1]

    def class_names(self, head: str) -> list[str]:
        if head != self.lineage.head:
            raise ValueError(f"the model names no classes of head {head!r}")
        return self.lineage.classes

    def nodes(self) -> DataFrame:
        return self.spark.createDataFrame(self.lineage.nodes, "node string, parent string")

    def classes(self, head: str) -> DataFrame:
        rows = [(c, i) for i, c in enumerate(self.class_names(head))]
        return self.spark.createDataFrame(rows, "class string, class_idx int")

    def dictionary(self) -> DataFrame:
        """The features, in the order the network takes them."""
        return read_probe_bed(self.spark, self.path(PROBE_FILE[T2T]))

    def assemblies(self) -> list[str]:
        """Assemblies the folder has a probe map for."""
        return [a for a, f in PROBE_FILE.items() if file_size(self.path(f)) is not None]

    def check(self) -> None:
        """The weights fit the dictionary, and every tensor the network reads is there."""
        if not self.heads:
            raise ValueError(f"{self.weights}: no output heads")
        wanted = [network.FIRST, *(n for h in self.heads for n in network.trainable_names(h, self.depth))]
        absent = [n for n in wanted if n not in self.shapes]
        if absent:
            raise ValueError(f"{self.weights}: missing {absent}")
        n = self.dictionary().count()
        if n != self.n_probes:
            raise ValueError(f"the network takes {self.n_probes} probes, the dictionary lists {n}")


def load_model(spark: SparkSession, folder: str) -> Model:
    folder = folder.rstrip("/")
    named = [n for n in list_files(folder) if n.endswith(TENSORS)]
    if len(named) != 1:
        raise FileNotFoundError(f"{folder} holds {len(named)} tensor files, one is expected")
    return Model(spark, folder, parse_lineage(read_text(f"{folder}/{LINEAGE}")), named[0])
