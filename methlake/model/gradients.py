"""Gradient tables: every task contributes one set of blocks, which are added by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from methlake.sources.tensors import BLOCK

SUMS_SCHEMA = "name string, shape array<bigint>, block int, values array<double>"
#: What tasks send: values are a whole block, or those at some places of it.
PARTS_SCHEMA = SUMS_SCHEMA + ", places binary"
STATS = "(stats)"  # pseudo tensor of scalar sums
LANES = 32


def rows_of(sums: dict[str, np.ndarray]) -> pd.DataFrame:
    """Accumulated arrays as block rows."""
    rows = []
    for name, a in sums.items():
        flat = np.asarray(a, np.float64).ravel()
        for b in range(max(1, -(-flat.size // BLOCK))):
            rows.append((name, list(np.shape(a)), b, flat[b * BLOCK : (b + 1) * BLOCK]))
    return pd.DataFrame(rows, columns=["name", "shape", "block", "values"]).assign(places=None)


class Columns:
    """Sums for some columns of a wide matrix: memory follows the columns that were touched, not the matrix."""

    def __init__(self, name: str, rows: int, width: int):
        self.name, self.shape = name, (rows, width)
        self.at, self.sums = np.zeros(0, np.int64), np.zeros((rows, 0))

    def add(self, deltas: np.ndarray, plus: list[np.ndarray], minus: list[np.ndarray]) -> None:
        """For each example its vector, added to the columns `plus` and taken off the columns `minus`."""
        size = np.array([len(p) + len(m) for p, m in zip(plus, minus)])
        touched = np.concatenate([x for pair in zip(plus, minus) for x in pair] or [np.zeros(0, np.int64)])
        at = np.union1d(self.at, touched)
        if len(at) > len(self.at):
            grown = np.zeros((self.shape[0], len(at)))
            grown[:, np.searchsorted(at, self.at)] = self.sums
            self.at, self.sums = at, grown
        place, begin = np.searchsorted(self.at, touched), 0
        for d, n, p in zip(deltas, size.tolist(), plus):
            mine = place[begin : begin + n]
            self.sums[:, mine[: len(p)]] += d[:, None]
            self.sums[:, mine[len(p) :]] -= d[:, None]
            begin += n

    def rows(self) -> pd.DataFrame:
        """As block rows: the touched places of each block, and their sums."""
        out, width = [], self.shape[1]
        for r in range(self.shape[0] if len(self.at) else 0):
            flat = r * width + self.at
            cut = np.flatnonzero(np.diff(flat // BLOCK)) + 1
            for places, values in zip(np.split(flat, cut), np.split(self.sums[r], cut)):
                out.append((self.name, list(self.shape), int(places[0] // BLOCK), values, (places % BLOCK).astype("<i4").tobytes()))
        return pd.DataFrame(out, columns=["name", "shape", "block", "values", "places"])


def add_into(total: dict[str, np.ndarray], part: dict[str, np.ndarray]) -> None:
    for name, a in part.items():
        total[name] = total[name] + a if name in total else np.array(a, np.float64)


def sum_blocks(parts: DataFrame) -> DataFrame:
    """Add rows of PARTS_SCHEMA of equal (name, block), and give whole blocks.

    In two steps over lanes of tasks, so one group never holds the rows of more than a share of the tasks.
    """

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        shape, block = pdf["shape"].iloc[0], int(pdf["block"].iloc[0])
        total = np.zeros(max(1, min(BLOCK, int(np.prod(shape, dtype=np.int64)) - block * BLOCK)))
        for values, places in zip(pdf["values"], pdf["places"] if "places" in pdf else [None] * len(pdf)):
            if places is None:
                total += values
            else:
                total[np.frombuffer(places, "<i4")] += values
        return pd.DataFrame({"name": pdf["name"][:1], "shape": pdf["shape"][:1], "block": pdf["block"][:1], "values": [total]})

    laned = parts.withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(LANES)))
    once = laned.groupBy("name", "block", "lane").applyInPandas(add, SUMS_SCHEMA)
    return once.groupBy("name", "block").applyInPandas(add, SUMS_SCHEMA)
