"""Network weights as a table of blocks, published to the shared folder for tasks to read.

A model is a fixed artefact. Tasks load the tensors they need from the published table and keep them for the
life of the worker process, so weights never pass through the driver or a broadcast.
"""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession, functions as F

from methlake.session import shared_dir
from methlake.sources.files import resolve
from methlake.sources.tensors import BLOCK


def publish(blocks: DataFrame, folder: str | None = None) -> str:
    """Write a block table where every executor sees it; returns its path."""
    path = f"{folder or shared_dir(blocks.sparkSession) + '/weights'}/{uuid.uuid4().hex}"
    blocks.write.parquet(path)
    return path


@functools.lru_cache(maxsize=2)
def load(path: str, names: tuple[str, ...] | None = None) -> dict[str, np.ndarray]:
    """Tensors of a published table, read inside a task."""
    system, inner = resolve(path)
    data = pads.dataset(inner, filesystem=system, format="parquet", exclude_invalid_files=True)
    chosen = None if names is None else pads.field("name").isin(list(names))
    out: dict[str, np.ndarray] = {}
    for batch in data.to_batches(columns=["name", "shape", "block", "values"], filter=chosen):
        values = batch.column("values")
        for i, (name, shape, block) in enumerate(
            zip(batch.column("name").to_pylist(), batch.column("shape").to_pylist(), batch.column("block").to_pylist())
        ):
            a = out.setdefault(name, np.zeros(int(np.prod(shape, dtype=np.int64)), np.float32).reshape(shape))
            piece = values[i].values.to_numpy(zero_copy_only=False)
            a.reshape(-1)[block * BLOCK : block * BLOCK + len(piece)] = piece
    return out


def shapes(blocks: DataFrame) -> dict[str, tuple[int, ...]]:
    """Shape of every tensor (as many rows as the model has tensors)."""
    return {r["name"]: tuple(r["shape"]) for r in blocks.filter("block = 0").select("name", "shape").collect()}


def l2_norm(blocks: DataFrame, keys: list[str] = []) -> DataFrame:  # noqa: B006
    """(keys, norm) over all values of all tensors."""
    squares = F.aggregate("values", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    return blocks.groupBy(*keys).agg(F.sqrt(F.sum(squares)).alias("norm"))
