"""Packed numbers, and counts of hashes in counters of fixed number."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from methlake.llm.words import counted, grouped

_ZSTD = pa.Codec("zstd")


def squeeze(x: np.ndarray) -> bytes:
    """Numbers as zstd-compressed byte planes, after their length."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T if len(x) else np.zeros(0, np.uint8)
    return np.int64(len(x)).tobytes() + _ZSTD.compress(np.ascontiguousarray(planes).tobytes(), asbytes=True)


def expand(raw: bytes, kind) -> np.ndarray:
    n, size = int(np.frombuffer(raw[:8], np.int64)[0]), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(_ZSTD.decompress(raw[8:], n * size, asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def squeeze_all(columns: list[np.ndarray]) -> bytes:
    """Columns of one length, as the compressed byte planes of all of them, after their length."""
    n = len(columns[0])
    planes = b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(n, c.itemsize).T).tobytes() for c in columns) if n else b""
    return np.int64(n).tobytes() + _ZSTD.compress(planes, asbytes=True)


def squeeze_parts(columns: list[np.ndarray], cut: np.ndarray) -> list[bytes]:
    """`squeeze_all` of each stretch of the columns; cut: where the stretches begin, in order."""
    n = len(columns[0])
    planes = np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(n, c.itemsize).T for c in columns]) if n else np.zeros((0, 0), np.uint8)
    return [np.int64(b - a).tobytes() + _ZSTD.compress(planes[:, a:b].tobytes(), asbytes=True) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), n])]


def expand_all(raw: bytes, kinds: list) -> list[np.ndarray]:
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    widths = [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(_ZSTD.decompress(raw[8:], n * sum(widths), asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    out, at = [], 0
    for kind, width in zip(kinds, widths):
        out.append(np.ascontiguousarray(planes[at : at + n * width].reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def add_up(source: DataFrame, found: Callable, counters: int, slices: int, finish: Callable, schema: str) -> DataFrame:
    """Adds weights up in counters: a task sends its counters as `slices` packed rows, and each slice is added by itself.

    found(batches) yields (counter numbers, weights or None). finish(first counter, totals) gives a slice's columns.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for at, weights in found(batches):
            if weights is None:
                values, sums = counted(at)
            else:
                order, first = grouped(at)
                values, sums = at[order[first]], np.add.reduceat(weights[order], first) if len(at) else weights
            total[values] += sums
        for i, part in enumerate(np.split(total, slices)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([squeeze(part)], pa.binary())], names=["slice", "counts"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(counters // slices, np.int64)
        for raw in group["counts"].to_pylist():
            total += expand(raw, np.int64)
        return pa.table(finish(group["slice"][0].as_py() * (counters // slices), total))

    return source.mapInArrow(send, "slice int, counts binary").groupBy("slice").applyInArrow(add, schema)
