"""Named tensors in one file: a length-prefixed JSON header followed by little-endian values.

`spark.read.format("methtensors")` yields blocks (name, shape, block, values) of at most BLOCK values each, so the
largest matrix of a model is spread over tasks; `write_tensors` streams such blocks back into one file.
"""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from methlake.sources.files import expand, file_size, move, open_output, read_range, seekable

BLOCK = 65_536                # values per row
TASK_BLOCKS = 64              # blocks read by one task
BLOCKS_SCHEMA = "name string, shape array<bigint>, block int, values array<float>"

# Value types and their widths in bytes
WIDTHS = {"F32": 4, "BF16": 2, "F16": 2}


def read_tensor_header(path: str) -> tuple[dict[str, dict], int]:
    """Header entries in file order (dtype, shape, data_offsets) and the offset where values begin."""
    size = file_size(path)
    if size is None:
        raise FileNotFoundError(path)
    length = struct.unpack("<Q", read_range(path, 0, 8).ljust(8, b"\xff"))[0]
    if length > size - 8:
        raise ValueError(f"{path}: not a tensor file")
    entries = json.loads(read_range(path, 8, length))
    entries.pop("__metadata__", None)
    for name, e in entries.items():
        if e.get("dtype") not in WIDTHS:
            raise ValueError(f"{name}: unsupported type {e.get('dtype')}")
        begin, end = e["data_offsets"]
        if not 0 <= begin <= end <= size - 8 - length:
            raise ValueError(f"{name}: offsets outside the file")
        if end - begin != int(np.prod(e["shape"], dtype=np.int64)) * WIDTHS[e["dtype"]]:
            raise ValueError(f"{name}: {end - begin} bytes do not hold {e['shape']} {e['dtype']} values")
    return entries, 8 + length


def decode_values(data: bytes, dtype: str) -> np.ndarray:
    """Values as single precision; both half formats widen exactly."""
    if dtype == "F32":
        return np.frombuffer(data, "<f4")
    if dtype == "F16":
        return np.frombuffer(data, "<f2").astype(np.float32)
    return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)


class _Blocks(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class TensorSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "methtensors"

    def schema(self) -> str:
        return f"file int, {BLOCKS_SCHEMA}" if "paths" in self.options else BLOCKS_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return TensorReader(expand(self.options), schema, "paths" in self.options)


class TensorReader(DataSourceReader):
    def __init__(self, paths: list[str], schema: StructType, numbered: bool):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.paths, self.arrow, self.numbered = paths, to_arrow_schema(schema), numbered
        self.blocks = []
        for i, path in enumerate(paths):
            entries, base = read_tensor_header(path)
            self.blocks += [
                (i, name, e["dtype"], e["shape"], block, base + e["data_offsets"][0], (e["data_offsets"][1] - e["data_offsets"][0]) // WIDTHS[e["dtype"]])
                for name, e in entries.items()
                for block in range(max(1, -(-int(np.prod(e["shape"], dtype=np.int64)) // BLOCK)))
            ]

    def partitions(self):
        n = len(self.blocks)
        return [_Blocks(a, min(a + TASK_BLOCKS, n)) for a in range(0, n, TASK_BLOCKS)] or [_Blocks(0, 0)]

    def read(self, part: _Blocks):
        for file, name, dtype, shape, block, begin, count in self.blocks[part.first : part.last]:
            width, at = WIDTHS[dtype], block * BLOCK
            raw = read_range(self.paths[file], begin + at * width, min(BLOCK, count - at) * width)
            row = ({"file": file} if self.numbered else {}) | {"name": name, "shape": shape, "block": block, "values": decode_values(raw, dtype)}
            yield pa.RecordBatch.from_pylist([row], schema=self.arrow)


def read_tensors(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(TensorSource)
    return spark.read.format("methtensors").load(path)


def read_tensor_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Blocks of several files in one scan, with `file`, the place of the path in the list."""
    spark.dataSource.register(TensorSource)
    return spark.read.format("methtensors").option("paths", json.dumps(paths)).load()


def header_bytes(shapes: list[tuple[str, list[int]]]) -> bytes:
    """Header of single-precision tensors in the order given, padded so the values are 8-byte aligned."""
    entries, at = {}, 0
    for name, shape in shapes:
        size = 4 * int(np.prod(shape, dtype=np.int64))
        entries[name] = {"dtype": "F32", "shape": list(map(int, shape)), "data_offsets": [at, at + size]}
        at += size
    head = json.dumps(entries, separators=(",", ":"), ensure_ascii=False).encode()
    head += b" " * (-len(head) % 8)
    return struct.pack("<Q", len(head)) + head


def write_tensors(blocks: DataFrame, path: str, shapes: dict[str, tuple[int, ...]] | None = None) -> None:
    """One file, tensors by name, so equal tensors give equal bytes. Shapes that are known save a pass.

    The header fixes where every block lies. On a file system that all tasks mount they write their blocks there side by
    side; a task that runs again writes the same bytes. An object store takes a single stream, so there one task sorts the
    blocks (spilling as needed) and appends them. Either way the file appears under its name only once it is whole.
    """
    if shapes is None:
        shapes = {r["name"]: r["shape"] for r in blocks.filter("block = 0").select("name", "shape").collect()}
    listed = sorted(((n, list(s)) for n, s in shapes.items()), key=lambda s: s[0].encode())
    head, part = header_bytes(listed), path + ".part"
    expected = sum(int(np.prod(s, dtype=np.int64)) for _, s in listed)
    with open_output(part) as out:
        out.write(head)
    place = seekable(part)
    written = _append(blocks, part, head) if place is None else _side_by_side(blocks, place, listed, head, expected)
    if written != expected:
        raise RuntimeError(f"{path}: wrote {written} of {expected} values")
    move(part, path)


def _side_by_side(blocks: DataFrame, place: str, listed: list[tuple[str, list[int]]], head: bytes, expected: int) -> int:
    """Blocks to their places in a file of known size; the number of values written, each block counting once."""
    size, at, offsets = {}, len(head), {}
    for name, shape in listed:
        offsets[name], size[name] = at, int(np.prod(shape, dtype=np.int64))
        at += 4 * size[name]
    with open(place, "r+b") as out:
        out.truncate(at)

    def put(batches):
        with open(place, "r+b") as out:
            for pdf in batches:
                done = []
                for name, block, values in zip(pdf["name"], pdf["block"], pdf["values"]):
                    data = np.asarray(values, "<f4")
                    if len(data) != min(BLOCK, size[name] - block * BLOCK):
                        raise ValueError(f"{name}: block {block} has {len(data)} values")
                    out.seek(offsets[name] + 4 * BLOCK * int(block))
                    out.write(data.tobytes())
                    done.append((name, block, len(data)))
                out.flush()
                yield pd.DataFrame(done, columns=["name", "block", "n"])

    tasks = max(1, min(blocks.sparkSession.sparkContext.defaultParallelism, -(-expected // (BLOCK * TASK_BLOCKS)))) if expected else 1
    dealt = blocks.select("name", "block", "values").repartition(tasks, "name", "block")
    done = dealt.mapInPandas(put, "name string, block int, n bigint").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), F.count_distinct("name", "block").alias("blocks")).first()
    if done["rows"] != done["blocks"]:
        raise ValueError("a block occurs twice")
    return done["n"] or 0


def _append(blocks: DataFrame, part: str, head: bytes) -> int:
    def stream(batches):
        written = 0
        with open_output(part) as out:
            out.write(head)
            for pdf in batches:
                for values in pdf["values"]:
                    data = np.asarray(values, "<f4")
                    out.write(data.tobytes())
                    written += len(data)
        yield pd.DataFrame({"written": [written]})

    ordered = blocks.repartition(1).sortWithinPartitions(F.encode("name", "UTF-8"), "block").select("values")
    return ordered.mapInPandas(stream, "written bigint").first()["written"]
