"""Beta-code matrices: rows of fixed width, one byte per probe, read by byte range (`methcodes`)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from methlake.sources.files import file_size, read_range

TASK_BYTES = 128 << 20
BATCH_BYTES = 16 << 20


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class CodeSource(DataSource):
    """Options: path, width (bytes per row)."""

    @classmethod
    def name(cls) -> str:
        return "methcodes"

    def schema(self) -> str:
        return "row bigint, codes binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return CodeReader(self.options["path"], int(self.options["width"]))


class CodeReader(DataSourceReader):
    def __init__(self, path: str, width: int):
        self.path, self.width = path, width
        size = file_size(path)
        if size is None or width < 1 or size % width:
            raise ValueError(f"{path}: {size} bytes are no whole number of rows of {width} codes")
        self.rows = size // width

    def partitions(self):
        step = max(1, TASK_BYTES // self.width)
        return [_Rows(a, min(a + step, self.rows)) for a in range(0, self.rows, step)] or [_Rows(0, 0)]

    def read(self, part: _Rows):
        step = max(1, BATCH_BYTES // self.width)
        for a in range(part.first, part.last, step):
            b = min(a + step, part.last)
            data = read_range(self.path, a * self.width, (b - a) * self.width)
            codes = [data[i * self.width : (i + 1) * self.width] for i in range(b - a)]
            yield pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(codes, pa.binary())], names=["row", "codes"])


def read_codes(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(row, codes) of a matrix; a row with a code that is neither a beta nor missing is an error."""
    spark.dataSource.register(CodeSource)
    raw = spark.read.format("methcodes").option("path", path).option("width", width).load()
    # codes 251..254: hex FB..FE at an even offset
    invalid = F.hex("codes").rlike("^(?:..)*?F[B-E]")
    message = F.concat(F.lit("codes 251..254 in row "), F.col("row").cast("string"))
    return raw.withColumn("codes", F.when(invalid, F.raise_error(message).cast("binary")).otherwise(F.col("codes")))
