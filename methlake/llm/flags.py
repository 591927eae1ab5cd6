"""Sets of rows as bits of fixed number, to tell scans which rows are wanted; a bit may stand for more rows than meant."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methlake.llm.words import mix

FLAGS = 1 << 24


def row_flag(ord_: np.ndarray, th: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (mix(mix(ord_.view(np.uint64)) + th.view(np.uint64) + line.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(FLAGS)).astype(np.int64)


def bits_of(flags: DataFrame, name: str) -> bytes:
    """The values of an int column below FLAGS, as FLAGS bits; FLAGS / 32768 small rows come to the driver."""
    got = flags.groupBy(F.bitmap_bucket_number(name).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(name)).alias("bits")).collect()
    part = {row["b"]: bytes(row["bits"]) for row in got}
    # the built-in puts a value v > 0 into bucket 1 + (v - 1) // 32768 at bit (v - 1) % 32768, and 0 into bucket 0
    whole = b"".join(part.get(b, bytes(4096)) for b in range(1, FLAGS // 32768 + 1))
    out = np.zeros(FLAGS, np.uint8)
    out[1:] = np.unpackbits(np.frombuffer(whole, np.uint8), bitorder="little")[: FLAGS - 1]
    out[0] = any(part.get(0, b""))
    return np.packbits(out, bitorder="little").tobytes()


class as_flags:  # noqa: N801
    """Packed bits that are indexed like an array of flags."""

    def __init__(self, bits: bytes):
        self.bytes = np.frombuffer(bits, np.uint8)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
