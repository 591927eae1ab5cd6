"""Byte-level BPE encoding and decoding by a public rank file.

Method: the pattern's matches of a piece of texts are made distinct and dealt by length into padded matrices of token ids.
In each round every unfinished row merges its leftmost pair of least rank: pair ranks come from a hashed table, the merged
column is closed up, and finished rows leave the matrix, so a matrix shrinks by a column a round. Scan only: no shuffle, and
a task holds one piece of texts. Null text encodes as the empty text; long texts and long single matches are encoded whole.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methlake.llm.shared import small_batches
from methlake.llm.words import gather, pieces, ranges, utf8

NONE = np.int32(2**31 - 1)
#: Matrix widths; beyond the last, a match is a row of its own whose pairs wait in a heap (same order, same result).
WIDTHS = (4, 6, 8, 12, 16, 24, 32, 64, 256, 1024)
#: Cells of one matrix, and text bytes that are encoded at a time.
CELLS = 1 << 18
PIECE = 1 << 20


@dataclass
class Ranks:
    """A rank file: the tokens' bytes by id, and a hashed table from pairs of ids to the id of their concatenation."""

    pattern: str
    tokens: list[bytes]
    byte_ids: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    probes: int

    @classmethod
    def load(cls, path: str, pattern: str) -> "Ranks":
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        keys, values, probes = _hashed(np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32))
        return cls(pattern, tokens, np.array([ranks[bytes([b])] for b in range(256)], np.int32), keys, values, probes)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation, NONE where it is no token or a side is padding (below 0)."""
        out = np.full(left.shape, NONE, np.int32)
        live = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        key = left.ravel()[live].astype(np.uint64) << np.uint64(32) | right.ravel()[live].astype(np.uint64)
        slot = _slot(key, len(self.keys))
        flat = out.ravel()
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == key
            flat[live[hit]] = self.values[slot[hit]]
            on = ~hit & (there != _EMPTY)
            if not on.any():
                break
            live, key, slot = live[on], key[on], (slot[on] + 1) % len(self.keys)
        return flat.reshape(left.shape)


_EMPTY = np.uint64(2**64 - 1)


def _slot(key: np.ndarray, size: int) -> np.ndarray:
    return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def _hashed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Open addressing with linear probing at a load under 1/2; also the longest probe."""
    size = 1 << max(4, int(2 * len(keys) - 1).bit_length())
    table, out = np.full(size, _EMPTY, np.uint64), np.zeros(size, np.int32)
    slot, left, probes = _slot(keys, size), np.arange(len(keys)), 0
    while len(left):
        probes += 1
        free = table[slot] == _EMPTY
        placed, at = np.unique(slot[free], return_index=True)
        chosen = left[free][at]
        table[placed], out[placed] = keys[chosen], values[chosen]
        on = table[slot] != keys[left]
        left, slot = left[on], (slot[on] + 1) % size
    return table, out, probes + 1


def merge_rows(ids: np.ndarray, ranks: Ranks) -> list[tuple[np.ndarray, np.ndarray]]:
    """ids: rows padded with -1 on the right. Returns (row numbers, their finished ids) as rows finish."""
    rows, done = np.arange(len(ids)), []
    cost = ranks.pair_ranks(ids[:, :-1], ids[:, 1:])
    while len(rows):
        if cost.shape[1] == 0:
            done.append((rows, ids))
            break
        at = cost.argmin(1)
        best = cost[np.arange(len(rows)), at]
        on = best != NONE
        if not on.all():
            done.append((rows[~on], ids[~on]))
            rows, ids, cost, at, best = rows[on], ids[on], cost[on], at[on], best[on]
            if not len(rows):
                break
        line = np.arange(len(rows))
        ids[line, at] = best
        keep = np.arange(ids.shape[1] - 1)
        ids = np.take_along_axis(ids, keep + (keep > at[:, None]), 1)  # the merged pair's right half goes
        keep = keep[: ids.shape[1] - 1]
        cost = np.take_along_axis(cost, keep + (keep >= at[:, None]), 1)
        if cost.shape[1]:
            fits = at < cost.shape[1]
            cost[line[fits], at[fits]] = ranks.pair_ranks(ids[line[fits], at[fits]], ids[line[fits], at[fits] + 1])
            fits = at > 0
            cost[line[fits], at[fits] - 1] = ranks.pair_ranks(ids[line[fits], at[fits] - 1], ids[line[fits], at[fits]])
    return done


def merge_long(ids: np.ndarray, ranks: Ranks) -> np.ndarray:
    """The same merges of one very long row: the heap gives the leftmost pair of least rank, links close up the gaps."""
    token, n = ids.tolist(), len(ids)
    before, after = list(range(-1, n - 1)), list(range(1, n + 1))
    known: dict[tuple[int, int], int] = {}

    def rank(a: int, b: int) -> int:
        if (a, b) not in known:
            known[a, b] = int(ranks.pair_ranks(np.array([a]), np.array([b]))[0])
        return known[a, b]

    heap = [(r, i) for i, r in enumerate(ranks.pair_ranks(ids[:-1], ids[1:]).tolist()) if r != NONE]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i]
        if token[i] < 0 or j >= n or rank(token[i], token[j]) != r:
            continue  # one of its sides has merged since
        token[i], token[j], after[i] = r, -1, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (x := rank(r, token[after[i]])) != NONE:
                heapq.heappush(heap, (x, i))
        if before[i] >= 0 and (x := rank(token[before[i]], r)) != NONE:
            heapq.heappush(heap, (x, before[i]))
    return np.array([t for t in token if t >= 0], np.int32)


def encode_matches(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct matches, flat, and len + 1 offsets."""
    n = len(lengths)
    counts, parts = np.zeros(n, np.int64), []
    group = np.searchsorted(WIDTHS, lengths)
    for i in np.flatnonzero(group == len(WIDTHS)):
        ids = merge_long(ranks.byte_ids[data[starts[i] : starts[i] + lengths[i]]], ranks)
        counts[i] = len(ids)
        parts.append((np.array([i]), ids))
    for g, edge in enumerate(WIDTHS):
        mine = np.flatnonzero(group == g)
        step = max(1, CELLS // edge)
        for at in range(0, len(mine), step):
            some = mine[at : at + step]
            size = lengths[some]
            width = int(size.max())
            matrix = np.full((len(some), width), -1, np.int32)
            inside = np.arange(width) < size[:, None]
            matrix[inside] = ranks.byte_ids[gather(data, starts[some], size)]
            for rows, ids in merge_rows(matrix, ranks):
                real = ids >= 0
                counts[some[rows]] = real.sum(1)
                parts.append((some[rows], ids[real]))
    offsets = np.zeros(n + 1, np.int64)
    np.cumsum(counts, out=offsets[1:])
    flat = np.zeros(offsets[-1], np.int32)
    for rows, ids in parts:
        flat[ranges(offsets[rows], counts[rows])] = ids
    return flat, offsets


def encode_texts(texts: list[str | None], pattern: regex.Pattern, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, flat, and len + 1 offsets."""
    found, first = [], np.zeros(len(texts) + 1, np.int64)
    for d, text in enumerate(texts):
        if text:
            found += pattern.findall(text)
        first[d + 1] = len(found)
    coded = pa.array(found, pa.large_string()).dictionary_encode()
    data, offsets = utf8(coded.dictionary)
    flat, at = encode_matches(data, offsets[:-1], np.diff(offsets), ranks)
    which = coded.indices.to_numpy()
    size = np.diff(at)[which] if len(which) else np.zeros(0, np.int64)
    total = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=total[1:])
    return (gather(flat, at[which], size) if len(which) else flat), total[first]


def encode(docs: DataFrame, ranks: Ranks, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with `out`, the token ids as one binary of little-endian unsigned 32-bit integers (see `unpacked`)."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)  # bounded by the rank file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = regex.compile(shared.value.pattern)
        for piece in pieces(batches, text, PIECE):
            flat, offsets = encode_texts(piece.column(text).to_pylist(), pattern, shared.value)
            packed = np.ascontiguousarray(flat, dtype="<u4")
            column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), piece.num_rows, [None, pa.py_buffer(np.ascontiguousarray(offsets * 4)), pa.py_buffer(packed)])
            yield pa.RecordBatch.from_arrays([*piece.columns, column.cast(pa.binary())], names=[*piece.schema.names, out])

    kept = docs.drop(out)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())]))


def decode(coded: DataFrame, ranks: Ranks, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with `out`, the bytes that the packed ids stand for; null ids decode to no bytes."""
    shared = coded.sparkSession.sparkContext.broadcast(ranks.tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for piece in pieces(batches, ids, PIECE):
            texts = [b"".join(map(tokens.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in piece.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.binary())], names=[*piece.schema.names, out])

    kept = coded.drop(out)
    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())]))


def unpacked(ids: str):
    """Packed ids as array<bigint>."""
    n = (F.length(ids) / 4).cast("int")
    low = lambda i: F.concat(*[F.substring(F.col(ids), 4 * i + k, F.lit(1)) for k in (4, 3, 2, 1)])
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.hex(low(i)), 16, 10).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
