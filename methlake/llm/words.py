"""Words of whole texts as numpy arrays, straight from the UTF-8 buffers of Arrow columns.

Every word class used here is decided by single ASCII bytes (bytes from 0x80 on always belong to words or always do not),
so splitting bytes equals splitting characters. A null text has no bytes and no words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that are worked on at a time; a longer text is a piece of its own, never cut.
PIECE_BYTES = 1 << 20
HASH_BYTES = 1 << 17
GATHERED = 1 << 18

_MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)


def byte_class(inside) -> np.ndarray:
    """256 flags: is this byte part of a word?"""
    return np.array([bool(inside(b)) for b in range(256)])


#: [^\x20\x09-\x0D]+
NOT_SPACE = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, after A-Z were lower-cased
ALNUM = byte_class(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: A-Z to a-z, all else unchanged
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and len + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows so that a piece holds at most `limit` bytes of the column, or one row."""
    try:
        yield from _cut(batches, column, limit)
    finally:
        release()


def release() -> None:
    """Give freed memory back to the system: workers live on after a task, and an executor has several."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def _cut(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total = np.cumsum(lengths, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


class Words:
    """Where the words of some texts are: word i is data[starts[i]:ends[i]]; text d has words first[d] to first[d + 1] - 1."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
        flags = inside[data]
        begin, end = flags.copy(), flags.copy()
        begin[1:] &= ~flags[:-1]
        end[:-1] &= ~flags[1:]
        cuts = offsets[(offsets > 0) & (offsets < len(data))]
        begin[cuts] = flags[cuts]
        end[cuts - 1] = flags[cuts - 1]
        self.data = data
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """64-bit hashes: a polynomial over the word's bytes, from prefix sums, then mixed with its length."""
        out = np.empty(len(self), np.uint64)
        cuts = np.searchsorted(self.starts, np.arange(0, len(self.data) + HASH_BYTES, HASH_BYTES)).tolist()
        for a, b in zip(cuts, cuts[1:]):  # so many bytes at a time that all arrays stay in the cache
            if a == b:
                continue
            s, e = self.starts[a], self.ends[b - 1]
            power, inverse = _powers(e - s + 1)
            sums = np.zeros(e - s + 1, np.uint64)
            np.cumsum((self.data[s:e].astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
            first = self.starts[a:b] - s
            out[a:b] = (sums[self.ends[a:b] - s] - sums[first]) * inverse[first]
        return mix(out ^ (self.ends - self.starts).astype(np.uint64))

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()

    def encoded(self) -> pa.Array:
        """The words as an Arrow column, without copying a word by itself."""
        lengths = self.ends - self.starts
        offsets = np.zeros(len(self) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(gather(self.data, self.starts, lengths))])


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
_CACHE: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _CACHE or len(_CACHE[0]) < n:
        out = []
        for base in (_MULTIPLIER, _INVERSE):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _CACHE[:] = out
    return _CACHE[0][:n], _CACHE[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one range after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    shift = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)
    return np.arange(total, dtype=np.int64) + shift


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ranges' items, one range after another; indices are made for a block of ranges at a time."""
    ends = np.cumsum(lengths, dtype=np.int64)
    if not len(ends) or ends[-1] <= GATHERED:
        return data[ranges(starts, lengths)]
    out, at = np.empty(ends[-1], data.dtype), 0
    while at < len(ends):
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + GATHERED, "right")))
        out[before : ends[to - 1]] = data[ranges(starts[at:to], lengths[at:to])]
        at = to
    return out


def grouped(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal values side by side, and where in it each value begins. (A plain sort is far faster than
    a stable one or np.unique.)"""
    order = np.argsort(x)
    s = x[order]
    return order, np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)


def counted(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and how often each occurs."""
    s = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.append(first, len(s)))


def covered(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Flags of 0 .. n - 1: is it inside any half-open interval first[i] .. last[i]?"""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, last, -1)
    return np.cumsum(depth[:-1]) > 0


def sums_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[d]:first[d + 1]] for each d; also where that is empty."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
