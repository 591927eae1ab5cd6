"""Benchmark decontamination with an FM-index per shard of training texts.

The test items' windows are phrases over a vocabulary of their own words. A shard is one piece of a scan's texts: its words
become vocabulary symbols; a word outside the vocabulary cannot be part of a hit, so the shard's index holds the runs of
vocabulary words that are as long as the shortest phrase, with separators between. All phrases are searched backwards at
once through the ranks of a wavelet tree; occurrences are located by walking to sampled suffix positions, mapped to word
positions of their documents, and merged into removal spans.

The test items come to the driver in blocks of bounded bytes; each block is one more pass over the same scan. No shuffle.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methlake.llm.shared import small_batches
from methlake.llm.words import ALNUM, LOWER, Words, gather, pieces, ranges, utf8

WINDOW = 10
#: Bytes of test items that are searched in one pass.
BLOCK_BYTES = 16 << 20
#: Bytes of text in a shard.
SHARD_BYTES = 4 << 20
#: A suffix position is kept for every so many text positions.
SAMPLE = 16

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
COLUMNS = ("n_words", "spans", "item_ids")


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Prefix doubling until all ranks differ; the text ends with a symbol that occurs once and is least."""
    order = np.argsort(text, kind="stable")
    rank = np.zeros(len(text), np.int64)
    step = 1
    key = text.astype(np.int64)
    while True:
        sorted_key = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == len(text) - 1:
            return order
        after = np.zeros(len(text), np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (len(text) + 1) + after
        order = np.argsort(key, kind="stable")
        step *= 2


class WaveletTree:
    """Symbols by their bits, from the highest: a level keeps zeros before ones, and counts of ones up to each place."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.bits = max(1, int(size - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = symbols >> level & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(symbols) - int(self.ones[-1][-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        low, high = np.zeros_like(upto), upto
        for k in range(self.bits):
            bit = symbol >> (self.bits - 1 - k) & 1
            a, b = self.ones[k][low], self.ones[k][high]
            low, high = np.where(bit, self.zeros[k] + a, low - a), np.where(bit, self.zeros[k] + b, high - b)
        return high - low

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it occurs before it."""
        symbol, low, high = np.zeros_like(at), np.zeros_like(at), at
        for k in range(self.bits):
            bit = self.ones[k][high + 1] - self.ones[k][high]
            a, b = self.ones[k][low], self.ones[k][high]
            low, high = np.where(bit, self.zeros[k] + a, low - a), np.where(bit, self.zeros[k] + b, high - b)
            symbol = symbol << 1 | bit
        return symbol, high - low


class FmIndex:
    """text: symbols from 1; a least symbol 0 is put at its end."""

    def __init__(self, text: np.ndarray, size: int):
        text = np.append(text, 0).astype(np.int64)
        order = suffix_array(text)
        self.before = WaveletTree(text[order - 1], size)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))]).astype(np.int64)
        sampled = order % SAMPLE == 0
        self.sampled = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.places = order[sampled]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of the suffixes that begin with each phrase; phrases: padded rows of symbols."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.less[-1], np.int64)
        live = np.arange(len(phrases))
        for k in range(phrases.shape[1] if len(phrases) else 0):
            live = live[(lengths[live] > k) & (high[live] > low[live])]
            symbol = phrases[live, lengths[live] - 1 - k]
            low[live] = self.less[symbol] + self.before.rank(symbol, low[live])
            high[live] = self.less[symbol] + self.before.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back until a sampled one is met."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live = np.arange(len(rows))
        while len(live):
            met = self.sampled[rows[live] + 1] > self.sampled[rows[live]]
            done = live[met]
            out[done] = self.places[self.sampled[rows[done]]] + steps[done]
            live = live[~met]
            symbol, count = self.before.symbol_and_rank(rows[live])
            rows[live] = self.less[symbol] + count
            steps[live] += 1
        return out


@dataclass
class Phrases:
    """Windows of a block of test items as rows of symbols (1: separator, from 2: vocabulary), and each window's items."""

    hashes: np.ndarray  # of the vocabulary, ascending; symbol = place + 2
    data: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    rows: np.ndarray
    sizes: np.ndarray
    item_first: np.ndarray
    items: np.ndarray
    names: list[str]

    @classmethod
    def build(cls, names: list[str | None], texts: list[str | None], window: int) -> "Phrases":
        data, offsets = utf8(pa.array(texts, pa.string()))
        words = Words(LOWER[data], offsets, ALNUM)
        hashes, first, inverse = np.unique(words.hashes(), return_index=True, return_inverse=True)
        found: dict[tuple[int, ...], set[int]] = {}
        known = sorted({n for n in names if n is not None})
        number = {n: i for i, n in enumerate(known)}
        for d, name in enumerate(names):
            symbols = (inverse[words.first[d] : words.first[d + 1]] + 2).tolist()
            for i in range(max(1, len(symbols) - window + 1) if symbols else 0):
                found.setdefault(tuple(symbols[i : i + window]), set()).update([] if name is None else [number[name]])
        sizes = np.array([len(p) for p in found], np.int64)
        rows = np.zeros((len(found), int(sizes.max()) if len(found) else 0), np.int64)
        for i, p in enumerate(found):
            rows[i, : len(p)] = p
        of = [sorted(s) for s in found.values()]
        item_first = np.concatenate([[0], np.cumsum([len(s) for s in of])]).astype(np.int64)
        items = np.array([x for s in of for x in s], np.int64)
        return cls(hashes, words.data, words.starts[first], (words.ends - words.starts)[first], rows, sizes, item_first, items, known)

    def symbols(self, words: Words) -> np.ndarray:
        """0 for words outside the vocabulary; equal hashes are confirmed by their bytes."""
        out = np.zeros(len(words), np.int64)
        if not len(self.hashes) or not len(words):
            return out
        h = words.hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        size = words.ends - words.starts
        some = np.flatnonzero((self.hashes[at] == h) & (self.lengths[at] == size))
        if len(some):
            same = gather(words.data, words.starts[some], size[some]) == gather(self.data, self.starts[at[some]], size[some])
            some = some[np.logical_and.reduceat(same, np.cumsum(size[some]) - size[some])]
        out[some] = at[some] + 2
        return out


def shard_hits(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of every occurrence in the shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.sizes) or not len(words):
        return none
    symbols = phrases.symbols(words)
    text_of = words.text_of
    inside = symbols > 0
    begin = inside.copy()
    begin[1:] &= ~(inside[:-1] & (text_of[1:] == text_of[:-1]))
    run_first = np.flatnonzero(begin)
    run = np.cumsum(begin) - 1
    run_size = np.bincount(run[inside], minlength=len(run_first)) if len(run_first) else np.zeros(0, np.int64)
    keep = run_size >= phrases.sizes.min()
    run_first, run_size = run_first[keep], run_size[keep]
    if not len(run_first):
        return none
    origin = ranges(run_first, run_size + 1)  # the place after a run holds the separator
    text = np.where(np.arange(len(origin)) == np.repeat(np.cumsum(run_size + 1) - 1, run_size + 1), 1, symbols[np.minimum(origin, len(symbols) - 1)])
    index = FmIndex(text, len(phrases.hashes) + 2)
    low, high = index.search(phrases.rows, phrases.sizes)
    which = np.repeat(np.arange(len(low)), high - low)
    return origin[index.locate(ranges(low, high - low))], which


def merged(first: np.ndarray, last: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open intervals, ascending; touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(set(zip(first.tolist(), last.tolist()))):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _blocks(benchmark: DataFrame, item: str, text: str, limit: int) -> Iterator[tuple[list, list]]:
    names, texts, size = [], [], 0
    for row in benchmark.select(F.col(item).cast("string").alias("n"), F.col(text).alias("t")).where("t IS NOT NULL").toLocalIterator():
        names.append(row["n"])
        texts.append(row["t"])
        size += len(row["t"]) + 16
        if size >= limit:
            yield names, texts
            names, texts, size = [], [], 0
    if names:
        yield names, texts


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (merged word intervals inside an occurring window) and item_ids (ascending strings).

    An item of fewer words than the window is one window; one without words has none. Null texts have no words. A window of
    an item with a null id hits, but names no item. Columns of docs that have the names of the three are replaced.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop(*COLUMNS)
    schema = T.StructType([*kept.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("item_ids", T.ArrayType(T.StringType()))])
    out, names = kept, kept.columns
    blocks = _blocks(benchmark, item, item_text, block_bytes)  # drawn one at a time: the driver holds one block
    for block in itertools.chain([next(blocks, ([], []))], blocks):
        shared = docs.sparkSession.sparkContext.broadcast(Phrases.build(*block, window))  # block_bytes bound it
        out = out.mapInArrow(_pass(shared, names, text), schema)
    return out


def _pass(shared, names: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        for piece in pieces(batches, text, SHARD_BYTES):
            data, offsets = utf8(piece.column(text))
            words = Words(LOWER[data], offsets, ALNUM)
            at, which = shard_hits(words, phrases)
            doc = np.searchsorted(words.first, at, "right") - 1
            spans, items = [[] for _ in range(piece.num_rows)], [[] for _ in range(piece.num_rows)]
            order = np.argsort(doc, kind="stable")
            docs_hit, cut = np.unique(doc[order], return_index=True)
            for d, mine in zip(docs_hit.tolist(), np.split(order, cut[1:])):
                first = at[mine] - words.first[d]
                spans[d] = merged(first, first + phrases.sizes[which[mine]])
                kinds = np.unique(which[mine])
                numbers = phrases.items[ranges(phrases.item_first[kinds], np.diff(phrases.item_first)[kinds])]
                items[d] = [phrases.names[i] for i in np.unique(numbers)]
            if "spans" in piece.schema.names:  # an earlier block's
                for d, (s, i) in enumerate(zip(piece.column("spans").to_pylist(), piece.column("item_ids").to_pylist())):
                    if s:
                        both = np.array([*spans[d], *((x["start"], x["end"]) for x in s)])
                        spans[d], items[d] = merged(both[:, 0], both[:, 1]), sorted({*items[d], *i})
            made = [
                pa.array(np.diff(words.first), pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                pa.array(items, pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), *made], names=[*names, *COLUMNS])

    return run


def remove(found: DataFrame, text: str = "text") -> DataFrame:
    """`find`'s rows with the spans cut out of the text, from a span's first to its last byte; a span leaves one space.

    Texts without spans stay as they are; a text that holds no word afterwards becomes empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            data, offsets = utf8(piece.column(text))
            words = Words(LOWER[data], offsets, ALNUM)
            texts = []
            for d, (old, spans) in enumerate(zip(piece.column(text).to_pylist(), piece.column("spans").to_pylist())):
                if spans:
                    raw, at, parts = old.encode(), 0, []
                    for s in spans:
                        parts.append(raw[at : words.starts[words.first[d] + s["start"]] - offsets[d]])
                        at = words.ends[words.first[d] + s["end"] - 1] - offsets[d]
                    old = b" ".join([*parts, raw[at:]]).decode() if sum(s["end"] - s["start"] for s in spans) < words.first[d + 1] - words.first[d] else ""
                texts.append(old)
            k = piece.schema.get_field_index(text)
            yield piece.set_column(k, piece.schema.field(k), pa.array(texts, piece.schema.field(k).type))

    return found.mapInArrow(run, found.schema)
