"""Substring dedup by super-k-mer partitioning.

A window is `window` consecutive words of a text. Consecutive windows whose least hashed `minimiser`-word sequence is the
same form a super-k-mer; its words travel once, as one packed string, to the bucket of that minimiser. A bucket holds every
occurrence of its windows, so sorting its windows tells exactly which occurrence starts earliest; all others lose. Losing
needs no answer from elsewhere, so buckets return only spans of words to remove, which are joined back to their texts.

* Equal super-k-mers of one piece of the scan meet before the shuffle; only the earliest of them travels.
* Bytes are counted for `BINS` bins of minimisers, over all texts. A bin above a quarter of a bucket is dealt out by
  document first; what has not lost there meets again by the hash of its whole window, where few copies are left.
* Buckets follow the corpus size, so a task holds about `bucket_bytes` of packed strings.
* Texts that lose nothing are finished in a scan; only the others are shuffled to meet their spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methlake.llm.flags import as_flags, bits_of, row_flag
from methlake.llm.packing import add_up
from methlake.llm.shared import small_batches, stored
from methlake.llm.words import NOT_SPACE, Words, _powers, covered, gather, grouped, mix, pieces, ranges, release, utf8

WINDOW = 20
MINIMISER = 3
BUCKET_BYTES = 16 << 20
BINS = 1 << 20
PIECE = 4 << 20
#: Packed bytes for each text byte, about: a super-k-mer has some 9.5 windows and 28.5 words.
REDUNDANCY = 3

LAST = 2**63 - 1  # stands for a null key, after all others


@dataclass
class SuperKmers:
    """Columns of super-k-mers: whose they are, first word, windows, and the packed words."""

    ord: np.ndarray
    th: np.ndarray
    start: np.ndarray
    windows: np.ndarray
    packed: pa.Array

    def take(self, at: np.ndarray) -> "SuperKmers":
        return SuperKmers(self.ord[at], self.th[at], self.start[at], self.windows[at], self.packed.take(pa.array(at)))

    def pack(self) -> bytes:
        batch = pa.RecordBatch.from_arrays([pa.array(self.ord), pa.array(self.th), pa.array(self.start), pa.array(self.windows), self.packed], names=["ord", "th", "start", "windows", "packed"])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as out:
            out.write_batch(batch)
        return sink.getvalue().to_pybytes()

    @classmethod
    def unpack(cls, raw: bytes) -> "SuperKmers":
        batch = pa.ipc.open_stream(raw).read_next_batch()
        return cls(*(batch.column(i).to_numpy() for i in range(4)), batch.column(4))


def sequence_hashes(h: np.ndarray, first: np.ndarray, size) -> np.ndarray:
    """Hash of h[first:first + size] for each first, from prefix sums."""
    power, inverse = _powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[:-1], out=total[1:])
    return mix((total[first + size] - total[first]) * inverse[first])


def least_in_windows(h: np.ndarray, window: int, minimiser: int) -> np.ndarray:
    """For each place i: the least hash of the `minimiser`-word sequences inside words i .. i + window - 1."""
    n = len(h) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    low = sequence_hashes(h, np.arange(len(h) - minimiser + 1), minimiser)
    span, have = window - minimiser + 1, 1
    while 2 * have <= span:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    return np.minimum(low[:n], low[span - have : span - have + n])


def superkmers(words: Words, hashes: np.ndarray, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, minimiser) of the maximal runs of windows with one minimiser; words are numbered in the piece."""
    low = least_in_windows(hashes, window, minimiser)
    at = ranges(words.first[:-1], np.maximum(0, np.diff(words.first) - window + 1))
    if not len(at):
        return at, at, low[:0]
    low = low[at]
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (low[1:] != low[:-1])])
    first = np.flatnonzero(new)
    return at[first], np.diff(np.append(first, len(at))), low[first]


def spaced(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """All words, each followed by one space, and where each begins (and the end)."""
    size = words.ends - words.starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 0x20, np.uint8)
    blanks = np.zeros(at[-1], bool)
    blanks[at[1:] - 1] = True
    out[~blanks] = gather(words.data, words.starts, size)
    return out, at


def spans_of(kmers: SuperKmers, lost: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(ord, th, start, end) of runs of losing windows; lost: a flag for every window, super-k-mer by super-k-mer."""
    owner = np.repeat(np.arange(len(kmers.windows)), kmers.windows)
    place = ranges(kmers.start.astype(np.int64), kmers.windows)
    at = np.flatnonzero(lost)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.int32), none.astype(np.int32)
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])]))
    k = owner[at[new]]
    end = np.append(at[new[1:] - 1], at[-1])
    return kmers.ord[k], kmers.th[k], place[at[new]].astype(np.int32), (place[end] + window).astype(np.int32)


def _heads(h: np.ndarray) -> np.ndarray:
    """For each place the first place that holds an equal value."""
    order, first = grouped(h)
    head = np.empty(len(h), np.int64)
    if len(h):
        head[order] = np.repeat(np.minimum.reduceat(order, first), np.diff(np.append(first, len(h))))
    return head


def losers(kmers: SuperKmers, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(lost, hash) for every window of super-k-mers that are sorted by (ord, start): does an equal window start earlier?"""
    hashes, begin, end = [], [], []
    data, offsets = utf8(kmers.packed)
    cut = 0
    while cut < len(kmers.windows):  # some MB at a time: hashing takes several numbers a byte
        to = max(cut + 1, int(np.searchsorted(offsets, offsets[cut] + PIECE, "right")) - 1)
        words = Words(data[offsets[cut] : offsets[to]], offsets[cut : to + 1] - offsets[cut], NOT_SPACE)
        at = ranges(words.first[:-1], kmers.windows[cut:to])
        hashes.append(sequence_hashes(words.hashes(), at, window))
        begin.append(words.starts[at] + offsets[cut])
        end.append(words.ends[at + window - 1] + offsets[cut])
        cut = to
    if not hashes:
        return np.zeros(0, bool), np.zeros(0, np.uint64)
    h, begin, end = np.concatenate(hashes), np.concatenate(begin), np.concatenate(end)
    head = _heads(h)
    owner = np.repeat(np.arange(len(kmers.windows)), kmers.windows)
    _settle(head, owner, begin, end, data)
    place = ranges(kmers.start.astype(np.int64), kmers.windows)
    lost = (head != np.arange(len(h))) & ((kmers.ord[owner] != kmers.ord[owner[head]]) | (place != place[head]))
    return lost, h


def _settle(head: np.ndarray, owner: np.ndarray, begin: np.ndarray, end: np.ndarray, data: np.ndarray) -> None:
    """Confirms equal hashes by the words themselves: runs of windows against the runs of their heads, byte for byte."""
    at = np.flatnonzero(head != np.arange(len(head)))
    if not len(at):
        return
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (head[at[1:]] != head[at[:-1]] + 1) | (owner[at[1:]] != owner[at[:-1]]) | (owner[head[at[1:]]] != owner[head[at[:-1]]])]))
    last = np.append(new[1:] - 1, len(at) - 1)
    raw = memoryview(np.ascontiguousarray(data))
    wrong = [(i, j) for i, j, a, b, c, d in zip(at[new].tolist(), at[last].tolist(), begin[at[new]].tolist(), end[at[last]].tolist(), begin[head[at[new]]].tolist(), end[head[at[last]]].tolist()) if raw[a:b] != raw[c:d]]
    if wrong:  # different words under one 64-bit hash
        tops = {int(head[x]) for i, j in wrong for x in range(i, j + 1)}
        for top in tops:
            seen: dict[bytes, int] = {}
            for x in np.flatnonzero(head == top).tolist():
                head[x] = seen.setdefault(bytes(raw[begin[x] : end[x]]), x)


def _piece_kmers(piece: pa.RecordBatch, window: int, minimiser: int) -> tuple[SuperKmers, np.ndarray, np.ndarray]:
    """Super-k-mers of a piece, by (ord, start), their minimisers, and hashes of all their words."""
    piece = piece.take(pa.compute.sort_indices(piece, sort_keys=[("ord", "ascending"), ("th", "ascending")]))
    data, offsets = utf8(piece.column("text"))
    words = Words(data, offsets, NOT_SPACE)
    hashes = words.hashes()
    first, windows, low = superkmers(words, hashes, window, minimiser)
    buffer, at = spaced(words)
    doc = np.searchsorted(words.first, first, "right") - 1
    size = at[first + windows + window - 1] - 1 - at[first]
    packed_at = np.concatenate([[0], np.cumsum(size)])
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(packed_at.astype(np.int64)), pa.py_buffer(gather(buffer, at[first], size))])
    return SuperKmers(piece.column("ord").to_numpy()[doc], piece.column("th").to_numpy()[doc], (first - words.first[doc]).astype(np.int32), windows.astype(np.int32), packed), low, sequence_hashes(hashes, first, windows + window - 1)


OUT = T.StructType([
    T.StructField("part", T.IntegerType()), T.StructField("kmers", T.BinaryType()),
    T.StructField("ord", T.LongType()), T.StructField("th", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
])


def _rows(spans=None, parts=()) -> pa.RecordBatch:
    """Rows of OUT: spans to remove, and packed super-k-mers bound for parts."""
    none = np.zeros(0, np.int64)
    ord_, th, start, end = spans if spans is not None else (none, none, none.astype(np.int32), none.astype(np.int32))
    a, b = len(parts), len(ord_)
    pad = lambda x, kind: pa.concat_arrays([pa.nulls(a, kind), pa.array(x, kind)])
    return pa.RecordBatch.from_arrays([
        pa.concat_arrays([pa.array([p for p, _ in parts], pa.int32()), pa.nulls(b, pa.int32())]),
        pa.concat_arrays([pa.array([k for _, k in parts], pa.binary()), pa.nulls(b, pa.binary())]),
        pad(ord_, pa.int64()), pad(th, pa.int64()), pad(start, pa.int32()), pad(end, pa.int32()),
    ], names=[f.name for f in OUT])


def _dealt(kmers: SuperKmers, part: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(part, kind="stable")
    parts, cut = np.unique(part[order], return_index=True)
    for p, mine in zip(parts.tolist(), np.split(order, cut[1:])):
        yield p, kmers.take(mine).pack()


def _bin_bytes(window: int, minimiser: int):
    def found(batches: Iterator[pa.RecordBatch]):
        for piece in pieces(batches, "text", PIECE):
            data, offsets = utf8(piece.column("text"))
            words = Words(data, offsets, NOT_SPACE)
            first, windows, low = superkmers(words, words.hashes(), window, minimiser)
            yield (low % np.uint64(BINS)).astype(np.int64), words.ends[first + windows + window - 2] - words.starts[first]

    return found


def _scatter(window: int, minimiser: int, buckets: int, hot):
    """Scan -> super-k-mers by bucket; hot bins are dealt out by document (parts from `buckets` on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_bin, hot_slices = hot.value
        for piece in pieces(batches, "text", PIECE):
            kmers, low, whole = _piece_kmers(piece, window, minimiser)
            if not len(low):
                continue
            # equal super-k-mers of this piece: sorted by (ord, start), so the first of a group is its earliest
            top = _heads(whole)
            later = np.flatnonzero(top != np.arange(len(top)))
            texts = kmers.packed
            later = later[[texts[i].as_buffer().equals(texts[j].as_buffer()) for i, j in zip(later.tolist(), top[later].tolist())]] if len(later) else later
            lost = np.zeros(len(low), bool)
            lost[later[(kmers.ord[later] != kmers.ord[top[later]]) | (kmers.start[later] != kmers.start[top[later]])]] = True
            spans = spans_of(kmers, np.repeat(lost, kmers.windows), window)
            # rows that repeat each other share their spans, so one of them goes for all; of equal texts of one key likewise
            twin = np.zeros(len(low), bool)
            twin[later[(kmers.ord[later] == kmers.ord[top[later]]) & (kmers.start[later] == kmers.start[top[later]]) & (kmers.th[later] == kmers.th[top[later]])]] = True
            left = np.flatnonzero(~lost & ~twin)
            kmers, low = kmers.take(left), low[left]
            bin_ = (low % np.uint64(BINS)).astype(np.int64)
            part = bin_ % buckets
            if len(hot_bin):
                at = np.minimum(np.searchsorted(hot_bin, bin_), len(hot_bin) - 1)
                is_hot = hot_bin[at] == bin_
                slice_ = (mix(mix(kmers.ord.astype(np.uint64)) + kmers.th.view(np.uint64)) % hot_slices[at].astype(np.uint64)).astype(np.int64)
                spread = (mix((bin_ * 1_000_003 + slice_).astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                part = np.where(is_hot, buckets + spread, part)
            yield _rows(spans, list(_dealt(kmers, part.astype(np.int32))))

    return run


def _reduce(window: int, buckets: int, last: bool):
    """A bucket's windows are sorted; losers become spans. Survivors of hot parts go on, a window each, by its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[SuperKmers]] = {}
        for batch in batches:
            packed = batch.filter(batch.column("part").is_valid())
            if packed.num_rows < batch.num_rows:
                yield batch.filter(batch.column("part").is_null())
            for part, raw in zip(packed.column("part").to_pylist(), packed.column("kmers")):
                held.setdefault(part, []).append(SuperKmers.unpack(raw.as_py()))
        for part in list(held):
            some = held.pop(part)
            kmers = SuperKmers(*(np.concatenate([getattr(k, c) for k in some]) for c in ("ord", "th", "start", "windows")), pa.concat_arrays([k.packed for k in some]))
            some.clear()
            kmers = kmers.take(np.lexsort([kmers.start, kmers.ord]))
            lost, h = losers(kmers, window)
            parts = []
            if part >= buckets and not last:
                parts = list(_dealt(*_single_windows(kmers, ~lost, h, window, buckets)))
            rows = _rows(spans_of(kmers, lost, window), parts)
            del kmers, lost, h, some, parts
            release()
            yield rows

    return run


def _single_windows(kmers: SuperKmers, keep: np.ndarray, h: np.ndarray, window: int, buckets: int) -> tuple[SuperKmers, np.ndarray]:
    data, offsets = utf8(kmers.packed)
    words = Words(data, offsets, NOT_SPACE)
    at = ranges(words.first[:-1], kmers.windows)[keep]
    owner = np.repeat(np.arange(len(kmers.windows)), kmers.windows)[keep]
    place = ranges(kmers.start.astype(np.int64), kmers.windows)[keep]
    size = words.ends[at + window - 1] - words.starts[at]
    packed_at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(packed_at), pa.py_buffer(gather(data, words.starts[at], size))])
    ones = np.ones(len(at), np.int32)
    return SuperKmers(kmers.ord[owner], kmers.th[owner], place.astype(np.int32), ones, packed), (h[keep] % np.uint64(buckets)).astype(np.int32)


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, minimiser: int = MINIMISER, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """docs with n_words, n_removed and `kept`, the words outside all repeated windows, joined by single spaces.

    A word goes if a window over it also starts earlier: at a smaller key, or at the same key and an earlier word. Windows
    are judged on the input. key: integers; a null key comes after all others; rows that share a key are one document at the
    same places, so an exactly repeated row loses nothing to its twin. A null text has no words; kept is then empty.
    Columns of docs that have the names of the three are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.drop("n_words", "n_removed", "kept", "__ord", "__th", "__spans")
    source = docs.select(F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)).alias("ord"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    total = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-REDUNDANCY * total // bucket_bytes))
    least = max(1, REDUNDANCY * total // buckets // 4)  # so there are at most 4 x buckets hot bins
    above = lambda first, sums: {"bin": first + np.flatnonzero(sums > least), "bytes": sums[sums > least]}
    counted = add_up(source.select("text"), _bin_bytes(window, minimiser), BINS, 64, above, "bin bigint, bytes bigint")
    hot = sorted((r["bin"], -(-r["bytes"] // least)) for r in counted.collect())
    shared = spark.sparkContext.broadcast((np.array([b for b, _ in hot], np.int64), np.array([s for _, s in hot], np.int64)))
    sent = source.mapInArrow(_scatter(window, minimiser, buckets, shared), OUT)
    spans = _rounds(sent, _reduce(window, buckets, False), buckets)
    if hot:
        spans = _rounds(spans, _reduce(window, buckets, True), buckets)
    spans = stored(spans.select("ord", "th", "start", "end"), "spans")
    flagged = spark.sparkContext.broadcast(bits_of(spans.mapInArrow(_doc_flags, "flag int"), "flag"))  # FLAGS bits
    # a text's different spans, however many rows repeat it; stored, so that Spark can split the rows that share a key and text
    of_doc = spans.groupBy("ord", "th").agg(F.collect_set(F.struct("start", "end")).alias("__spans")).withColumnsRenamed({"ord": "__ord", "th": "__th"})
    of_doc = stored(of_doc, "spans")
    keyed = base.withColumns({"__ord": F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)), "__th": F.coalesce(F.xxhash64(text), F.lit(0))})
    schema = T.StructType([*base.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    joined = keyed.mapInArrow(_touched(flagged, True), keyed.schema).join(of_doc, ["__ord", "__th"], "left").drop("__ord", "__th")
    cut = _cut(text, base.columns)
    return keyed.mapInArrow(lambda batches: cut(_touched(flagged, False)(batches)), schema).unionAll(joined.mapInArrow(cut, schema))


def _doc_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ord_, th = batch.column("ord").to_numpy(), batch.column("th").to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(row_flag(ord_, th, np.zeros(len(ord_), np.int64))).astype(np.int32))], names=["flag"])


def _touched(flagged, yes: bool):
    """The rows that may have spans, or those that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = as_flags(flagged.value)
        for batch in batches:
            ord_, th = batch.column("__ord").to_numpy(), batch.column("__th").to_numpy()
            there = flags[row_flag(ord_, th, np.zeros(len(ord_), np.int64))] if len(ord_) else np.zeros(0, bool)
            yield batch.filter(pa.array(there == yes))

    return run


def _rounds(sent: DataFrame, reduce, buckets: int) -> DataFrame:
    """Packed super-k-mers to their parts and through `reduce`; spans pass it unchanged, spread evenly."""
    to = F.pmod(F.coalesce(F.col("part").cast("bigint"), F.xxhash64("ord", "th", "start")), F.lit(buckets).cast("bigint")).cast("int")
    return sent.repartitionById(buckets, to).mapInArrow(reduce, OUT)


def _cut(text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            data, offsets = utf8(piece.column(text))
            words = Words(data, offsets, NOT_SPACE)
            gone = np.zeros(len(words), bool)
            for d, spans in enumerate(piece.column("__spans").to_pylist() if "__spans" in piece.schema.names else []):
                if spans:
                    at = np.array([(s["start"], s["end"]) for s in spans])
                    a, b = words.first[d], words.first[d + 1]
                    gone[a:b] = covered(at[:, 0], at[:, 1], b - a)
            left = np.flatnonzero(~gone)
            first = np.searchsorted(left, words.first)
            size = (words.ends - words.starts)[left]
            at = np.concatenate([[0], np.cumsum(size + 1)])
            buffer = np.full(at[-1], 0x20, np.uint8)
            blanks = np.zeros(at[-1], bool)
            blanks[at[1:] - 1] = True
            buffer[~blanks] = gather(words.data, words.starts[left], size)
            raw = buffer.tobytes()
            kept = [raw[at[a] : max(at[a], at[b] - 1)].decode() for a, b in zip(first, first[1:])]
            n = np.diff(words.first)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(n, pa.int64()), pa.array(n - np.diff(first), pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept"])

    return run
