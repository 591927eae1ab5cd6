"""Line dedup by an exact set-similarity join on the lines' word sets.

A line (of at least `least` different words) is removed if an earlier line - of a smaller key, or further up in the same
text - has a Jaccard similarity of `threshold` or more with it. Lines are judged on the input.

1. Words are counted over all texts in hashed counters of fixed number; a word's order is its count's logarithm, then hash.
2. Each line sends an entry for each word of its prefix, |x| - ceil(t |x|) + 1 rarest words (words that occur once in the
   corpus cannot match). Entries travel packed by bucket of words, with the line's size, the word's position and a parity
   signature of the set.
3. Within a word, entries of equal sets collapse onto the earliest. The others are compared with earlier ones inside the
   length filter; the positional filter and the signatures bound the overlap. A line reports its likeliest partner only,
   and how many it had. A word with many entries is cut into slices by line; each pair of slices is a unit of work.
4. Partners are verified on the words themselves. Lines whose likeliest partner fails although there were others send all
   of their partners in one more pass over their words' entries, so nothing rests on the choice.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methlake.llm.flags import FLAGS, as_flags, bits_of, row_flag
from methlake.llm.packing import add_up, expand, expand_all, squeeze, squeeze_all, squeeze_parts
from methlake.llm.shared import small_batches, stored
from methlake.llm.words import NOT_SPACE, Words, counted, gather, grouped, mix, pieces, ranges, release, utf8

THRESHOLD = Fraction(4, 5)
LEAST = 1
COUNTERS = 1 << 22
SLICES = 64  # of the counters, for adding them up
#: Entries of a bucket, about, and entries of one word that a unit of work takes (a power of two).
BUCKET_ENTRIES = 500_000
MOST = 4_096
PAIRS = 1 << 17
PIECE = 1 << 20
BLOCK = 1 << 13  # lines sorted at a time: 13 bits of line and 51 of word make one sortable number
WORD_BITS = 51
LAST = 2**63 - 1

#: What a line sends with a prefix word: a hash of the word's unit of work, where the line is, its set's size, the word's
#: position, 128 parities of hashed words, and a hash of the whole set.
ENTRY = [("unit", np.uint64), ("ord", np.int64), ("th", np.int64), ("line", np.int32), ("size", np.int32), ("pos", np.int32), ("sign", np.uint64), ("sign2", np.uint64), ("sid", np.uint32)]
#: Bits of a unit's hash that travel; where two units agree in them, lines are only compared in vain.
UNIT = np.uint64(((1 << 40) - 1) << 24)


class Lines:
    """The lines of some texts: words by line, and each line's text and number."""

    def __init__(self, column: pa.Array):
        data, offsets = utf8(column)
        ends = np.flatnonzero(data == 10)
        text_of = np.searchsorted(offsets, ends, "right") - 1
        count = np.bincount(text_of, minlength=len(offsets) - 1) if len(offsets) > 1 else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.cumsum(count + 1)]).astype(np.int64)
        start = np.empty(self.first[-1] + 1, np.int64)
        start[self.first[:-1]] = offsets[:-1]
        start[np.arange(len(ends)) + text_of + 1] = ends + 1
        start[-1] = len(data)
        self.start, self.data = start, data
        self.text_of = np.repeat(np.arange(len(offsets) - 1), count + 1)
        self.number = np.arange(self.first[-1]) - self.first[self.text_of]
        self.stop = np.append(start[1:-1], len(data)) if len(start) > 1 else start[:0]
        self.stop = np.where(np.append(self.text_of[1:] == self.text_of[:-1], False) if len(self.text_of) else np.zeros(0, bool), self.stop - 1, self.stop)

    @functools.cached_property
    def words(self) -> Words:
        return Words(self.data, self.start, NOT_SPACE)

    def some(self, at: np.ndarray) -> pa.Array:
        """The lines of these numbers, as bytes."""
        lengths = self.stop[at] - self.start[at]
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(gather(self.data, self.start[at], lengths))]).cast(pa.binary())


def word_ids(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """51 bits that sort rare words first: 5 of the count's logarithm, 46 of the hash."""
    kind = classes[(hashes & np.uint64(COUNTERS - 1)).astype(np.int64)].astype(np.uint64)
    return kind << np.uint64(46) | hashes >> np.uint64(18)


def prefix(size: np.ndarray, t: Fraction) -> np.ndarray:
    return size - _ceil(size * t.numerator, t.denominator) + 1


def overlap(a: np.ndarray, b: np.ndarray, t: Fraction) -> np.ndarray:
    """Common words that sets of sizes a and b need."""
    return _ceil((a + b) * t.numerator, t.numerator + t.denominator)


def _ceil(a, b):
    return -(-a // b)


def line_sets(lines: Lines, classes: np.ndarray, least: int, flags=None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(line numbers in the piece, word ids in order, first id of each line), blocks of lines of at least so many words; with
    flags only lines that have a flagged word."""
    count = np.diff(lines.words.first)
    able = np.flatnonzero(count >= least)
    if not len(able):
        return
    ids = word_ids(lines.words.hashes(), classes)
    if flags is not None:
        before = np.concatenate([[0], np.cumsum(flags[(mix(ids) % np.uint64(FLAGS)).astype(np.int64)])])[lines.words.first]
        able = able[before[able + 1] > before[able]]
    for at in range(0, len(able), BLOCK):
        some = able[at : at + BLOCK]
        mine = ids[ranges(lines.words.first[some], count[some])]
        key = counted(np.repeat(np.arange(len(some)), count[some]).astype(np.uint64) << np.uint64(WORD_BITS) | mine)[0]
        owner = (key >> np.uint64(WORD_BITS)).astype(np.int64)
        word = key & np.uint64((1 << WORD_BITS) - 1)
        size = np.bincount(owner, minlength=len(some))
        keep = size >= least
        word = word[keep[owner]]
        yield some[keep], word, np.concatenate([[0], np.cumsum(size[keep])])


def _seen(classes, least: int, t: Fraction):
    """Counters of the words, or with `classes` of the prefix words, of all texts of a task."""

    def found(batches: Iterator[pa.RecordBatch]):
        for piece in pieces(batches, "text", PIECE):
            if classes is None:
                data, offsets = utf8(piece.column("text"))
                yield (Words(data, offsets, NOT_SPACE).hashes() & np.uint64(COUNTERS - 1)).astype(np.int64), None
                continue
            for _, word, first in line_sets(Lines(piece.column("text")), classes.value, least):
                yield (mix(word[ranges(first[:-1], prefix(np.diff(first), t))]) & np.uint64(COUNTERS - 1)).astype(np.int64), None

    return found


def word_counts(texts: DataFrame, classes, least: int, t: Fraction) -> tuple[np.ndarray, int]:
    """For each counter the bits of its count (0: none, 1: one); and the sum of the counts above one."""

    def finish(first: int, sums: np.ndarray) -> dict:
        bits = np.minimum(31, np.frexp(sums.astype(np.float64))[1]).astype(np.uint8)
        return {"first": pa.array([first]), "bits": pa.array([squeeze(bits)], pa.binary()), "total": pa.array([int(sums[sums > 1].sum())])}

    out, total = np.zeros(COUNTERS, np.uint8), 0
    for row in add_up(texts.select("text"), _seen(classes, least, t), COUNTERS, SLICES, finish, "first bigint, bits binary, total bigint").collect():  # SLICES rows
        bits = expand(bytes(row["bits"]), np.uint8)
        out[row["first"] : row["first"] + len(bits)] = bits
        total += row["total"]
    return out, total


def _entries(classes, crowds, wanted, buckets: int, least: int, t: Fraction):
    """Packed prefix entries by bucket. crowds: bits of the entries a counter got. wanted: flags of words, if not all are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = None if wanted is None else as_flags(wanted.value)
        for piece in pieces(batches, "text", PIECE):
            ords, ths = piece.column("ord").to_numpy(), piece.column("th").to_numpy()
            lines = Lines(piece.column("text"))
            for line, word, first in line_sets(lines, classes.value, least, flags):
                size = np.diff(first)
                if not len(size):
                    continue
                h = mix(word)
                sid = np.add.reduceat(h, first[:-1])
                parity, upper = np.uint64(1) << (h >> np.uint64(57) & np.uint64(63)), h >> np.uint64(63) == 1
                sign = np.bitwise_xor.reduceat(np.where(upper, np.uint64(0), parity), first[:-1])
                sign2 = np.bitwise_xor.reduceat(np.where(upper, parity, np.uint64(0)), first[:-1])
                text = lines.text_of[line]
                at = ranges(first[:-1], prefix(size, t))
                crowd = crowds.value[(h[at] & np.uint64(COUNTERS - 1)).astype(np.int64)]
                keep = crowd > 1  # else no other line has the word in its prefix
                if flags is not None:
                    keep &= flags[(h[at] % np.uint64(FLAGS)).astype(np.int64)]
                at, crowd = at[keep], crowd[keep].astype(np.int64)
                owner = np.searchsorted(first, at, "right") - 1
                pos = at - first[owner]
                unit = h[at]
                # words of too many entries: a unit for each pair of slices, and an entry in all units of its slice
                slices = np.maximum(1, (1 << crowd) // MOST)
                mine = row_flag(ords[text[owner]], ths[text[owner]], lines.number[line[owner]]) % slices
                other = ranges(np.zeros(len(at), np.int64), slices)
                again = np.repeat(np.arange(len(at)), slices)
                pair = np.minimum(mine[again], other) * slices[again] + np.maximum(mine[again], other)
                unit, owner, pos = mix(unit[again] + pair.astype(np.uint64)) & UNIT, owner[again], pos[again]
                bucket = ((unit >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                order = np.argsort(unit)  # a bucket is a range of units
                unit, owner, pos, bucket = unit[order], owner[order], pos[order], bucket[order]
                columns = (unit, ords[text[owner]], ths[text[owner]], lines.number[line[owner]], size[owner], pos, sign[owner], sign2[owner], sid[owner] >> np.uint64(32))
                cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
                columns = [c.astype(kind, copy=False) for c, (_, kind) in zip(columns, ENTRY)]
                rows = squeeze_parts(columns, cut)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "entries"])

    return run


def _unpacked(raw: bytes, columns: list) -> list[np.ndarray]:
    return [c.astype(np.int64) if c.dtype == np.uint32 else c for c in expand_all(raw, [kind for _, kind in columns])]


#: What two lines make: the later one, the earlier one, how likely they are similar, and of how many partners this is one.
LINK = [("ord", np.int64), ("th", np.int64), ("line", np.int32), ("to_ord", np.int64), ("to_th", np.int64), ("to_line", np.int32), ("likely", np.int32), ("partners", np.int64)]
PAIR = "ord bigint, th bigint, line int, to_ord bigint, to_th bigint, to_line int, likely int, partners bigint, flag int, to_flag int"


def _earlier(a: np.ndarray, b: np.ndarray, ord_: np.ndarray, line: np.ndarray) -> np.ndarray:
    """Is entry a's line earlier than entry b's?"""
    return (ord_[a] < ord_[b]) | ((ord_[a] == ord_[b]) & (line[a] < line[b]))


def match(word, ord_, th, line, size, pos, sign, sign2, sid, t: Fraction, every=None) -> list[np.ndarray]:
    """Columns of LINK: each line's likeliest earlier partner among the entries of the same unit and how many there were; all
    with `every`, flags of the entries that want them all."""
    by_rank = reading_order(ord_, line)
    rank = np.empty(len(word), np.int64)
    rank[by_rank] = np.arange(len(word))
    # by unit, then size, then (so that equal sets mostly meet) a few bits of the set's hash: 40, 16 and 8 bits
    bits = mix(sign ^ mix(sign2 + sid.astype(np.uint64))) & np.uint64(255)
    if len(size) and size.max() > 0xFFFF:
        order = np.lexsort([bits, size, word])
    else:
        order = np.argsort(word & UNIT | size.astype(np.uint64) << np.uint64(8) | bits)
    word, ord_, th, line, size, pos, sign, sign2, sid, rank = (x[order] for x in (word, ord_, th, line, size, pos, sign, sign2, sid, rank))
    n = len(word)
    by_rank = np.empty(n, np.int64)
    by_rank[rank] = np.arange(n)
    new = np.concatenate([[True], (word[1:] != word[:-1]) | (size[1:] != size[:-1]) | (sign[1:] != sign[:-1]) | (sign2[1:] != sign2[:-1]) | (sid[1:] != sid[:-1])]) if n else np.zeros(0, bool)
    start = np.flatnonzero(new)
    head = by_rank[np.repeat(np.minimum.reduceat(rank, start), np.diff(np.append(start, n)))] if n else start  # the earliest of equal sets
    same = head != np.arange(n)
    copy = np.flatnonzero(same)
    later_copy = _earlier(head[copy], copy, ord_, line)
    copy, twin = copy[later_copy], copy[~later_copy]  # twins are rows of one key at one line: what the head's set is like, theirs is too
    # what is kept of each line: its best partner so far, as its likelihood and the partner's place in reading order
    best, partners, every_pair = np.full(n, -1, np.int64), np.zeros(n, np.int64), []

    def offer(later: np.ndarray, first: np.ndarray, likely: np.ndarray) -> None:
        if every is not None:
            keep = asked[later]
            every_pair.append((later[keep], first[keep], likely[keep]))
            return
        np.maximum.at(best, later, likely << 32 | (0xFFFFFFFF - rank[first]))
        np.add.at(partners, later, 1)

    wanted = None if every is None else every[order]
    if wanted is not None:
        twin = twin[wanted[twin]]
        twin = twin[np.argsort(head[twin])]
        asked = wanted.copy()
        asked[head[twin]] = True
    offer(copy, head[copy], np.full(len(copy), 1000))
    own = np.flatnonzero(~same)  # by word, then size
    if len(own):
        w, s = word[own], size[own]
        begin = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        lengths = np.diff(np.append(begin, len(own)))
        last = np.repeat(begin + lengths, lengths)
        # partners are no shorter than the entry itself: up to size / t
        key = np.repeat(np.arange(len(begin)), lengths) * (1 << 32)
        far = np.searchsorted(key + s, key + s * t.denominator // t.numerator, "right")
        count = np.minimum(far, last) - np.arange(len(own)) - 1
        cut = 0
        total = np.cumsum(count)
        while cut < len(own):  # a bounded number of pairs at a time
            to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + PAIRS, "right")))
            a = np.repeat(np.arange(cut, to), count[cut:to])
            b = ranges(np.arange(cut, to) + 1, count[cut:to])
            a, b = own[a], own[b]
            need = overlap(size[a], size[b], t)
            most = np.minimum(size[a] - pos[a], size[b] - pos[b])  # the word and what follows; an earlier common word has its own unit
            differ = np.bitwise_count(sign[a] ^ sign[b]).astype(np.int64) + np.bitwise_count(sign2[a] ^ sign2[b])
            most = np.minimum(most, (size[a] + size[b] - differ) // 2)
            fit = most >= need
            a, b, differ = a[fit], b[fit], differ[fit]
            swap = rank[a] < rank[b]
            later, first = np.where(swap, b, a), np.where(swap, a, b)
            common = (size[a] + size[b] - differ) // 2
            likely = 1000 * common // (size[a] + size[b] - common)
            apart = _earlier(first, later, ord_, line)  # not rows of one key at one line
            offer(later[apart], first[apart], likely[apart])
            cut = to
    if every is None:
        best[twin], partners[twin] = best[head[twin]], partners[head[twin]]
        later = np.flatnonzero(best >= 0)
        first, likely, partners = by_rank[0xFFFFFFFF - (best[later] & 0xFFFFFFFF)], best[later] >> 32, partners[later]
    else:
        later, first, likely = (np.concatenate(x) for x in zip(*every_pair))
        lead, keep = head[twin], wanted[later]
        at = np.searchsorted(lead, later)
        n_twins = np.searchsorted(lead, later, "right") - at
        later = np.concatenate([later[keep], twin[ranges(at, n_twins)]])
        first, likely = (np.concatenate([x[keep], np.repeat(x, n_twins)]) for x in (first, likely))
        partners = np.ones(len(later), np.int64)
    columns = [ord_[later], th[later], line[later], ord_[first], th[first], line[first], likely, partners]
    columns = [c.astype(kind) for c, (_, kind) in zip(columns, LINK)]
    return columns if every is not None else likeliest(columns)


def reading_order(ord_: np.ndarray, line: np.ndarray) -> np.ndarray:
    """The order of documents, and of lines within a document."""
    order, first = grouped(ord_)
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
    return np.argsort(group << 32 | line)


def likeliest(columns: list[np.ndarray]) -> list[np.ndarray]:
    """One link for each later line, of the earliest among its likeliest partners; partners are added up."""
    ord_, th, line, to_ord, _, to_line, likely, _ = columns
    order = np.lexsort([to_line, to_ord, -likely, line, th, ord_])
    columns = [c[order] for c in columns]
    ord_, th, line = columns[:3]
    if not len(ord_):
        return columns
    top = np.flatnonzero(np.concatenate([[True], (ord_[1:] != ord_[:-1]) | (th[1:] != th[:-1]) | (line[1:] != line[:-1])]))
    partners = np.add.reduceat(columns[7], top)
    return [*(c[top] for c in columns[:7]), partners]


def _matched(t: Fraction, wanted, buckets: int):
    """A bucket's entries to links, packed by the later line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpacked(raw, ENTRY) for batch in batches for raw in batch.column("entries").to_pylist()]
        if not held:
            return
        columns = [np.concatenate(x) for x in zip(*held)]
        held.clear()
        links = match(*columns, t=t, every=None if wanted is None else as_flags(wanted.value)[row_flag(*columns[1:4])])
        columns.clear()
        release()
        bucket = row_flag(*links[:3]) % buckets
        order, cut = grouped(bucket)
        rows = [squeeze_all([c[mine] for c in links]) for mine in np.split(order, cut[1:])] if len(order) else []
        yield pa.RecordBatch.from_arrays([pa.array(bucket[order][cut].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "links"])

    return run


def _gathered(every: bool):
    """All links of a bucket's lines to one for each line, or to the distinct ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [_unpacked(raw, LINK) for batch in batches for raw in batch.column("links").to_pylist()]
        if not held:
            return
        columns = [np.concatenate(x) for x in zip(*held)]
        if every:
            order = np.lexsort(columns[5::-1])
            columns = [c[order] for c in columns]
            new = np.zeros(len(order), bool)
            new[:1] = True
            for c in columns[:6]:
                new[1:] |= c[1:] != c[:-1]
            columns = [c[new] for c in columns]
        else:
            columns = likeliest(columns)
        flags = [row_flag(*columns[:3]).astype(np.int32), row_flag(*columns[3:6]).astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in [*columns, *flags]], names=[x.split()[0] for x in PAIR.split(", ")])

    return run


def _lines_of(wanted):
    """The flagged lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = as_flags(wanted.value)
        for piece in pieces(batches, "text", PIECE):
            ords, ths = piece.column("ord").to_numpy(), piece.column("th").to_numpy()
            lines = Lines(piece.column("text"))
            ord_, th = ords[lines.text_of], ths[lines.text_of]
            at = np.flatnonzero(flags[row_flag(ord_, th, lines.number)]) if len(ord_) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ord_[at]), pa.array(th[at]), pa.array(lines.number[at].astype(np.int32)), lines.some(at)], names=["ord", "th", "line", "words"])

    return run


def _verify(classes, least: int, t: Fraction):
    """similar, decided on the words themselves; and, for lines that have other partners to try, flags of their prefix words."""
    names = ["ord", "th", "line", "flag", "partners"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, similar = batch.column("words").to_pylist(), []
            for a, b in zip(own, batch.column("to_words").to_pylist()):
                same = a == b
                if not same:
                    x, y = set(a.split()), set(b.split())
                    common = len(x & y)
                    same = common * t.denominator >= t.numerator * (len(x) + len(y) - common)
                similar.append(same)
            flags: list[list[int]] = [[] for _ in own]
            again = [i for i, (s, n) in enumerate(zip(similar, batch.column("partners").to_pylist())) if not s and n > 1]
            for line, word, first in line_sets(Lines(pa.array([own[i] for i in again], pa.binary())), classes.value, least):
                for k, a, n in zip(line.tolist(), first.tolist(), prefix(np.diff(first), t).tolist()):
                    flags[again[k]] = (mix(word[a : a + n]) % np.uint64(FLAGS)).astype(np.int32).tolist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(similar, pa.bool_()), pa.array(flags, pa.list_(pa.int32()))], names=[*names, "similar", "again"])

    return run


def _verified(source: DataFrame, pairs: DataFrame, classes, least: int, t: Fraction, name: str) -> DataFrame:
    spark = source.sparkSession
    wanted = spark.sparkContext.broadcast(bits_of(pairs.select(F.explode(F.array("flag", "to_flag")).alias("flag")), "flag"))  # FLAGS bits
    texts = source.mapInArrow(_lines_of(wanted), "ord bigint, th bigint, line int, words binary").distinct()  # by all columns: hashed, where the first words of a key would be sorted
    texts = stored(texts, "texts")  # so that the joins read plain shuffles, of which AQE can split a line with many partners
    left = pairs.join(texts.select(F.col("ord").alias("to_ord"), F.col("th").alias("to_th"), F.col("line").alias("to_line"), F.col("words").alias("to_words")), ["to_ord", "to_th", "to_line"])
    both = left.join(texts, ["ord", "th", "line"]).select("ord", "th", "line", "flag", "partners", "words", "to_words")
    return stored(both.mapInArrow(_verify(classes, least, t), "ord bigint, th bigint, line int, flag int, partners bigint, similar boolean, again array<int>"), name)


def repeated(source: DataFrame, t: Fraction, least: int, bucket_entries: int = BUCKET_ENTRIES) -> DataFrame:
    """source: ord, th, text, texts not null. Returns ord, th, line of the lines to remove."""
    spark = source.sparkSession
    share = spark.sparkContext.broadcast
    classes = share(word_counts(source, None, least, t)[0])  # COUNTERS bytes, as are crowds
    bits, total = word_counts(source, classes, least, t)
    crowds = share(bits)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_entries))

    def links(words, every) -> DataFrame:
        sent = source.mapInArrow(_entries(classes, crowds, words, buckets, least, t), "bucket int, entries binary").repartitionById(buckets, F.col("bucket"))
        met = sent.mapInArrow(_matched(t, every, buckets), "bucket int, links binary").repartitionById(buckets, F.col("bucket"))
        return stored(met.mapInArrow(_gathered(every is not None), PAIR), "links")

    verdicts = _verified(source, links(None, None), classes, least, t, "verdicts")
    found = verdicts.where("similar")
    open_ = verdicts.where("NOT similar AND partners > 1")
    if not open_.isEmpty():
        every = share(bits_of(open_, "flag"))
        words = share(bits_of(open_.select(F.explode("again").alias("word")), "word"))
        found = found.unionAll(_verified(source, links(words, every), classes, least, t, "verdicts2").where("similar"))
    return found.select("ord", "th", "line").distinct()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", out: str = "kept", threshold: Fraction = THRESHOLD, least: int = LEAST) -> DataFrame:
    """docs with n_lines, n_removed and `out`, the text without its repeated lines; out may be the text column itself.

    Lines are what "\n" separates. Lines of fewer than `least` different words are never removed and never a reason to
    remove. key: integers; a null key comes after all others; rows that share a key are one document at the same lines. A
    null text has no lines and stays null. Columns of docs that have the names of the three are replaced.
    """
    small_batches(docs.sparkSession)
    base = docs.drop("n_lines", "n_removed", "__ord", "__th", "__gone", *([out] if out != text else []))
    keys = {"__ord": F.coalesce(F.col(key).cast("bigint"), F.lit(LAST)), "__th": F.xxhash64(text)}  # the text tells rows of one key apart
    source = docs.select(keys["__ord"].alias("ord"), keys["__th"].alias("th"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    gone = repeated(source, threshold, least).groupBy("ord", "th").agg(F.collect_list("line").alias("__gone")).withColumnsRenamed({"ord": "__ord", "th": "__th"})
    gone = stored(gone, "gone")  # so that Spark can split the rows that share a key and text
    joined = base.withColumns(keys).join(gone, ["__ord", "__th"], "left").drop("__ord", "__th")
    rest = [f for f in base.schema.fields if f.name != out]
    schema = T.StructType([*rest, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField(out, T.StringType())])
    return joined.mapInArrow(_cut(text, [f.name for f in rest], out), schema)


def _cut(text: str, names: list[str], kept_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, PIECE):
            old, gone = piece.column(text), piece.column("__gone")
            total = pc.fill_null(pc.add(pc.count_substring(old, "\n").cast(pa.int64()), 1), 0)
            cut = pc.greater(pc.fill_null(pc.list_value_length(gone), 0), 0)  # other texts stay as they are
            removed, kept = np.zeros(len(old), np.int64), []
            for at, x, lines in zip(np.flatnonzero(cut), old.filter(cut).to_pylist(), gone.filter(cut).to_pylist()):
                out = set(lines)
                removed[at] = len(out)
                kept.append("\n".join(p for i, p in enumerate(x.split("\n")) if i not in out))
            made = [total, pa.array(removed), pc.replace_with_mask(old, cut, pa.array(kept, old.type))]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), *made], names=[*names, "n_lines", "n_removed", kept_name])

    return run
