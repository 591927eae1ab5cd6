"""SimHash near-dedup: 64-bit fingerprints of word shingles, joined with themselves by walking a binary trie in pairs.

Equal fingerprints are one trie leaf, so copies never meet as pairs. Two fingerprints within `budget` differing bits agree
in one of budget + 1 bit blocks, so each block's value makes a group (in rotated bit order, block first). A group is a trie
over its sorted fingerprints, held implicitly: a node is a range of them. Node pairs are descended together from (root,
root); a pair is dropped as soon as its differing bits exceed the budget. A group of more than `most` fingerprints is cut
into slices by hash, and each pair of slices is a group of its own. A task returns a spanning forest of its links, not all
pairs. Components come from `components`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methlake.llm.components import components
from methlake.llm.flags import as_flags, bits_of, row_flag
from methlake.llm.packing import add_up, expand, expand_all, squeeze, squeeze_parts
from methlake.llm.shared import small_batches, stored
from methlake.llm.words import LOWER, NOT_SPACE, Words, mix, pieces, ranges, utf8

SHINGLE = 4
BUDGET = 4
#: Fingerprints of a group that one task takes; a larger group is sliced.
MOST = 20_000
#: Node pairs that are descended at a time.
FRONTIER = 1 << 18


def shingle_hashes(column: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text, and how many each text has."""
    data, offsets = utf8(column)
    found = Words(LOWER[data], offsets, NOT_SPACE)
    size = found.ends - found.starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    spaced = np.full(at[-1], 0x20, np.uint8)
    spaced[ranges(at[:-1], size)] = found.data[ranges(found.starts, size)]
    n = np.diff(found.first)
    count = np.where(n > 0, np.maximum(1, n - shingle + 1), 0)
    first_word = ranges(found.first[:-1], count)
    last_word = np.minimum(first_word + shingle, np.repeat(found.first[1:], count))
    joined, digest = spaced.tobytes(), xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(at[first_word].tolist(), (at[last_word] - 1).tolist())], np.uint64)
    return h, count


def majorities(h: np.ndarray, count: np.ndarray, words: int = 1) -> np.ndarray:
    """Fingerprints of 64 x words bits, text x word; the first word comes from the hashes themselves, others from mixes of them."""
    out = np.zeros((len(count), words), np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        first = np.concatenate([[0], np.cumsum(count[some])])
        for w in range(words):
            x = mix(h + np.uint64(w)) if w else h
            for bit in range(64):
                ones = np.concatenate([[0], np.cumsum((x >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
                out[some, w] |= (2 * (ones[first[1:]] - ones[first[:-1]]) > count[some]).astype(np.uint64) << np.uint64(bit)
    return out


def text_fingerprints(column: pa.Array, shingle: int, words: int = 1) -> np.ndarray:
    return majorities(*shingle_hashes(column, shingle), words)


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """docs with `simhash`, the fingerprint as a signed long; a text without words (or null) has 0."""
    small_batches(docs.sparkSession)
    kept = docs.drop("simhash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(text_fingerprints(piece.column(text), shingle)[:, 0].view(np.int64))], names=[*piece.schema.names, "simhash"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("simhash", T.LongType())]))


def blocks(budget: int) -> list[tuple[int, int]]:
    """(first bit, bits) of budget + 1 blocks of 64 bits."""
    cuts = [64 * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


class Forest:
    """Labels 0 .. n - 1 that are joined along links; a label's root is the least of its component."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.root[a], self.root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up


def trie_links(group: np.ndarray, prints: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span every group's components. group, prints (unsigned, place x word): sorted by both, distinct within a group."""
    n, bits = len(prints), 64 * prints.shape[1]
    forest = Forest(n)
    ones = np.zeros((bits, n + 1), np.int32)  # of the d-th bit from the highest, before each place
    for d in range(bits):
        np.cumsum((prints[:, d // 64] >> np.uint64(63 - d % 64)) & np.uint64(1), out=ones[d, 1:])
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if n else np.zeros(0, np.int64)
    last = np.append(first[1:], n)
    many = last - first > 1
    first, last = first[many], last[many]
    zero = np.zeros(len(first), np.int64)
    waiting = [(0, first, last, first, last, zero)]
    while waiting:
        depth, a0, a1, b0, b1, errors = waiting.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            waiting += [(depth, *(x[half:] for x in (a0, a1, b0, b1, errors))), (depth, *(x[:half] for x in (a0, a1, b0, b1, errors)))]
            continue
        same = a0 == b0
        if (close := same & (bits - depth <= budget)).any():  # all leaves below one node this deep are linked: a chain spans them
            chain = ranges(a0[close], a1[close] - a0[close] - 1)
            forest.join(chain, chain + 1)
            a0, a1, b0, b1, errors, same = (x[~close] for x in (a0, a1, b0, b1, errors, same))
        if (leaf := ~same & (a1 - a0 == 1) & (b1 - b0 == 1)).any():
            x, y = a0[leaf], b0[leaf]
            near = np.bitwise_count(prints[x] ^ prints[y]).sum(1, dtype=np.int64) <= budget
            forest.join(x[near], y[near])
            a0, a1, b0, b1, errors, same = (x[~leaf] for x in (a0, a1, b0, b1, errors, same))
        if depth == bits:
            forest.join(a0, b0)
            continue
        if not len(a0):
            continue
        am, bm = a1 - (ones[depth, a1] - ones[depth, a0]), b1 - (ones[depth, b1] - ones[depth, b0])
        kids = [(a0, am, b0, bm, errors, None), (am, a1, bm, b1, errors, None), (a0, am, bm, b1, errors + 1, None), (am, a1, b0, bm, errors + 1, ~same)]
        parts = []
        for c0, c1, d0, d1, e, only in kids:
            live = (c1 > c0) & (d1 > d0) & (e <= budget) & ((c0 != d0) | (c1 - c0 > 1))
            if only is not None:
                live &= only
            parts.append([x[live] for x in (c0, c1, d0, d1, e)])
        waiting.append((depth + 1, *(np.concatenate(x) for x in zip(*parts))))
    far = np.flatnonzero(forest.root != np.arange(n))
    return far, forest.root[far]


def _join_groups(budget: int):
    def work(group, prints, plain):
        far, root = trie_links(group, prints[:, None], budget)
        return pa.RecordBatch.from_arrays([pa.array(plain[far]), pa.array(plain[root])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:  # sorted by group and rotated print: whole groups are worked on as soon as enough are there
            held.append(tuple(batch.column(c).to_numpy() for c in ("group", "rotated", "simhash")))
            size += batch.num_rows
            if size >= MOST:
                group, rotated, plain = (np.concatenate(x) for x in zip(*held))
                cut = int(np.searchsorted(group, group[-1]))
                if cut:
                    yield work(group[:cut], _unsigned(rotated[:cut]), plain[:cut])
                held, size = [(group[cut:], rotated[cut:], plain[cut:])], len(group) - cut
        if size:
            group, rotated, plain = (np.concatenate(x) for x in zip(*held))
            yield work(group, _unsigned(rotated), plain)

    return run


def _unsigned(x: np.ndarray) -> np.ndarray:
    """Undoes the flipped sign bit that makes signed order equal unsigned order."""
    return x.view(np.uint64) ^ np.uint64(1 << 63)


def links(prints: DataFrame, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """prints: distinct `simhash`. Returns a, b: links that connect all prints within the budget, a forest per task."""
    x = F.col("simhash")
    turned = [F.struct(F.lit(i).alias("block"), (F.shiftleft(x, s).bitwiseOR(F.shiftrightunsigned(x, 64 - s)) if s else x).alias("turned"), F.lit(w).alias("width")) for i, (s, w) in enumerate(blocks(budget))]
    keyed = prints.select("simhash", F.explode(F.array(*turned)).alias("t")).select(
        "simhash", F.col("t.block").alias("block"), F.expr("shiftrightunsigned(t.turned, 64 - t.width)").alias("value"), F.col("t.turned").bitwiseXOR(F.lit(-(1 << 63))).alias("rotated")
    )
    # groups above `most`: few; whether to broadcast them is left to their size
    large = keyed.groupBy("block", "value").agg(F.count("*").alias("n")).where(F.col("n") > most).select("block", "value", F.ceil(F.col("n") / most).cast("int").alias("slices"))
    sliced = keyed.join(stored(large, "large"), ["block", "value"], "left")
    mine = F.pmod(F.xxhash64("simhash"), F.col("slices")).cast("int")
    pairs = F.when(F.col("slices").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.least(s, mine).cast("bigint") * F.col("slices") + F.greatest(s, mine))
    )
    tasks = sliced.select("simhash", "rotated", "block", "value", F.explode(pairs).alias("pair")).select(F.xxhash64("block", "value", "pair").alias("group"), "rotated", "simhash")
    return tasks.repartition("group").sortWithinPartitions("group", "rotated").mapInArrow(_join_groups(budget), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET, most: int = MOST) -> DataFrame:
    """key, simhash, component (least key that links reach) of every row of docs.

    Rows with null keys take part; a component of null keys only has the null component. Repeated rows are kept.
    """
    printed = stored(fingerprints(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), "text", shingle).select("key", "simhash"), "prints")
    least = printed.groupBy("simhash").agg(F.min("key").alias("least"))
    root = components(links(least.select("simhash"), budget, most))
    rooted = least.join(root.select(F.col("node").alias("simhash"), "root"), "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    rooted = stored(rooted, "rooted")  # tables, so that the join reads plain shuffles, of which Spark can split a large component
    component = stored(rooted.groupBy("root").agg(F.min("least").alias("component")), "component")
    named = rooted.join(component, "root").select("simhash", "component")
    return printed.join(named, "simhash", "left").select(F.col("key").alias(key), "simhash", "component")


# ---- documents of a given similarity ----------------------------------------------------------------
#
# Shingle sets of Jaccard similarity J differ in a share of arccos(2 J / (1 + J)) / pi of their bits on average: 15 % at
# 0.8. A budget of so many of 64 bits would prune nothing and could not be told from chance, so fingerprints are wider, and
# groups share sampled bits instead of a block. Fingerprints only nominate: the budget is a high quantile of the distance at
# the similarity, so that few similar pairs lie beyond it, and what is nominated is verified on the shingles themselves.

WIDE = 4  # words of 64 bits
COUNTERS, SLICES = 1 << 22, 64
ROW = [("group", np.uint64), ("id", np.int64), ("label", np.int64), *((f"w{i}", np.uint64) for i in range(WIDE))]
GROUP_ROWS = 500_000
#: Tables are met in rounds, since their number grows with the texts: rows that a round sends for each text, and rows that
#: are one round in any case. PACKED: rows that a task packs at a time.
ROUND, ROUND_ROWS, PACKED = 32, 8_000_000, 1 << 17
#: Tables whose links are verified before all tables are met.
FIRST = 8
#: Share of the pairs at just the similarity that lie within the budget whose links are taken as a forest.
CLOSE = 0.05
#: Pairs of fingerprints that are compared without further descent.
SMALL = 64
#: Words of 64 parities that bound how many shingles differ, and pairs whose parities are compared at a time.
PARITIES, COMPARED = 64, 1 << 13


def differing_share(similarity: float) -> float:
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def distances(similarity: float) -> np.ndarray:
    """Probability of each number of differing bits (binomial) of a pair at just the similarity."""
    bits, share = 64 * WIDE, differing_share(similarity)
    if not 0 < share < 1:
        return (np.arange(bits + 1) == round(bits * share)).astype(np.float64)
    d = np.arange(bits + 1)
    choose = np.array([math.lgamma(bits + 1) - math.lgamma(i + 1) - math.lgamma(bits - i + 1) for i in d])
    return np.exp(choose + d * math.log(share) + (bits - d) * math.log1p(-share))


def quantile(similarity: float, share: float) -> int:
    """The least number of differing bits that at least such a share of the pairs at just the similarity do not exceed."""
    return int(np.searchsorted(np.cumsum(distances(similarity)), share))


def sampled_bits(n: int, similarity: float, missed: float, seed: int) -> np.ndarray:
    """Bit numbers, table x bit, for n fingerprints: so many tables that pairs at just the similarity, over the whole
    distribution of their distances, share no table with a probability of `missed` at most."""
    k = min(24, max(8, math.ceil(math.log2(max(n, 2))) - 2))
    weight, meets = distances(similarity), (1 - np.arange(64 * WIDE + 1) / (64 * WIDE)) ** k
    tables = 1
    while weight @ (1 - meets) ** tables > missed:
        tables += 1
    random = np.random.default_rng(seed)
    return np.array([np.sort(random.choice(64 * WIDE, k, replace=False)) for _ in range(tables)])


def trie_pairs(group: np.ndarray, prints: np.ndarray, label: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of one group and different labels within the budget; rows are as in `trie_links`, or equal in part."""
    n, bits = len(prints), 64 * prints.shape[1]
    if not n:
        return
    ones: dict[int, np.ndarray] = {}  # as in `trie_links`, of the bits that are reached: most groups are small
    turns = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])  # a range of places without turns has one label
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    last = np.append(first[1:], n)
    waiting = [(0, first, last, first, last, np.zeros(len(first), np.int64))]
    while waiting:
        depth, *nodes = waiting.pop()
        if len(nodes[0]) > FRONTIER:
            half = len(nodes[0]) // 2
            waiting += [(depth, *(x[half:] for x in nodes)), (depth, *(x[:half] for x in nodes))]
            continue
        a0, a1, b0, b1, _ = nodes
        one = (label[a0] == label[b0]) & (turns[a0] == turns[a1 - 1]) & (turns[b0] == turns[b1 - 1])
        nodes = [x[~one] for x in nodes]
        a0, a1, b0, b1, _ = nodes
        done = ((a1 - a0) * (b1 - b0) <= SMALL) | (depth == bits)
        size = ((a1 - a0) * (b1 - b0))[done]
        total = np.cumsum(size)
        cut = 0
        while cut < len(size):  # a bounded number of pairs at a time
            to = max(cut + 1, int(np.searchsorted(total, (total[cut - 1] if cut else 0) + FRONTIER, "right")))
            mine = np.flatnonzero(done)[cut:to]
            node = np.repeat(mine, size[cut:to])
            k = ranges(np.zeros(to - cut, np.int64), size[cut:to])
            width = (b1 - b0)[node]
            x, y = a0[node] + k // width, b0[node] + k % width
            keep = (x < y) | (a0[node] != b0[node])
            x, y = x[keep], y[keep]
            keep = label[x] != label[y]
            x, y = x[keep], y[keep]
            near = np.bitwise_count(prints[x] ^ prints[y]).sum(1, dtype=np.int64) <= budget
            if near.any():
                yield x[near], y[near]
            cut = to
        a0, a1, b0, b1, errors = (x[~done] for x in nodes)
        if not len(a0):
            continue
        same = a0 == b0
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((prints[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1), dtype=np.int32)])
        before = ones[depth]
        am, bm = a1 - (before[a1] - before[a0]), b1 - (before[b1] - before[b0])
        kids = [(a0, am, b0, bm, errors, None), (am, a1, bm, b1, errors, None), (a0, am, bm, b1, errors + 1, None), (am, a1, b0, bm, errors + 1, ~same)]
        parts = []
        for c0, c1, d0, d1, e, only in kids:
            live = (c1 > c0) & (d1 > d0) & (e <= budget) & ((c0 != d0) | (c1 - c0 > 1))
            if only is not None:
                live &= only
            parts.append([x[live] for x in (c0, c1, d0, d1, e)])
        waiting.append((depth + 1, *(np.concatenate(x) for x in zip(*parts))))


def table_groups(prints: np.ndarray, bits: np.ndarray, first: int = 0) -> np.ndarray:
    """Group of each fingerprint in each table; first: the number of the first table."""
    flat = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    power = np.uint64(1) << np.arange(bits.shape[1], dtype=np.uint64)
    value = np.stack([flat[:, b].astype(np.uint64) @ power for b in bits], axis=1)
    return mix(value + (np.arange(first, first + len(bits), dtype=np.uint64) << np.uint64(32)))


def _prints(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), WIDE)


def _group_counts(bits: np.ndarray):
    def found(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            if batch.num_rows:
                yield (table_groups(_prints(batch.column("print")), bits).ravel() & np.uint64(COUNTERS - 1)).astype(np.int64), None

    return found


def _tables(bits: np.ndarray, first: int, crowds, buckets: int, most: int, alone: bool):
    """Fingerprints by bucket of groups, packed; only groups that others share; large ones as a group for each pair of
    slices, or for each slice `alone`."""

    def packed(prints: np.ndarray, ids: np.ndarray, roots: np.ndarray) -> pa.RecordBatch:
        labels = ids ^ roots  # zero, which packs well, where a fingerprint is its own label
        group = table_groups(prints, bits, first)
        which, table = np.nonzero(crowds.value[(group & np.uint64(COUNTERS - 1)).astype(np.int64)] > 1)
        g = group[which, table]
        slices = _slices(crowds.value[(g & np.uint64(COUNTERS - 1)).astype(np.int64)], most)
        mine = (mix(ids[which].view(np.uint64)) % slices.astype(np.uint64)).astype(np.int64)
        again = np.arange(len(which)) if alone else np.repeat(np.arange(len(which)), slices)
        other = mine if alone else ranges(np.zeros(len(which), np.int64), slices)
        pair = np.minimum(mine[again], other) * slices[again] + np.maximum(mine[again], other)
        g, which = mix(g[again] + pair.astype(np.uint64)), which[again]
        order = np.argsort(g)
        g, which = g[order], which[order]
        bucket = ((g >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(g) else bucket
        rows = squeeze_parts([g, ids[which], labels[which], *prints[which].T], cut) if len(g) else []
        return pa.RecordBatch.from_arrays([pa.array(bucket[cut].astype(np.int32)), pa.array(rows, pa.binary())], names=["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append((_prints(batch.column("print")), batch.column("id").to_numpy(), batch.column("root").to_numpy()))
            size += batch.num_rows * len(bits)
            if size >= PACKED:
                yield packed(*(np.concatenate(x) for x in zip(*held)))
                held, size = [], 0
        if size:
            yield packed(*(np.concatenate(x) for x in zip(*held)))

    return run


def _slices(crowds: np.ndarray, most: int) -> np.ndarray:
    """Into how many slices groups are cut, by the length in bits of their sizes."""
    return np.maximum(1, (1 << crowds.astype(np.int64)) // most)


def _picked(pairs: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of pairs of places, with their costs (below 2^30), the cheapest of each kind of place that has any: the kinds, the
    pair's places, and whether a kind has more than one. And the least kind that pairs reach from each kind."""
    n, none = int(kind.max(initial=-1)) + 1, np.iinfo(np.int64).max
    best, count, forest = np.full(n, none >> 32), np.zeros(n, np.int64), Forest(n)
    ends = np.zeros((2, n), np.int64)
    for x, y, cost in pairs:
        packed = cost.astype(np.int64) << 32 | np.arange(len(x))
        for a, b in ((x, y), (y, x)):
            now = np.full(n, none)
            np.minimum.at(now, kind[a], packed)
            better = np.flatnonzero(now >> 32 < best)
            pick = now[better] & 0xFFFFFFFF
            best[better], ends[0, better], ends[1, better] = now[better] >> 32, a[pick], b[pick]
            count += np.bincount(kind[a], minlength=n)
        forest.join(kind[x], kind[y])
    at = np.flatnonzero(count)
    return at, ends[0, at], ends[1, at], count[at] > 1, forest.root


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """group, id, label and print, sorted by group and print: whole groups, some thousand fingerprints at a time."""
    held = [expand_all(raw, [kind for _, kind in ROW]) for batch in batches for raw in batch.column("rows").to_pylist()]
    if not held:
        return
    group, ids, labels, *words = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.lexsort([*words[::-1], group])
    group, ids, labels, prints = group[order], ids[order], labels[order] ^ ids[order], np.stack(words, axis=1)[order]
    at = 0
    while at < len(group):
        to = int(np.searchsorted(group, group[min(at + MOST, len(group)) - 1], "right"))
        yield group[at:to], ids[at:to], labels[at:to], prints[at:to]
        at = to


def _measured(pairs: Iterator[tuple[np.ndarray, np.ndarray]], prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    return ((x, y, np.bitwise_count(prints[x] ^ prints[y]).sum(1, dtype=np.int64)) for x, y in pairs)


def _join_first(close: int, budget: int):
    """Pairs that likely link: a forest of the links within `close`, and of the pairs within the budget that it leaves apart
    each fingerprint's nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, ids, _, prints in _chunks(batches):
            far, root = trie_links(group, prints, close)
            yield _pairs(ids[far], ids[root])
            label = np.arange(len(ids))
            label[far] = root
            _, x, y, *_ = _picked(_measured(trie_pairs(group, prints, label, budget), prints), np.arange(len(ids)))
            yield _pairs(ids[x], ids[y])

    return run


def _join_labels(budget: int):
    """Of the pairs within the budget whose labels differ, the nearest of each label in a group; `more` where it has others.
    Rows that are not `asked` only tell which labels hang together by pairs."""

    def rows(a, b, to_a, to_b, more: bool, asked: bool) -> pa.RecordBatch:
        ends = np.unique(np.where(a < b, [a, b, to_a, to_b], [b, a, to_b, to_a]), axis=1)
        return pa.RecordBatch.from_arrays([*(pa.array(x) for x in ends), *(pa.array(np.full(ends.shape[1], x)) for x in (more, asked))], names=["a", "b", "a_label", "b_label", "more", "asked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, ids, labels, prints in _chunks(batches):
            order = np.lexsort([labels, group])
            new = np.ones(len(order), bool)
            new[1:] = (group[order[1:]] != group[order[:-1]]) | (labels[order[1:]] != labels[order[:-1]])
            kind, name = np.empty(len(order), np.int64), labels[order[new]]
            kind[order] = np.cumsum(new) - 1
            at, x, y, more, reach = _picked(_measured(trie_pairs(group, prints, labels, budget), prints), kind)
            for some in (False, True):
                i, j = x[more == some], y[more == some]
                yield rows(ids[i], ids[j], labels[i], labels[j], some, True)
            at = at[more & (reach[at] != at)]
            yield rows(name[at], name[reach[at]], name[at], name[reach[at]], False, False)

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    ends = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def _parities(shingle: int):
    """Each text's number of distinct shingles, and for each of PARITIES x 64 classes of shingles whether their number is odd.

    As many parities as differ, so many shingles at least are in one of two texts only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            h, count = shingle_hashes(piece.column("text"), shingle)
            sizes, rows, at = [], [], 0
            for n in count.tolist():
                kinds = mix(np.unique(h[at : at + n]))
                at += n
                odd = np.bincount((kinds >> np.uint64(32)).astype(np.int64) % (PARITIES * 64), minlength=PARITIES * 64) & 1
                sizes.append(len(kinds))
                rows.append(np.packbits(odd.astype(np.uint8)).tobytes())
            yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(sizes, pa.int64()), pa.array(rows, pa.binary())], names=["id", "size", "parities"])

    return run


def _join_clusters(budget: int, similarity: Fraction, every: bool):
    """Pairs of a group and of different labels within the budget whose parities leave the similarity possible: all of them,
    or each fingerprint's likeliest. Rows come sorted by group."""
    apart, total = similarity.denominator - similarity.numerator, similarity.denominator + similarity.numerator

    def possible(pairs, size: np.ndarray, parities: np.ndarray):
        for x, y in pairs:
            for at in range(0, len(x), COMPARED):
                a, b = x[at : at + COMPARED], y[at : at + COMPARED]
                differ, both = np.bitwise_count(parities[a] ^ parities[b]).sum(1, dtype=np.int64), size[a] + size[b]
                keep = differ * total <= both * apart
                if keep.any():
                    yield a[keep], b[keep], (differ[keep] << 20) // both[keep]

    def work(group, ids, labels, size, prints, parities) -> Iterator[pa.RecordBatch]:
        prints = np.frombuffer(b"".join(prints), np.uint64).reshape(-1, WIDE)
        order = np.lexsort([*prints.T[::-1], group])
        group, ids, labels, size, prints = (x[order] for x in (group, ids, labels, size, prints))
        parities = np.frombuffer(b"".join(parities), np.uint64).reshape(-1, PARITIES)[order]
        pairs = possible(trie_pairs(group, prints, labels, budget), size, parities)
        if every:
            yield from (_pairs(ids[x], ids[y]) for x, y, _ in pairs)
        else:
            _, x, y, *_ = _picked(pairs, np.arange(len(ids)))
            yield _pairs(ids[x], ids[y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([*(batch.column(c).to_numpy() for c in ("group", "id", "label", "size")), *(np.array(batch.column(c).to_pylist(), object) for c in ("print", "parities"))])
            size += batch.num_rows
            if size >= MOST:
                columns = [np.concatenate(x) for x in zip(*held)]
                cut = int(np.searchsorted(columns[0], columns[0][-1]))
                if cut:
                    yield from work(*(c[:cut] for c in columns))
                held, size = [[c[cut:] for c in columns]], size - cut
        if size:
            yield from work(*(np.concatenate(x) for x in zip(*held)))

    return run


def _wide(text: str, shingle: int):
    """Each row's fingerprint of its distinct shingles, and their set's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            h, count = shingle_hashes(piece.column(text), shingle)
            owner = np.repeat(np.arange(len(count)), count)
            order = np.lexsort([h, owner])
            h, owner = h[order], owner[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, count = h[new], np.bincount(owner[new], minlength=len(count))
            ids, some = np.zeros(len(count), np.uint64), np.flatnonzero(count)
            if len(some):
                ids[some] = mix(np.add.reduceat(mix(h), np.cumsum(count[some]) - count[some]) + count[some].astype(np.uint64))
            prints = majorities(h, count, WIDE)
            yield pa.RecordBatch.from_arrays(
                [piece.column("key"), piece.column("th"), pa.array(ids.view(np.int64)), pa.array([p.tobytes() for p in prints], pa.binary())], names=["key", "th", "id", "print"]
            )

    return run


def _flag(ids: np.ndarray) -> np.ndarray:
    zero = np.zeros(len(ids), np.int64)
    return row_flag(ids, zero, zero)


def _flagged(pairs: DataFrame, names: list[str]) -> bytes:
    """Flags of the ids in the columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in names:
                yield pa.RecordBatch.from_arrays([pa.array(_flag(batch.column(name).to_numpy()).astype(np.int32))], names=["flag"])

    return bits_of(pairs.select(*names).mapInArrow(run, "flag int"), "flag")


def _wanted(flags):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = as_flags(flags.value)
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(have[_flag(batch.column("th").to_numpy())]))

    return run


def shingles(text: bytes, shingle: int) -> set:
    words = text.lower().split()
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()


def _jaccard(shingle: int, similarity: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple] = {}  # the last set of either side

        def of(side: str, text: bytes) -> set:
            if side not in held or held[side][0] != text:
                held[side] = text, shingles(text, shingle)
            return held[side][1]

        for batch in batches:
            similar = []
            for x, y in zip(batch.column("text").to_pylist(), batch.column("to_text").to_pylist()):
                x, y = of("a", x), of("b", y)
                common = len(x & y)
                similar.append(common * similarity.denominator >= similarity.numerator * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similar, pa.bool_())], names=["a", "b", "similar"])

    return run


def wanted(texts: DataFrame, some: DataFrame) -> DataFrame:
    """The rows of texts (th, text) whose th some has, and few others; no text is sent anywhere."""
    flags = texts.sparkSession.sparkContext.broadcast(_flagged(some, ["th"]))  # FLAGS bits
    return texts.mapInArrow(_wanted(flags), "th bigint, text binary")


def _texts(texts: DataFrame, nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """id, text of the ids. texts: th, text; nodes: id, th."""
    ends = stored(nodes.join(ids, "id").select("id", "th"), "ends")
    return stored(wanted(texts, ends).dropDuplicates(["th"]).join(ends, "th").select("id", "text"), "texts")


def _verified(texts: DataFrame, pairs: DataFrame, shingle: int, similarity: Fraction) -> DataFrame:
    """a, b and `similar`, decided on the shingles. texts: id, text."""
    both = pairs.join(texts.withColumnRenamed("id", "a"), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("to_text")), "b")
    return stored(both.mapInArrow(_jaccard(shingle, similarity), "a bigint, b bigint, similar boolean"), "similar")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()


def _merged(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with their `root` after links between ids: the least root that the links reach."""
    roots = nodes.select("id", "root")
    ends = links.join(roots.toDF("a", "a_root"), "a").join(roots.toDF("b", "b_root"), "b").where("a_root <> b_root")
    ends = stored(ends.select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), "apart")
    if ends.isEmpty():
        return nodes
    least = components(ends).select(F.col("node").alias("root"), F.col("root").alias("__least"))
    return stored(nodes.join(least, "root", "left").withColumn("root", F.coalesce("__least", "root")).drop("__least"), "rooted")


def similar_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, missed: float = 0.01, most: int = 4096, seed: int = 3) -> DataFrame:
    """key, print (256 bits), component (least key that links reach) of every row of docs.

    Texts are linked whose sets of shingles have a Jaccard similarity of `similarity` or more, decided on the shingles. A
    pair at just the similarity is never compared with a probability of about `missed` (half of it for the tables of sampled
    bits, half for the bit budget), a closer one nearly never. Nulls, empty texts and repeated rows are as in `near_duplicates`.

    In the `FIRST` tables close fingerprints are verified along a forest of their links, others with their nearest. What links
    has one label from then on, so that a large group of near copies is few labels when all tables are met: there each
    label's nearest of another label is verified, and a label that has more than that is open, as is all that hangs together
    with it. Within these clusters pairs of different labels are verified, if their shingles' parities leave the similarity
    possible: first the likeliest of each fingerprint, then all that are still of different labels, so nothing rests on the
    choices. Pairs to verify thus grow with the fingerprints, not with the pairs of a group. All tables are met in rounds of
    some of them, since their number grows with the texts and a round's exchange is gone before the next one's is written.
    """
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("text"))
    return similar_prints(wide_prints(rows, shingle), rows, shingle, similarity, missed, most, seed).withColumnRenamed("key", key)


def wide_prints(rows: DataFrame, shingle: int = 5) -> DataFrame:
    """key, th, id (hash of the set of shingles) and print of rows (key, th, text)."""
    small_batches(rows.sparkSession)
    kind = rows.schema["key"].dataType.simpleString()
    return stored(rows.mapInArrow(_wide("text", shingle), f"key {kind}, th bigint, id bigint, print binary"), "wide")


def similar_prints(printed: DataFrame, texts: DataFrame, shingle: int = 5, similarity: float = 0.8, missed: float = 0.01, most: int = 4096, seed: int = 3) -> DataFrame:
    """`similar_documents` of rows whose fingerprints are there, as `wide_prints` gives them: key, print, component. texts
    has th and text of all of them, and may have more."""
    spark = printed.sparkSession
    small_batches(spark)
    exact = Fraction(str(similarity))
    nodes = stored(printed.groupBy("id").agg(F.min("key").alias("least"), F.min("th").alias("th"), F.min("print").alias("print")), "distinct")
    texts = texts.select("th", "text").where("text IS NOT NULL")
    n = nodes.count()
    bits = sampled_bits(n, similarity, missed / 2, seed)
    close, budget = quantile(similarity, CLOSE) - 1, quantile(similarity, 1 - missed / 2)

    def finish(first: int, sums: np.ndarray) -> dict:
        marks = np.minimum(31, np.frexp(sums.astype(np.float64))[1]).astype(np.uint8)
        total = int((sums * _slices(marks, most))[sums > 1].sum())
        return {"first": pa.array([first]), "bits": pa.array([squeeze(marks)], pa.binary()), "total": pa.array([total])}

    crowds, total = np.zeros(COUNTERS, np.uint8), 0
    for row in add_up(nodes.select("print"), _group_counts(bits), COUNTERS, SLICES, finish, "first bigint, bits binary, total bigint").collect():  # SLICES rows
        got = expand(bytes(row["bits"]), np.uint8)
        crowds[row["first"] : row["first"] + len(got)] = got
        total += row["total"]
    shared = spark.sparkContext.broadcast(crowds)

    def sent(rows: DataFrame, some: np.ndarray, first: int, alone: bool) -> DataFrame:
        buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * len(some) // len(bits) // GROUP_ROWS))
        return rows.select("id", "root", "print").mapInArrow(_tables(some, first, shared, buckets, most, alone), "bucket int, rows binary").repartitionById(buckets, F.col("bucket"))

    def linked(known: DataFrame, pairs: DataFrame) -> DataFrame:
        return _verified(known, pairs.select("a", "b"), shingle, exact).where("similar").select("a", "b")

    rooted = nodes.withColumn("root", F.col("id"))
    met = stored(sent(rooted, bits[:FIRST], 0, True).mapInArrow(_join_first(close, budget), "a bigint, b bigint").distinct(), "pairs")
    rooted = _merged(rooted, linked(_texts(texts, nodes, _ends(met)), met))
    ends = ["a", "b", "a_label", "b_label"]
    kinds, told = ", ".join(f"{c} bigint" for c in ends) + ", more boolean, asked boolean", [F.max(c).alias(c) for c in ("more", "asked")]
    at_once = max(1, max(ROUND * n, ROUND_ROWS) * len(bits) // max(1, total))
    rounds = [stored(sent(rooted, bits[at : at + at_once], at, False).mapInArrow(_join_labels(budget), kinds).groupBy(*ends).agg(*told), "met") for at in range(0, len(bits), at_once)]
    met = stored(reduce(DataFrame.unionAll, rounds).groupBy(*ends).agg(*told), "pairs")
    asked, open_ = met.where("asked"), met.where("more")
    links = linked(_texts(texts, nodes, _ends(asked)), asked)
    if not open_.isEmpty():
        tree = stored(components(met.select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))), "tree")
        clusters = tree.join(open_.select(F.col("a_label").alias("node")).distinct(), "node").select("root").distinct()
        left = tree.join(stored(clusters, "clusters"), "root").select(F.col("node").alias("root"), F.col("root").alias("cluster"))
        left = stored(rooted.select("id", "print", "root").join(left, "root").drop("root"), "open")
        slices = stored(left.groupBy("cluster").agg(F.ceil(F.count("*") / most).cast("int").alias("slices")), "slices")
        some = _texts(texts, nodes, left.select("id"))
        bounds = some.mapInArrow(_parities(shingle), "id bigint, size bigint, parities binary")
        left = stored(left.join(slices, "cluster").join(bounds, "id"), "bounds")
        mine = F.pmod(F.xxhash64("id"), F.col("slices")).cast("int")
        units = F.transform(F.sequence(F.lit(0), F.col("slices") - 1), lambda s: F.least(s, mine).cast("bigint") * F.col("slices") + F.greatest(s, mine))
        for every in (False, True):
            rooted = _merged(rooted, links)
            rows = left.join(rooted.select("id", "root"), "id").withColumn("unit", F.explode(units)).select(F.xxhash64("cluster", "unit").alias("group"), "id", F.col("root").alias("label"), "size", "print", "parities")
            met = rows.repartition("group").sortWithinPartitions("group").mapInArrow(_join_clusters(budget, exact, every), "a bigint, b bigint")
            links = linked(some, stored(met.distinct(), "pairs"))
    rooted = _merged(rooted, links)  # stored, as in near_duplicates
    component = stored(rooted.groupBy("root").agg(F.min("least").alias("component")), "component")
    named = rooted.join(component, "root").select("id", "component")
    return printed.join(named, "id", "left").select("key", "print", "component")
