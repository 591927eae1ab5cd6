"""Periodic runs of words, by Baier grouping.

Method: phase one of Baier's suffix sorter keeps the words of a text in groups whose members share a Lyndon prefix. The
greatest group is taken off again and again; what precedes its members grows by them and forms a group right above its old
one, by how many of them follow it. A member's prefix at the time it is taken off is the longest Lyndon word that begins
there, so the Lyndon array comes without a suffix array. Done under an order of the words and under its inverse, this gives
a root of every run (the runs theorem); roots that repeat are extended to both sides by longest common extensions.

* Words are numbered per piece of the scan by a dictionary, so comparisons are exact; any order of them will do.
* Texts of like length go through the grouping side by side, each step taking one group off each of them in numpy. Where few
  texts are left for a batch (very long ones), the same steps run over plain lists (`lyndon_of_one`).
* Extensions are looked up by prefix hashes, then confirmed word by word; a run that is not confirmed is extended anew
  without hashes.
* Scan only: no shuffle, and a task holds one piece of texts. Every text goes through whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methlake.llm.shared import small_batches
from methlake.llm.words import NOT_SPACE, Words, _powers, covered, gather, mix, pieces, ranges, utf8

LEAST = 24
EXPONENT = 3
PIECE = 4 << 20
#: Words that go through the grouping side by side, and the least number of texts for which numpy's steps pay.
BATCH_WORDS = 1 << 18
SIDE_BY_SIDE = 64
#: Longest text of a batch by its shortest.
ALIKE = 2.2

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])


def lyndon(rank: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each place of each text; text d is rank[first[d]:first[d + 1]]."""
    n, texts = len(rank), len(first) - 1
    length = np.ones(n, np.int64)
    if not n:
        return length
    text_of = np.repeat(np.arange(texts), np.diff(first))
    at = np.argsort(text_of * (int(rank.max()) + 1) + rank, kind="stable").astype(np.int64)  # places by text and group
    slot = np.empty(n, np.int64)
    slot[at] = np.arange(n, dtype=np.int64)
    new = np.concatenate([[True], (rank[at[1:]] != rank[at[:-1]]) | (text_of[at[1:]] != text_of[at[:-1]])])
    begin = np.flatnonzero(new)
    size = np.zeros(n, np.int64)
    size[begin] = np.diff(np.append(begin, n))
    group = np.empty(n, np.int64)  # a group is named by its first slot
    group[at] = np.repeat(begin, size[begin])
    # neighbours among what has not been taken off; the last entry takes what is written beyond an end
    left, right = np.arange(-1, n, dtype=np.int64), np.arange(1, n + 2, dtype=np.int64)
    edge = first[:-1][np.diff(first) > 0]
    left[edge] = -1
    right[np.append(edge[1:], n) - 1] = n
    taken, moved = np.zeros(n + 1, np.int64), np.zeros(n, np.int64)
    low = first[:-1]
    top = first[1:] - 1
    live = top >= low
    low, top, step = low[live], top[live], 0
    while len(top):
        step += 1
        g = group[at[top]]
        alone = g == top
        # groups of one: one member a text, so no chains, and what grows is alone in its text
        mine = at[top[alone]]
        before, after = left[mine], right[mine]
        right[before], left[after] = after, before
        left[n] = -1
        grown = before >= 0
        before = before[grown]
        length[before] += length[mine[grown]]
        old, was = group[before], slot[before]
        to = old + size[old] - 1  # it goes to the end of its old group
        there = at[to]
        at[was], slot[there] = there, was
        at[to], slot[before], group[before] = before, to, to
        size[old] -= 1
        size[to] = 1
        if len(mine) < len(top):
            many = ~alone
            mine = np.sort(at[ranges(g[many], (top - g)[many] + 1)])
            taken[mine] = step
            before = left[mine]
            head = taken[before] != step  # before is -1 at a text's first place: the spare entry, never taken
            opens = np.flatnonzero(head)
            count = np.diff(np.append(opens, len(mine)))
            before = before[opens]
            last = mine[opens + count - 1]
            after = right[last]
            right[before], left[after] = after, before
            left[n] = -1
            grown = before >= 0
            before, count, width = before[grown], count[grown], length[mine[opens[grown]]]
            if len(before):
                length[before] += count * width
                old = group[before]
                order = np.lexsort([count, old]) if count.max() > 1 else np.argsort(old)
                before, count, old = before[order], count[order], old[order]
                is_group = np.concatenate([[True], old[1:] != old[:-1]])
                of = np.flatnonzero(is_group)
                total = np.diff(np.append(of, len(old)))
                start = old[of] + size[old[of]] - total
                to = ranges(start, total)
                moved[before] = step
                there = at[to]
                there = there[moved[there] != step]
                was = slot[before]
                free = was[was < np.repeat(start, total)]
                at[free], slot[there] = there, free
                at[to], slot[before] = before, to
                parts = np.flatnonzero(is_group | np.concatenate([[True], count[1:] != count[:-1]]))
                sizes = np.diff(np.append(parts, len(old)))
                size[old[of]] -= total
                size[to[parts]] = sizes
                group[before] = np.repeat(to[parts], sizes)
        top = g - 1
        live = top >= low
        if not live.all():
            low, top = low[live], top[live]
    return length


def lyndon_of_one(rank: np.ndarray) -> np.ndarray:
    """The same for one text, a group at a time over plain lists."""
    n = len(rank)
    at = np.argsort(rank, kind="stable").tolist()
    ranked = rank.tolist()
    slot, group, size = [0] * n, [0] * n, [0] * (n + 1)
    g = 0
    for s, i in enumerate(at):
        if s and ranked[i] != ranked[at[s - 1]]:
            g = s
        slot[i], group[i] = s, g
        size[g] += 1
    length, left, right = [1] * n, list(range(-1, n)), list(range(1, n + 2))
    top = n - 1
    while top >= 0:
        g = group[at[top]]
        if g == top:  # a group of one: what precedes it goes alone to the end of its old group
            i, top = at[top], top - 1
            j, after = left[i], right[i]
            right[j], left[after] = after, j
            if j >= 0:
                length[j] += length[i]
                old, was = group[j], slot[j]
                to = old + size[old] - 1
                other = at[to]
                at[was], slot[other] = other, was
                at[to], slot[j], group[j] = j, to, to
                size[old] -= 1
                size[to] = 1
            continue
        found: dict[int, int] = {}  # what precedes members -> how many of them
        mine = sorted(at[g : top + 1])
        width = length[mine[0]]
        for i in mine:  # from the left: members before it are unlinked already, so `left` is what precedes them all
            before = left[i]
            right[before], left[right[i]] = right[i], before
            if before >= 0:
                found[before] = found.get(before, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, k in found.items():
            length[j] += k * width
            by_count.setdefault(k, []).append(j)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, list[int]] = {}
            for j in by_count[k]:
                moved.setdefault(group[j], []).append(j)
            for old, some in moved.items():  # to the end of their old group; those of greater counts lie beyond it
                to = old + size[old]
                for j in some:
                    to -= 1
                    other, was = at[to], slot[j]
                    at[was], slot[other] = other, was
                    at[to], slot[j] = j, to
                size[old] -= len(some)
                size[to] = len(some)
                for j in some:
                    group[j] = to
        top = g - 1
    return np.array(length, np.int32)


class Extensions:
    """Longest common extensions inside texts, by hashes of everything before a place."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        power, self.inverse = _powers(len(ids) + 1)
        self.total = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * power[:-1], out=self.total[1:])

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (self.total[a + size] - self.total[a]) * self.inverse[a] == (self.total[b + size] - self.total[b]) * self.inverse[b]

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from b on, `most` at most."""
        return self._search(most, lambda k: self.equal(a, b, k))

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        return self._search(most, lambda k: self.equal(a - k, b - k, k))

    @staticmethod
    def _search(most: np.ndarray, same) -> np.ndarray:
        low, high = np.zeros(len(most), np.int64), most.astype(np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            yes = same(mid)
            low, high = np.where(yes, mid, low), np.where(yes, high, mid - 1)
        return low

    def spans_repeat(self, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
        """Do all words of these runs equal those a period later? By the words themselves."""
        size = length - period
        at = ranges(start, size)
        same = self.ids[at] == self.ids[at + np.repeat(period, size)]
        return np.minimum.reduceat(same, np.cumsum(size) - size) if len(at) else np.ones(len(start), bool)

    def by_words(self, a: int, b: int, most: int, step: int) -> int:
        """forward (step 1) or backward (step -1) of one pair without hashes."""
        k, block = 0, 64
        while k < most:
            size = min(block, most - k)
            x = slice(a + k, a + k + size) if step > 0 else slice(a - k - size, a - k)
            y = slice(b + k, b + k + size) if step > 0 else slice(b - k - size, b - k)
            differ = np.flatnonzero(self.ids[x] != self.ids[y])
            if len(differ):
                return k + int(differ[0] if step > 0 else size - 1 - differ[-1])
            k, block = k + size, 2 * block
        return k


def runs_of(ids: np.ndarray, first: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, ...]:
    """(text, start in the text, length, period) of all runs of length >= max(least, exponent x period), by text, start, period.

    exponent: 3 at least, so that a root of every run is followed by itself.
    """
    if exponent < 3:
        raise ValueError("exponent must be 3 or more")
    sizes = np.diff(first)
    roots = [np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int32)]
    by_size = np.argsort(sizes, kind="stable")
    by_size = by_size[sizes[by_size] >= max(least, exponent)]
    edges = np.cumsum(sizes[by_size])
    cut = 0
    while cut < len(by_size):
        before = int(edges[cut - 1]) if cut else 0
        alike = int(np.searchsorted(sizes[by_size], ALIKE * sizes[by_size[cut]], "right"))
        to = max(cut + 1, min(alike, int(np.searchsorted(edges, before + BATCH_WORDS, "right"))))
        some = np.sort(by_size[cut:to])
        flat = ranges(first[some], sizes[some])
        part = ids[flat]
        bounds = np.concatenate([[0], np.cumsum(sizes[some])])
        both = np.concatenate([part, part.max() - part])  # the order and its inverse, as texts of their own
        if len(some) >= SIDE_BY_SIDE:
            found = lyndon(both, np.concatenate([bounds, bounds[1:] + bounds[-1]]))
        else:
            found = np.concatenate([lyndon_of_one(r[a:b]) for r in np.split(both, 2) for a, b in zip(bounds, bounds[1:])])
        roots[0][flat], roots[1][flat] = np.split(found, 2)
        cut = to
    end = np.repeat(first[1:], sizes)
    found = Extensions(ids)
    which = [np.flatnonzero((p > 0) & (np.arange(len(ids)) + 2 * p.astype(np.int64) <= end)) for p in roots]
    place, period = np.concatenate(which), np.concatenate([p[w] for p, w in zip(roots, which)]).astype(np.int64)
    again = found.equal(place, place + period, period)
    place, period = place[again], period[again]
    text = np.searchsorted(first, place, "right") - 1
    right = found.forward(place, place + period, first[text + 1] - place - period)
    left = found.backward(place, place + period, place - first[text])
    start, length = place - left, left + period + right
    sure = found.spans_repeat(start, length, period)
    for i in np.flatnonzero(~sure).tolist():  # different words under one hash
        a, p, t = int(place[i]), int(period[i]), int(text[i])
        r = found.by_words(a, a + p, int(first[t + 1]) - a - p, 1)
        b = found.by_words(a, a + p, a - int(first[t]), -1)
        start[i], length[i] = a - b, b + p + r
    keep = length >= np.maximum(least, exponent * period)
    rows = np.unique(np.stack([text[keep], start[keep] - first[text[keep]], period[keep], length[keep]], 1), axis=0)
    return rows[:, 0], rows[:, 1], rows[:, 3], rows[:, 2]


def joined(words: Words, keep: np.ndarray) -> list[str]:
    """The kept words of each text, joined by one space."""
    left = np.flatnonzero(keep)
    first = np.searchsorted(left, words.first)
    size = (words.ends - words.starts)[left]
    at = np.concatenate([[0], np.cumsum(size + 1)])
    buffer = np.full(at[-1], 0x20, np.uint8)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    buffer[inside] = gather(words.data, words.starts[left], size)
    raw = buffer.tobytes()
    return [raw[at[a] : max(at[a], at[b] - 1)].decode() for a, b in zip(first, first[1:])]


def find(docs: DataFrame, text: str = "text", least: int = LEAST, exponent: int = EXPONENT, keep_text: bool = True) -> DataFrame:
    """docs with n_words, `runs` (array of start, length, period; by start, then period) and `collapsed`.

    A run is a stretch of consecutive words with smallest period p (words p apart are equal) and length >= max(least,
    exponent x p) that no neighbouring word extends. `collapsed` holds the words outside what follows a run's first period,
    joined by one space. A null or empty text has no words, no runs and an empty `collapsed`; repeated rows are judged each
    by itself; columns of docs that have the names of the three are replaced. Without keep_text the text column goes.
    """
    small_batches(docs.sparkSession)
    base = docs.drop("n_words", "runs", "collapsed")
    fields = [f for f in base.schema.fields if keep_text or f.name != text]
    names = [f.name for f in fields]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text, PIECE):
            data, offsets = utf8(piece.column(text))
            words = Words(data, offsets, NOT_SPACE)
            ids = words.encoded().dictionary_encode().indices.to_numpy().astype(np.int64)
            owner, start, length, period = runs_of(ids, words.first, least, exponent)
            gone = covered(words.first[owner] + start + period, words.first[owner] + start + length, len(words)) if len(owner) else np.zeros(len(words), bool)
            spans = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], names=["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(piece.num_rows + 1)), pa.int32()), spans)
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(np.diff(words.first), pa.int64()), lists, pa.array(joined(words, ~gone), pa.string())], names=[*names, "n_words", "runs", "collapsed"])

    return base.mapInArrow(run, schema)
