"""Which stretches of alignment files a scan has to read, cut and packed into even partitions.

An index tells where records of a region can lie. Its stretches are cut at record beginnings that the index itself names, so
no search is needed, and the pieces of all files are packed by cost, the largest first, each into the partition that holds
least so far. Done once, while Spark plans the scan; tasks never read an index.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterable
from dataclasses import dataclass, field

from methlake.sources.bam_index import Index, merge_chunks

#: What opening a stretch costs beside its bytes, in bytes: a seek and the rest of a block.
SEEK = 64 << 10
#: Pieces a partition is packed from, about.
PIECES = 8


@dataclass
class Piece:
    """Records that begin in [begin, end) of a file (virtual positions). whole: reports the file's extent."""

    path: str
    begin: int
    end: int
    whole: bool = False

    @property
    def cost(self) -> int:
        return SEEK + (self.end >> 16) - (self.begin >> 16)


@dataclass
class Wanted:
    """Regions of one file by reference number: closed [begin, end] for reads that overlap, `starting` for positions."""

    regions: dict[int, list[tuple[int, int]]] = field(default_factory=dict)

    def chunks(self, index: Index) -> list[tuple[int, int]]:
        return merge_chunks([c for rid, parts in self.regions.items() for b, e in parts for c in index.chunks(rid, b, e + 1)])


def merged_regions(regions: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Closed regions in order, those that touch as one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(regions):
        if out and b <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def record_starts(index: Index) -> list[int]:
    """Virtual positions at which the index says that a record begins."""
    found = {a for r in index.refs for chunks in r.bins.values() for a, _ in chunks}
    found.update(x for r in index.refs for x in (*r.linear, *r.starts.values()) if x)
    return sorted(found)


def pieces(path: str, chunks: list[tuple[int, int]], starts: list[int], most: int) -> list[Piece]:
    """The stretches cut at record beginnings into pieces of about `most` compressed bytes."""
    out = []
    for begin, end in chunks:
        inner = starts[bisect_right(starts, begin) : bisect_left(starts, end)]
        while (end >> 16) - (begin >> 16) > most and inner:
            # the last beginning within `most` bytes, or the first behind them
            k = max(0, bisect_right(inner, ((begin >> 16) + most) << 16) - 1)
            out.append(Piece(path, begin, inner[k]))
            begin, inner = inner[k], inner[k + 1 :]
        out.append(Piece(path, begin, end))
    return out


def pack(items: list[Piece], target: int, count: int | None = None) -> list[list[Piece]]:
    """Partitions of about `target` cost, or `count` of them (some may be empty): the dearest piece first, into the least loaded."""
    n = count or max(1, -(-sum(p.cost for p in items) // max(1, target)))
    loads = [(0, k) for k in range(n)]
    bins: list[list[Piece]] = [[] for _ in range(n)]
    for p in sorted(items, key=lambda p: (-p.cost, p.path, p.begin)):
        load, k = heapq.heappop(loads)
        bins[k].append(p)
        heapq.heappush(loads, (load + p.cost, k))
    return [sorted(b, key=lambda p: (p.path, p.begin)) for b in bins]
