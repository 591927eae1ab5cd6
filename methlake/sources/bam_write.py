"""Small alignment files from rows of reads, for exchange and for checks of the scan."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd

from methlake.sources.bam_index import BAI_DEPTH, BAI_SHIFT, metadata_bin, region_bin

BLOCK_BYTES = 60_000  # inflated bytes of a block; its size field holds 16 bits


def bgzf_block(data: bytes, level: int = 6) -> bytes:
    """One block: a gzip member whose extra field BC holds its size less one."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    extra = b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(data), len(data))


def record_bytes(read: dict) -> bytes:
    """A record of contig (a number), pos, flag, l_seq, cigar (packed), seq (packed), mm and ml; without qualities."""
    cigar = [int(c) for c in read["cigar"]]
    fixed = struct.pack("<iiBBHHHiiii", int(read["contig"]), int(read["pos"]), 2, 255, 0, len(cigar), int(read["flag"]), int(read["l_seq"]), -1, -1, 0)
    tags = b"MMZ" + read["mm"].encode() + b"\0" + b"MLBC" + struct.pack("<I", len(read["ml"])) + bytes(read["ml"])
    body = fixed + b"r\0" + struct.pack(f"<{len(cigar)}I", *cigar) + bytes(read["seq"]) + b"\xff" * int(read["l_seq"]) + tags
    return struct.pack("<i", len(body)) + body


def alignment_bytes(refs: list[tuple[str, int]], reads: list[dict]) -> bytes:
    """A whole file: header, records and the empty block that ends it."""
    return indexed_bytes(refs, reads)[0]


def alignment_head(refs: list[tuple[str, int]]) -> bytes:
    head = b"BAM\x01" + struct.pack("<ii", 0, len(refs))
    for name, length in refs:
        head += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", length)
    return head


def indexed_bytes(refs: list[tuple[str, int]], reads: list[dict], level: int = 6) -> tuple[bytes, bytes]:
    """A whole file and its BAI index; for the index, reads must come by contig and pos."""
    head = alignment_head(refs)
    records = [record_bytes(r) for r in reads]
    data = b"".join(records)
    blocks = [bgzf_block(part, level) for part in (head, *(data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)), b"")]
    starts = [0]
    for block in blocks:
        starts.append(starts[-1] + len(block))

    def virtual(at: int) -> int:
        return starts[1 + at // BLOCK_BYTES] << 16 | at % BLOCK_BYTES if at < len(data) else starts[-2] << 16

    bins: list[dict[int, list[list[int]]]] = [{} for _ in refs]
    linear: list[dict[int, int]] = [{} for _ in refs]
    counted, at = [0] * len(refs), 0
    for read, record in zip(reads, records):
        begin, end, rid = virtual(at), virtual(at + len(record)), int(read["contig"])
        at += len(record)
        pos = int(read["pos"])
        stop = pos + max(1, sum(int(c) >> 4 for c in read["cigar"] if int(c) & 15 in (0, 2, 3, 7, 8)))
        chunks = bins[rid].setdefault(region_bin(pos, stop), [])
        if chunks and chunks[-1][1] == begin:
            chunks[-1][1] = end
        else:
            chunks.append([begin, end])
        for slot in range(pos >> BAI_SHIFT, (stop - 1 >> BAI_SHIFT) + 1):
            linear[rid].setdefault(slot, begin)
        counted[rid] += 1
    index = b"BAI\x01" + struct.pack("<i", len(refs))
    for found, slots, n in zip(bins, linear, counted):
        index += struct.pack("<i", len(found) + bool(found))
        for number, chunks in found.items():
            index += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks)
        if found:
            ends = [c for chunks in found.values() for c in chunks]
            index += struct.pack("<IiQQQQ", metadata_bin(BAI_DEPTH), 2, min(c[0] for c in ends), max(c[1] for c in ends), n, 0)
        index += struct.pack("<i", max(slots, default=-1) + 1)
        for slot in range(max(slots, default=-1) + 1):
            index += struct.pack("<Q", slots.get(slot, 0))
    return b"".join(blocks), index + struct.pack("<Q", 0)


# ---- many reads at once -------------------------------------------------------------------------------

CSI_DEPTH = 6  # 16 kb slots and six levels address 2^32 places


def record_matrix(reads: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The records of `record_bytes` one after the other, and where each begins (with the end of the last); reads of one shape are laid out together."""
    parts = {c: reads[c].map(len).to_numpy(np.int64) for c in ("cigar", "seq", "mm", "ml")}
    l_seq = reads["l_seq"].to_numpy(np.int64)
    sizes = 4 + 32 + 2 + 4 * parts["cigar"] + parts["seq"] + l_seq + 3 + parts["mm"] + 1 + 8 + parts["ml"]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(starts[-1], np.uint8)
    for (cigar, seq, mm, ml, bases), rows in reads.groupby([parts["cigar"], parts["seq"], parts["mm"], parts["ml"], l_seq]).indices.items():
        some, m = reads.iloc[rows], len(rows)

        def numbers(values, kind: str) -> np.ndarray:
            return np.ascontiguousarray(values, kind).reshape(m, -1).view(np.uint8)

        def same(data: bytes) -> np.ndarray:
            return np.tile(np.frombuffer(data, np.uint8), (m, 1))

        def joined(values) -> np.ndarray:
            return np.frombuffer(b"".join(values), np.uint8).reshape(m, -1)

        record = np.hstack([
            numbers(sizes[rows] - 4, "<i4"), numbers(some["contig"], "<i4"), numbers(some["pos"], "<i4"),
            same(struct.pack("<BBHH", 2, 255, 0, cigar)), numbers(some["flag"], "<u2"), same(struct.pack("<iiii", bases, -1, -1, 0) + b"r\0"),
            numbers(np.stack(some["cigar"].to_numpy()), "<u4"), joined(map(bytes, some["seq"])), same(b"\xff" * bases + b"MMZ"),
            joined(t.encode() for t in some["mm"]), same(b"\0MLBC" + struct.pack("<I", ml)), joined(map(bytes, some["ml"])),
        ])
        out[starts[rows][:, None] + np.arange(record.shape[1])] = record
    return out, starts


def csi_bytes(refs: int, rid: np.ndarray, pos: np.ndarray, stop: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    """A CSI index of reads by contig and pos: it grows with the reads, wherever they lie, and has no last place of 2^29."""
    bin_ = np.zeros(len(pos), np.int64)
    for level in range(1, CSI_DEPTH + 1):
        scale = BAI_SHIFT + 3 * (CSI_DEPTH - level)
        inside = pos >> scale == (stop - 1) >> scale
        bin_[inside] = ((1 << 3 * level) - 1) // 7 + (pos[inside] >> scale)
    bins: list[dict[int, list[tuple[int, int]]]] = [{} for _ in range(refs)]
    least: list[dict[int, int]] = [{} for _ in range(refs)]
    runs = np.flatnonzero(np.concatenate([[True], (rid[1:] != rid[:-1]) | (bin_[1:] != bin_[:-1])])) if len(pos) else np.zeros(0, np.int64)
    for a, b in zip(runs, [*runs[1:], len(pos)]):
        bins[rid[a]].setdefault(int(bin_[a]), []).append((int(begin[a]), int(end[b - 1])))
    first, last = pos >> BAI_SHIFT, (stop - 1) >> BAI_SHIFT
    for further in range(int((last - first).max(initial=-1)) + 1):
        touch = np.flatnonzero(first + further <= last)
        _, at = np.unique(rid[touch] << 40 | first[touch] + further, return_index=True)
        for i in touch[at]:
            for level in range(CSI_DEPTH + 1):
                number = ((1 << 3 * level) - 1) // 7 + (int(first[i]) + further >> 3 * (CSI_DEPTH - level))
                known = least[rid[i]]
                known[number] = min(known.get(number, int(begin[i])), int(begin[i]))
    index = [b"CSI\x01" + struct.pack("<iiii", BAI_SHIFT, CSI_DEPTH, 0, refs)]
    for of, (found, offsets) in enumerate(zip(bins, least)):
        index.append(struct.pack("<i", len(found) + bool(found)))
        for number, chunks in found.items():
            index.append(struct.pack("<IQi", number, offsets[number], len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
        if found:
            ends = [c for chunks in found.values() for c in chunks]
            n = int((rid == of).sum())
            index.append(struct.pack("<IQiQQQQ", metadata_bin(CSI_DEPTH), 0, 2, min(c[0] for c in ends), max(c[1] for c in ends), n, 0))
    data = b"".join(index) + struct.pack("<Q", 0)
    return b"".join(bgzf_block(data[i : i + BLOCK_BYTES]) for i in range(0, len(data), BLOCK_BYTES)) + bgzf_block(b"")


def frame_bytes(refs: list[tuple[str, int]], reads: pd.DataFrame, level: int = 6) -> tuple[bytes, bytes]:
    """A whole file and its CSI index, of reads by contig and pos that share most of their shapes."""
    records, starts = record_matrix(reads)
    data = records.tobytes()
    head = alignment_head(refs)
    blocks = [bgzf_block(part, level) for part in (head, *(data[i : i + BLOCK_BYTES] for i in range(0, len(data), BLOCK_BYTES)), b"")]
    places = np.concatenate([[0], np.cumsum([len(b) for b in blocks])])
    virtual = places[1 + starts // BLOCK_BYTES] << 16 | starts % BLOCK_BYTES
    virtual[starts >= len(data)] = places[-2] << 16
    rid, pos = reads["contig"].to_numpy(np.int64), reads["pos"].to_numpy(np.int64)
    flat = np.concatenate([np.zeros(0, np.int64), *reads["cigar"]]).astype(np.int64)
    of = np.repeat(np.arange(len(reads)), reads["cigar"].map(len).to_numpy(np.int64))
    spans = np.bincount(of, np.where(np.isin(flat & 15, (0, 2, 3, 7, 8)), flat >> 4, 0), len(reads)).astype(np.int64)
    return b"".join(blocks), csi_bytes(len(refs), rid, pos, pos + np.maximum(1, spans), virtual[:-1], virtual[1:])
