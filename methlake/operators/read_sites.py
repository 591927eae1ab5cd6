"""Outcomes at the sites inside reads, for a batch of reads at once (`calls.read_calls` joins reads and sites beforehand)."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

from methlake.functions.reads import OPS_ALIGNED, OPS_ON_READ_ONLY, OPS_ON_REFERENCE

BASES = 4 << 20  # bases that are looked at together
WIDE = 1 << 40   # more than any place in a read


def parse_tag(mm: str | None, single_numeric_code: bool) -> list[tuple[bool, int, int, list[int]]]:
    """(implicit, n_codes, ml_start, deltas) of the groups of cytosine, as `reads.parse_mm` has them."""
    out, at = [], 0
    for block in (mm or "").split(";"):
        head, _, body = block.strip(" ").partition(",")
        if len(head) < 3:
            continue
        codes = head[2:].replace("?", "").replace(".", "")
        n = 1 if single_numeric_code and re.search("^[0-9]+$", codes) else max(len(codes), 1)
        listed = body.split(",")
        if not (body.isascii() and all(map(str.isdigit, listed))):
            listed = [d for d in (x.strip(" ") for x in listed) if re.search(r"^\+?[0-9]+$", d)]
        if head[0] == "C":
            out.append(("?" not in head, n, at, list(map(int, listed))))
        at += n * len(listed)
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of each row begin and how many it has; a null row has none."""
    width = np.int64 if pa.types.is_large_list(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    sizes = np.diff(offsets)
    if column.null_count:
        sizes[column.is_null().to_numpy(zero_copy_only=False)] = 0
    return offsets[:-1], sizes


def _bytes(column: pa.Array) -> np.ndarray:
    values = column.buffers()[2]
    return np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The row and the place of every value of the rows."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    within = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return row, np.repeat(starts, sizes) + within


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)


def sites_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset into the read's span, index into the flat list of sites) of the sites inside each read's span."""
    near = batch.column("near")
    row, at = _spread(*_lists(near))
    begin, end = _numbers(batch.column("ref_start")), _numbers(batch.column("ref_end"))
    site = _numbers(near.values.field("pos"))[at] + _numbers(batch.column("is_reverse"))[row]
    inside = (site >= begin[row]) & (site < end[row])
    row, at = row[inside], at[inside]
    return row, site[inside] - begin[row], at


def read_offsets(cigar: pa.Array, row: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """The read's base aligned to each reference offset; -1 on a deletion or skip."""
    op_row, at = _spread(*_lists(cigar))
    packed = _numbers(cigar.values)[at]
    op, n = packed & 15, packed >> 4
    aligned, on_reference = np.isin(op, OPS_ALIGNED), np.isin(op, OPS_ON_REFERENCE)

    def begins(moves: np.ndarray) -> np.ndarray:
        steps = np.where(moves, n, 0)
        before = np.cumsum(steps) - steps
        first = np.searchsorted(op_row, op_row)
        return before - before[first] if len(before) else before

    q, r = begins(aligned | np.isin(op, OPS_ON_READ_ONLY)), begins(on_reference)
    held = np.flatnonzero(on_reference & (n > 0))
    if not len(held):
        return np.full(len(row), -1, np.int64)
    k = np.searchsorted(op_row[held] * WIDE + r[held], row * WIDE + offset, "right") - 1
    k = held[np.maximum(k, 0)]
    hit = (op_row[k] == row) & aligned[k] & (offset >= r[k]) & (offset < r[k] + n[k])
    return np.where(hit, q[k] + offset - r[k], -1)


def scores(batch: pa.RecordBatch, row: np.ndarray, offset: np.ndarray, single_numeric_code: bool) -> np.ndarray:
    """Summed probability bytes (256 at most) of the cytosine at each site; -1 where nothing is called."""
    out = np.full(len(row), -1, np.int64)
    q = read_offsets(batch.column("cigar"), row, offset)
    starts, sizes = _lists(batch.column("seq"))
    n_bases = np.minimum(_numbers(batch.column("l_seq")), 2 * sizes)
    back = _numbers(batch.column("is_reverse")).astype(bool)
    # a reverse alignment stores the reverse complement: its cytosines are the stored G's, from the end
    symbol = np.where(back, 4, 2)  # 4-bit codes of G and C
    base_row, place = _spread(np.zeros(len(sizes), np.int64), n_bases)
    data = _bytes(batch.column("seq"))
    packed = data[starts[base_row] + (place >> 1)] if len(place) else np.zeros(0, np.uint8)
    is_c = np.where(place & 1, packed & 15, packed >> 4) == symbol[base_row]
    before = np.concatenate([[0], np.cumsum(is_c)])  # cytosines before each base of the batch
    ends = np.cumsum(n_bases)
    begins = ends - n_bases
    some = np.flatnonzero((q >= 0) & (q < n_bases[row]))
    some = some[is_c[begins[row[some]] + q[some]]]
    if not len(some):
        return out
    r, at = row[some], begins[row[some]] + q[some]
    ordinal = np.where(back[r], before[ends[r]] - before[at + 1], before[at] - before[begins[r]])

    # the groups of the reads that have such a site, side by side: group j of a read is at first[read] + j
    reads, which = np.unique(r, return_inverse=True)
    tags = batch.column("mm").take(pa.array(reads)).to_pylist()
    cache: dict[str | None, list] = {}
    groups = [cache[t] if t in cache else cache.setdefault(t, parse_tag(t, single_numeric_code)) for t in tags]
    count = np.array([len(g) for g in groups], np.int64)
    first = np.cumsum(count) - count
    flat = [g for gs in groups for g in gs]
    score = np.full(len(some), -1, np.int64)
    if flat:
        codes, ml_start = (np.array([g[i] for g in flat], np.int64) for i in (1, 2))
        listed = np.array([len(g[3]) for g in flat], np.int64)
        deltas = np.array([d for g in flat for d in g[3]], np.int64)
        of = np.repeat(np.arange(len(flat)), listed)
        begin = np.cumsum(listed) - listed
        points = np.cumsum(deltas + 1)
        points -= np.repeat(np.concatenate([[0], points])[begin], listed) + 1  # the ordinal that each delta points at
        keys = of * WIDE + points
        ml_at, ml_size = _lists(batch.column("ml"))
        ml = _bytes(batch.column("ml"))
        for j in range(int(count.max())):
            has = np.flatnonzero(count[which] > j)
            g = first[which[has]] + j
            key = g * WIDE + ordinal[has]
            k = np.searchsorted(keys, key)
            found = k < len(keys)
            found[found] = keys[k[found]] == key[found]
            has, g, k = has[found], g[found], k[found]
            byte = ml_start[g] + (k - begin[g]) * codes[g]
            for c in range(int(codes[g].max()) if len(g) else 0):
                there = (c < codes[g]) & (byte + c < ml_size[r[has]])
                to = has[there]
                score[to] = np.maximum(score[to], 0) + ml[ml_at[r[to]] + byte[there] + c]
        implicit = np.array([any(g[0] for g in gs) for gs in groups])
        score = np.where((score < 0) & implicit[which], 0, np.minimum(score, 256))
    out[some] = score
    return out


def outcomes(batch: pa.RecordBatch, schema: pa.Schema, low: float, high: float, single_numeric_code: bool, keep: bool):
    """Rows (columns that go along, probe_id, outcome) of the sites inside the reads; with `keep`, one null row for a read without."""
    sizes = np.cumsum(np.maximum(_numbers(batch.column("l_seq")), 1))
    at = 0
    while at < batch.num_rows:
        until = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BASES, "right")))
        part = batch.slice(at, until - at)
        at = until
        row, offset, site = sites_of(part)
        score = scores(part, row, offset, single_numeric_code)
        p = score / 256.0
        value = np.where(p >= float(np.float32(high)), 1, np.where(p < float(np.float32(low)), -1, 0)).astype(np.int8)
        if keep:
            none = np.setdiff1d(np.arange(part.num_rows), row)
            row = np.concatenate([row, none])
        met = len(site)
        names = part.column("near").values.field("cg_id").take(pa.array(site))
        columns = [part.column(f.name).take(pa.array(row)) for f in list(schema)[:-2]]
        probe = pa.concat_arrays([names, pa.nulls(len(row) - met, names.type)])
        outcome = pa.concat_arrays([pa.array(value, pa.int8(), mask=score < 0), pa.nulls(len(row) - met, pa.int8())])
        made = [c.cast(f.type) for c, f in zip([*columns, probe, outcome], schema)]
        yield pa.RecordBatch.from_arrays(made, schema=schema)
