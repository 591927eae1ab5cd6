"""Where a record begins inside a stretch of inflated alignment data.

The record layout (sequence alignment format specification, section 4.2) leaves no marker to look for, so every byte offset
of a window is weighed at once: the fixed fields are read there as strided columns, offsets whose fields contradict the
layout are dropped, and those left point to the offset where their record would end. An offset is a beginning if its
pointers lead through other candidates to the end of the window, over `LINKS` of them at least, or exactly to the end of
the file. A window in which nothing is decided, as a record may be longer than it, is doubled.
"""

from __future__ import annotations

import numpy as np

WINDOW = 1 << 20
LINKS = 4
FIXED = 36           # bytes of a record before its name, its size included
RECORD_LIMIT = 1 << 30

NONE, UNDECIDED = -1, -2


def _field(data: bytes, at: int, kind: str, n: int) -> np.ndarray:
    return np.ndarray((n,), dtype=kind, buffer=data, offset=at, strides=(1,))


def candidates(data: bytes, ref_lengths: np.ndarray) -> np.ndarray:
    """Offsets at which the fixed fields, and as much of the name as is there, agree with the layout."""
    n = len(data) - FIXED + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    size = _field(data, 0, "<i4", n)
    at = np.flatnonzero((size >= 32) & (size < RECORD_LIMIT))
    for ref, pos in ((4, 8), (24, 28)):  # own place and the mate's
        r, p = _field(data, ref, "<i4", n)[at], _field(data, pos, "<i4", n)[at]
        known = (r >= 0) & (r < len(ref_lengths))
        length = ref_lengths[np.where(known, r, 0)] if len(ref_lengths) else np.zeros(len(at), np.int64)
        at = at[(p >= -1) & ((r == -1) | (known & (p < length)))]
    name, bases = _field(data, 12, "u1", n)[at].astype(np.int64), _field(data, 20, "<i4", n)[at].astype(np.int64)
    operations, flag = _field(data, 16, "<u2", n)[at].astype(np.int64), _field(data, 18, "<u2", n)[at]
    least = 32 + name + 4 * operations + (bases + 1) // 2 + bases
    at = at[(name > 0) & (bases >= 0) & (flag < 1 << 12) & (least <= size[at])]
    return np.array([i for i in at.tolist() if _name_fits(data, i)], np.int64)


def _name_fits(data: bytes, at: int) -> bool:
    name = data[at + FIXED : at + FIXED + data[at + 12]]
    whole = len(name) == data[at + 12]
    text = name[:-1] if whole else name
    return (not whole or name[-1] == 0) and text.isascii() and (not text or (text.decode().isprintable() and b" " not in text and b"@" not in text))


def first_record(data: bytes, ref_lengths: np.ndarray, last: bool) -> int:
    """Offset of the first record that begins in data; NONE, or UNDECIDED if more data (there is some unless `last`) may tell."""
    at = candidates(data, ref_lengths)
    if not len(at):
        return NONE if last else UNDECIDED
    after = at + 4 + _field(data, 0, "<i4", len(data) - 3)[at].astype(np.int64)
    place = np.searchsorted(at, after)
    known = np.minimum(place, len(at) - 1)
    linked = at[known] == after
    leaves = after > len(data) - FIXED  # the window tells no more
    fits = (after == len(data)) if last else leaves
    # pointer doubling: where the links lead to, and over how many
    to = np.where(linked, known, np.arange(len(at)))
    steps = linked.astype(np.int64)
    while True:
        further = to[to]
        if np.array_equal(further, to):
            break
        steps, to = steps + steps[to], further
    good = fits[to] & (last | (steps + 1 >= LINKS))
    first = np.flatnonzero(good)
    if len(first):
        return int(at[first[0]])
    return NONE if last else UNDECIDED
