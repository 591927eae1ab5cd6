"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Method: a text's spaces become U+2581 behind a leading one, and its characters the first symbols. An agenda holds the pairs
of adjacent symbols whose concatenation is a piece, best score first, then leftmost; a popped pair merges unless one of its
sides has changed, and its new neighbours join the agenda. What is no piece in the end goes as its UTF-8 bytes' pieces.

* Where no piece of the vocabulary has U+2581 behind another character, no merge crosses such a place, so a text is cut there
  and each different stretch of a piece of texts is encoded once.
* The agendas of short stretches are rows of a matrix of ranks, popped side by side in numpy. A stretch of more than 64
  characters has its agenda in a heap (`Vocabulary.merged`, same order and result), so it takes n log n steps.
* Scan only: no shuffle; a task holds one piece of texts.
* `encode(..., check=path)` also runs the sentencepiece library over each Arrow batch, `differences` counts where it differs.

Models that are not of this kind (unigram, other normalisation, user-defined or unused pieces) are refused.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methlake.llm.bpe import _EMPTY, _hashed, _slot
from methlake.llm.shared import small_batches
from methlake.llm.words import gather, pieces, ranges

BLANK = "▁"
#: Text bytes that are worked on at a time.
PIECE = 4 << 20
NONE = np.int32(2**31 - 1)
#: Widths and cells of the agendas' matrices; a stretch beyond the last width has a heap of its own (same order, same result).
WIDTHS = (3, 4, 6, 8, 10, 12, 16, 20, 24, 32, 64)
CELLS = 1 << 18

# Kinds of pieces and of models in the model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
BPE_MODEL = 2


def _fields(raw: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields: integers, floats of four bytes, or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, raw[at : at + size]
            at += size
        else:
            width = 4 if kind == 5 else 8
            yield key >> 3, struct.unpack("<f" if kind == 5 else "<d", raw[at : at + width])[0]
            at += width


@dataclass
class Vocabulary:
    """What merges, and what each id stands for."""

    symbols: dict[str, int]  # of characters: their piece, or a number beyond all pieces
    pairs: dict[int, tuple[int, int]]  # two symbols -> rank of the piece that they make (equal scores: equal rank), its id
    raw: list[bytes]  # decoded bytes; empty for control pieces
    kinds: list[int]
    bytes_: list[int]  # ids of the 256 byte pieces
    begin: int
    end: int
    cuts: bool  # no piece has BLANK behind another character

    @classmethod
    def load(cls, path: str) -> "Vocabulary":
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        trainer = dict(x for k, v in model if k == 2 for x in _fields(v))
        normal = dict(x for k, v in model if k == 3 for x in _fields(v))
        if trainer.get(3) != BPE_MODEL or normal.get(1) != b"identity" or normal.get(3, 1) != 1 or normal.get(4, 1) != 0 or normal.get(5, 1) != 1 or trainer.get(24, 0):
            raise ValueError("not a merge-type model with identity normalisation, a leading blank and all blanks kept")
        names, scores, kinds = [], [], []
        for piece in (dict(_fields(v)) for k, v in model if k == 1):
            names.append(piece[1].decode())
            scores.append(piece.get(2, 0.0))
            kinds.append(piece.get(3, NORMAL))
        if {USER_DEFINED, UNUSED} & set(kinds) or kinds.count(BYTE) != 256:
            raise ValueError("user-defined or unused pieces, or no byte pieces")
        bytes_, raw = [0] * 256, []
        for i, (name, kind) in enumerate(zip(names, kinds)):
            if kind == BYTE:
                bytes_[int(name[3:5], 16)] = i
                raw.append(bytes([int(name[3:5], 16)]))
            else:
                raw.append({CONTROL: b"", UNKNOWN: trainer.get(44, " ⁇ ".encode())}.get(kind, name.replace(BLANK, " ").encode()))
        ids = {name: i for i, (name, kind) in enumerate(zip(names, kinds)) if kind == NORMAL}
        special = {name: i for i, (name, kind) in enumerate(zip(names, kinds)) if kind == CONTROL}
        begin, end = (special[trainer.get(k, d).decode()] for k, d in ((46, b"<s>"), (47, b"</s>")))
        symbols = {c: ids.get(c, len(names) + k) for k, c in enumerate(sorted({c for name in ids for c in name}))}
        rank = {x: r for r, x in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        known, pairs = symbols | ids, {}
        for name, i in ids.items():
            for cut in range(1, len(name)):
                if name[:cut] in known and name[cut:] in known:
                    pairs[known[name[:cut]] << 32 | known[name[cut:]]] = rank[scores[i]], i
        return cls(symbols, pairs, raw, kinds, bytes_, begin, end, not any(BLANK in name.lstrip(BLANK) for name in ids))

    def merged(self, stretch: str) -> list[int]:
        """Ids of one stretch, by the agenda. An entry is rank and place; it holds while the place's pair still has that rank."""
        symbol, pair = [self.symbols.get(c, -1) for c in stretch], self.pairs.get
        n = len(symbol)
        entry, result, agenda = [-1] * n, [-1] * n, []
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        for i in range(n - 1):
            if found := pair(symbol[i] << 32 | symbol[i + 1]):
                entry[i], result[i] = found[0] << 32 | i, found[1]
                agenda.append(entry[i])
        heapq.heapify(agenda)
        while agenda:
            top = heapq.heappop(agenda)
            i = top & 0xFFFFFFFF
            if entry[i] != top:
                continue  # one of its sides has merged since
            j = after[i]
            symbol[i], entry[i], entry[j] = result[i], -1, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if found := pair(symbol[i] << 32 | symbol[k]):
                    entry[i], result[i] = found[0] << 32 | i, found[1]
                    heapq.heappush(agenda, entry[i])
            if (h := before[i]) >= 0:
                entry[h] = -1
                if found := pair(symbol[h] << 32 | symbol[i]):
                    entry[h], result[h] = found[0] << 32 | h, found[1]
                    heapq.heappush(agenda, entry[h])
        out, i = [], 0
        while i < n:
            if 0 <= symbol[i] < len(self.kinds):
                out.append(symbol[i])
            else:
                out += [self.bytes_[b] for b in stretch[i].encode()]
            i = after[i]
        return out


class Agendas:
    """The agendas of many stretches side by side: a row each, holding the rank of the pair at every place."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.keys, slots, self.probes = _hashed(np.array(list(vocabulary.pairs), np.uint64), np.arange(len(vocabulary.pairs), dtype=np.int32))
        found = np.array(list(vocabulary.pairs.values()) or [(0, 0)], np.int32)[slots]
        self.rank, self.made = np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1])
        self.symbol = -2 - np.arange(0x110000, dtype=np.int32)  # by code point; below -1: in no piece
        chars = np.array([ord(c) for c in vocabulary.symbols], np.int64)
        own = np.array(list(vocabulary.symbols.values()), np.int32)
        self.symbol[chars[own < len(vocabulary.kinds)]] = own[own < len(vocabulary.kinds)]
        self.bare = {int(k): int(c) for k, c in zip(own, chars) if k >= len(vocabulary.kinds)}  # in pieces, but none itself
        for k, c in self.bare.items():
            self.symbol[c] = k

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of what each two symbols make; NONE where that is no piece."""
        rank, made = np.full(left.shape, NONE, np.int32), np.zeros(left.shape, np.int32)
        live = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        key = left.ravel()[live].astype(np.uint64) << np.uint64(32) | right.ravel()[live].astype(np.uint64)
        slot = _slot(key, len(self.keys))
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == key
            rank.ravel()[live[hit]], made.ravel()[live[hit]] = self.rank[slot[hit]], self.made[slot[hit]]
            on = ~hit & (there != _EMPTY)
            if not on.any():
                break
            live, key, slot = live[on], key[on], (slot[on] + 1) % len(self.keys)
        return rank, made

    def run(self, symbols: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """symbols: a row each, padded with -1. Yields (rows, their last symbols), rows as their agendas run empty."""
        rows = np.arange(len(symbols))
        rank, made = self.look_up(symbols[:, :-1], symbols[:, 1:])
        while len(rows):
            if not rank.shape[1]:
                yield rows, symbols
                return
            at = rank.argmin(1)  # best score, then leftmost
            on = rank[np.arange(len(rows)), at] != NONE
            if not on.all():
                yield rows[~on], symbols[~on]
                rows, symbols, rank, made, at = rows[on], symbols[on], rank[on], made[on], at[on]
                if not len(rows):
                    return
            line = np.arange(len(rows))
            symbols[line, at] = made[line, at]
            keep = np.arange(symbols.shape[1] - 1)
            symbols = np.take_along_axis(symbols, keep + (keep > at[:, None]), 1)
            keep = keep[:-1]
            keep = keep + (keep >= at[:, None])
            rank, made = np.take_along_axis(rank, keep, 1), np.take_along_axis(made, keep, 1)
            for i in (at - 1, at):  # its new neighbours
                fits = (i >= 0) & (i < rank.shape[1])
                a, b = line[fits], i[fits]
                if len(a):
                    rank[a, b], made[a, b] = self.look_up(symbols[a, b], symbols[a, b + 1])

    def ids(self, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches, flat, and len + 1 offsets."""
        size = pc.utf8_length(stretches).to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        text = "".join(stretches.to_pylist())
        symbol = self.symbol[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        parts = []
        group = np.searchsorted(WIDTHS, size)
        for i in np.flatnonzero(group == len(WIDTHS)).tolist():
            ids = np.array(self.vocabulary.merged(text[first[i] : first[i + 1]]), np.int32)
            parts.append((np.full(len(ids), i), ids))
        for g, edge in enumerate(WIDTHS):
            mine = np.flatnonzero(group == g)
            for cut in range(0, len(mine), CELLS // edge):
                some = mine[cut : cut + CELLS // edge]
                matrix = np.full((len(some), int(size[some].max())), -1, np.int32)
                inside = np.arange(matrix.shape[1]) < size[some][:, None]
                matrix[inside] = gather(symbol, first[some], size[some])
                for rows, last in self.run(matrix):
                    real = last != -1
                    parts.append(self._spelt(np.repeat(some[rows], real.sum(1)), last[real]))
        owner = np.concatenate([o for o, _ in parts]) if parts else np.zeros(0, np.int64)
        flat = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.int32)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(size)))])

    def _spelt(self, owner: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece as the pieces of their bytes."""
        odd = (last < 0) | (last >= len(self.vocabulary.kinds))
        if not odd.any():
            return owner, last
        values, which = np.unique(last[odd], return_inverse=True)
        spelt = [[self.vocabulary.bytes_[b] for b in chr(self.bare[v] if v >= 0 else -2 - v).encode()] for v in values.tolist()]
        count = np.ones(len(last), np.int64)
        count[odd] = np.array([len(x) for x in spelt])[which]
        out = np.repeat(last, count)
        of_odd = np.repeat(odd, count)
        table = np.concatenate([np.array(x, np.int32) for x in spelt])
        begin = np.cumsum([0, *map(len, spelt)])[:-1]
        out[of_odd] = table[ranges(begin[which], count[odd])]
        return np.repeat(owner, count), out


_STRETCH = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")


def encode_texts(texts: list[str | None], agendas: Agendas) -> list[bytes]:
    """Packed ids of each text, with begin and end."""
    found, first = [], [0]
    for text in texts:
        if text:
            marked = BLANK + text.replace(" ", BLANK)
            found += _STRETCH.findall(marked) if agendas.vocabulary.cuts else [marked]
        first.append(len(found))
    coded = pa.array(found, pa.large_string()).dictionary_encode()
    flat, at = agendas.ids(coded.dictionary)
    which = coded.indices.to_numpy()
    size = np.diff(at)[which]
    total = np.concatenate([[0], np.cumsum(size)])[first]
    packed = gather(flat, at[which], size).astype("<u4").tobytes() if len(which) else b""
    begin, end = (np.array([x], "<u4").tobytes() for x in (agendas.vocabulary.begin, agendas.vocabulary.end))
    return [begin + packed[4 * a : 4 * b] + end for a, b in zip(total, total[1:])]


def encode(docs: DataFrame, vocabulary: Vocabulary, text: str = "text", out: str = "ids", check: str | None = None) -> DataFrame:
    """docs with `out`: begin, the text's ids, end, as one binary of little-endian unsigned 32-bit integers.

    A null text counts as empty: begin and end alone. Rows are encoded each by itself, so ties and repeated rows need no rule.
    A column of docs named `out` is replaced. check: a model file; the library then encodes each batch too, and `differs`
    (replaced as well) tells whether its ids are others.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # bounded by the model file
    with_check = check is not None
    if with_check:
        with open(check, "rb") as f:
            model = docs.sparkSession.sparkContext.broadcast(f.read())
    kept = docs.drop(out, *(["differs"] if with_check else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agendas = Agendas(shared.value)
        if with_check:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_proto=model.value)
        for piece in pieces(batches, text, PIECE):
            texts = piece.column(text).to_pylist()
            coded = encode_texts(texts, agendas)
            columns = [*piece.columns, pa.array(coded, pa.binary())]
            if with_check:
                theirs = library.encode([t or "" for t in texts], add_bos=True, add_eos=True, num_threads=1)
                columns.append(pa.array([np.array(a, "<u4").tobytes() != b for a, b in zip(theirs, coded)], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=[*piece.schema.names, out, *(["differs"] if with_check else [])])

    fields = [*kept.schema.fields, T.StructField(out, T.BinaryType()), *([T.StructField("differs", T.BooleanType())] if with_check else [])]
    return kept.mapInArrow(run, T.StructType(fields))


def differences(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """The rows of docs whose ids are not the library's, with `ids`; none is expected."""
    return encode(docs, Vocabulary.load(path), text, check=path).where("differs").drop("differs")


def decode_ids(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of ids as the library decodes them: one leading blank goes, bytes that are no UTF-8 become U+FFFD each."""
    kinds, raw, flat = vocabulary.kinds, vocabulary.raw, ids.tolist()
    content = [i for i in flat if kinds[i] != CONTROL]
    blank = bool(content) and kinds[content[0]] == NORMAL and raw[content[0]].startswith(b" ")
    ends = sum(kinds[i] == CONTROL for i in {0: [], 1: flat}.get(len(flat), [*flat[:1], *flat[-1:]]))
    if len(content) + ends == len(flat):  # no control piece breaks a run of bytes
        try:
            return b"".join(map(raw.__getitem__, flat)).decode()[blank:]
        except UnicodeDecodeError:
            pass
    out: list[str] = []
    for of_bytes, some in groupby(flat, lambda i: kinds[i] == BYTE):  # a run of byte pieces is decoded by itself
        left = b"".join(map(raw.__getitem__, some))
        while of_bytes and left:
            size = next((k for k in (1, 2, 3, 4) if _is_text(left[:k])), 0)
            out.append(left[:size].decode() if size else "\ufffd")
            left = left[size or 1 :]
        out.append(left.decode())
    return "".join(out)[blank:]


def _is_text(raw: bytes) -> bool:
    try:
        raw.decode()
    except UnicodeDecodeError:
        return False
    return True


def decode(coded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """coded with `out`, the text that the packed ids stand for; null ids decode to the empty text."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)
    kept = coded.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, ids, PIECE):
            texts = [decode_ids(np.frombuffer(x or b"", "<u4"), shared.value) for x in piece.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(texts, pa.string())], names=[*piece.schema.names, out])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out, T.StringType())]))


def n_tokens(ids: str = "ids"):
    return (F.length(ids) / 4).cast("bigint")
