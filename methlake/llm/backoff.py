"""Stupid-backoff language-model scores of a corpus under its own n-gram counts, computed relationally.

score(w | u v) = c(uvw) / c(uv) if c(uvw) >= min_count, else 0.4 score(w | v); score(w | v) = c(vw) / c(v) if c(vw) >= min_count,
else 0.4 c(w) / N. Words at a text's start have shorter contexts. A text's log score is the sum over its words.

The exploded n-grams would be several times the corpus, so rows are packed: texts are dealt into chunks of about
`chunk_bytes`; a chunk explodes its n-grams, counts them, and sends each hash range of them as one sorted, packed row to
that range's part of the count table. A part adds up all chunks' counts and answers every packed row with the totals, in its
order; answers join their chunk, where they are looked up and summed per document. Frequent n-grams are one entry a chunk,
so no key is hot; rows that repeat
each other travel once a piece of the scan, with their number. n-grams are told apart by 64-bit hashes: of 10^10 different
ones about 3 pairs share one, each a wrong count of two n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methlake.llm.packing import expand, squeeze
from methlake.llm.shared import small_batches, stored
from methlake.llm.words import LOWER, NOT_SPACE, Words, counted, grouped, mix, pieces, sums_by, utf8

ORDER = 3
MIN_COUNT = 2
BACKOFF = 0.4
CHUNK_BYTES = 8 << 20
#: n-grams of a part of the count table, about.
PART_NGRAMS = 4_000_000
PIECE = 4 << 20

def _pack(key: str, chunks: int):
    """Texts of a piece by chunk: one compressed row for each chunk. Rows that repeat each other are one, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text", PIECE):
            keys, hashes, text = piece.column("key").to_pylist(), piece.column("th").to_pylist(), piece.column("text")
            first, times, kept = {}, np.ones(piece.num_rows, np.int64), []
            for i, row in enumerate(zip(keys, hashes)):
                j = first.setdefault(row, i)
                if i != j and text[i].as_buffer().equals(text[j].as_buffer()):
                    times[j] += 1
                else:
                    kept.append(i)
            piece = piece.append_column("times", pa.array(times)).take(pa.array(kept, pa.int64()))
            chunk = piece.column("chunk").to_numpy()
            rows = []
            for c in np.unique(chunk):
                some = piece.select(["key", "text", "times"]).take(pa.array(np.flatnonzero(chunk == c)))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, some.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=9))) as out:
                    out.write_batch(some)
                rows.append((int(c), sink.getvalue().to_pybytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["chunk", "texts"])

    return run


def _texts(group: pa.Table) -> pa.Table:
    """A chunk's texts, in an order that does not depend on how its rows arrived."""
    blobs = sorted(group["texts"].to_pylist())
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blobs])


def ngrams(texts: pa.Table, order: int) -> tuple[Words, list[np.ndarray]]:
    """The words, and for n = 1 .. order the hash of the n words that end at each word (meaningless where they cross texts)."""
    data, offsets = utf8(texts["text"])
    words = Words(LOWER[data], offsets, NOT_SPACE)
    h = words.hashes()
    out = [h]
    for n in range(2, order + 1):
        last = out[-1]
        longer = last.copy()
        longer[1:] = mix(last[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(n)) if len(last) else longer[1:]
        out.append(longer)
    return words, out


def _places(words: Words) -> np.ndarray:
    """Each word's number within its text."""
    return np.arange(len(words)) - np.repeat(words.first[:-1], np.diff(words.first))


def _distinct(words: Words, hashes: list[np.ndarray], times: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct n-grams, ascending, and how often each occurs, a text's counting as often as the text."""
    place = _places(words)
    if (times == 1).all():
        return [counted(h[place >= n]) for n, h in enumerate(hashes)]
    weight, out = np.repeat(times, np.diff(words.first)), []
    for n, h in enumerate(hashes):
        some = place >= n
        order, first = grouped(h[some])
        out.append((h[some][order][first], np.add.reduceat(weight[some][order], first) if len(first) else first))
    return out


def _ranks(x: np.ndarray) -> np.ndarray:
    """Each value's place among the distinct values."""
    order, first = grouped(x)
    out = np.empty(len(x), np.int64)
    out[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    return out


def _part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _count(order: int, parts: int):
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("n", pa.int32()), ("hashes", pa.binary()), ("counts", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        chunk = group["chunk"][0].as_py()
        rows: list[tuple] = []
        texts = _texts(group)
        for n, (h, count) in enumerate(_distinct(*ngrams(texts, order), texts["times"].to_numpy())):
            part = _part_of(h, parts)
            for p, at, to in zip(*_runs(part)):
                mine = h[at:to]
                rows.append((p, chunk, n, squeeze(np.diff(mine, prepend=np.uint64(0))), squeeze(count[at:to].astype(np.uint64))))
        return pa.table([list(x) for x in zip(*rows)] if rows else [[]] * 5, schema=schema)

    return run


def _runs(sorted_: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    first = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]])) if len(sorted_) else np.zeros(0, np.int64)
    return sorted_[first].tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_)][: len(first)]


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part of the count table: totals of each n-gram over all chunks, in the order that each chunk sent them."""
    held: dict[tuple[int, int], list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        for part, chunk, n, hashes, counts in zip(*(batch.column(c).to_pylist() for c in ("part", "chunk", "n", "hashes", "counts"))):
            held.setdefault((part, n), []).append((chunk, np.cumsum(expand(hashes, np.uint64), dtype=np.uint64), expand(counts, np.uint64)))
    for (part, n), rows in held.items():
        h = np.concatenate([x[1] for x in rows])
        order, first = grouped(h)
        totals = np.add.reduceat(np.concatenate([x[2] for x in rows]).astype(np.int64)[order], first)
        every = np.empty(len(h), np.int64)
        every[order] = np.repeat(totals, np.diff(np.append(first, len(h))))
        cut = np.cumsum([len(x[1]) for x in rows])[:-1]
        answers = [squeeze(t) for t in np.split(every, cut)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int32()), pa.array([n] * len(rows), pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array(answers, pa.binary())], names=["chunk", "n", "part", "totals"])


def _score(order: int, min_count: int, backoff: float):
    schema = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64()), ("n_single", pa.int64())])

    def run(group: pa.Table, answers: pa.Table) -> pa.Table:
        if not group.num_rows:
            return schema.empty_table()
        texts = _texts(group)
        words, hashes = ngrams(texts, order)
        place = _places(words)
        totals = []
        for n in range(order):
            mine = answers.filter(pa.compute.equal(answers["n"], n)).sort_by("part")
            known = np.concatenate([expand(x, np.int64) for x in mine["totals"].to_pylist()] or [np.zeros(0, np.int64)])
            count = np.zeros(len(words), np.int64)
            some = place >= n
            count[some] = known[_ranks(hashes[n][some])]
            totals.append(count)
        log = np.zeros(len(words))
        left = np.ones(len(words), bool)  # words that no longer n-gram has settled yet
        for n in range(order - 1, 0, -1):
            here = left & (place >= n)
            use = here & (totals[n] >= min_count)
            at = np.flatnonzero(use)
            log[at] += np.log(totals[n][at] / totals[n - 1][at - 1])
            left &= ~use
            log[here & ~use] += np.log(backoff)
        at = np.flatnonzero(left)
        log[at] += np.log(totals[0][at])
        each = np.repeat(np.arange(len(texts)), texts["times"].to_numpy())
        found = pa.table([texts["key"], np.diff(words.first), sums_by(log, words.first), sums_by(left.astype(np.int64), words.first)], schema=schema)
        return found.take(pa.array(each))

    return run


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", order: int = ORDER, min_count: int = MIN_COUNT, backoff: float = BACKOFF, chunk_bytes: int = CHUNK_BYTES, part_ngrams: int = PART_NGRAMS) -> DataFrame:
    """key, n_words, log_score and per_word (log_score by n_words) of every row of docs; words are runs of non-space bytes, A-Z lower-cased.

    A text without words (or null) scores 0 in both. Keys are integers and may be null or repeat: each row is a text of the corpus.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // chunk_bytes))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-order * size // 6 // part_ngrams))
    packed = rows.withColumn("chunk", F.pmod(F.xxhash64("key", "th"), F.lit(chunks)).cast("int")).mapInArrow(_pack("key", chunks), "chunk int, texts binary").repartition(chunks, "chunk")
    sent = packed.groupBy("chunk").applyInArrow(_count(order, parts), "part int, chunk int, n int, hashes binary, counts binary")
    totals = sent.repartitionById(parts, F.col("part")).mapInArrow(_total, "chunk int, n int, part int, totals binary")
    scored = packed.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(_score(order, min_count, backoff), "key bigint, n_words bigint, log_score double, n_single bigint")
    scored = stored(scored, "scores")
    words = scored.agg(F.sum("n_words").alias("all_words"))  # one row
    log_n = F.when(F.col("n_single") > 0, F.col("n_single") * F.log(F.col("all_words").cast("double"))).otherwise(F.lit(0.0))
    done = scored.join(F.broadcast(words)).select(F.col("key").alias(key), "n_words", (F.col("log_score") - log_n).alias("log_score"))
    return done.withColumn("per_word", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")).otherwise(0.0))
