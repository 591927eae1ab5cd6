"""Approximate nearest neighbours by largest inner product: an adaptive scan of the dimensions of probed lists.

A vector x becomes (x, sqrt(M^2 - |x|^2)), M the largest norm, so that the nearest point is the one of largest inner product;
then a random rotation spreads its energy evenly over the dimensions. Lists are the cells of k-means centroids. Centroids,
and how many lists to probe, are fitted on a bounded sample (`sample` vectors), the latter so that the sample's own
neighbours are found at `recall`; every vector is in a list. A probed list is scanned by blocks of columns: a candidate is
abandoned when its partial distance, scaled up, exceeds the query's bound by more than a test of `CONFIDENCE` allows. The
bound is the distance of the k-th nearest vector of the sample inside the query's lists, so it holds from the first column
on; those k vectors are results already, so a wrong abandonment never leaves a query short.

A list of many vectors or queries is cut into parts by hash, each pair of parts being a group; no task takes a whole list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methlake.llm.shared import stored

SAMPLE = 20_000
COLUMNS = 16
#: Standard deviations that a scaled partial distance may exceed the bound by.
CONFIDENCE = 2.1
#: Vectors and queries of a list that one group takes.
PART_VECTORS, PART_QUERIES = 4_000, 2_000
MOST_LISTS = 2_000
PAIRS = 1 << 16


@dataclass
class Index:
    size: int  # dimensions
    norm: float
    rotation: np.ndarray
    centroids: np.ndarray
    probes: int
    sample: np.ndarray  # rotated
    sample_ids: np.ndarray
    sample_raw: np.ndarray
    sample_list: np.ndarray

    def rotated(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0.0, self.norm**2 - (x * x).sum(1)))
        return np.column_stack([x, rest]) @ self.rotation

    def list_distances(self, r: np.ndarray) -> np.ndarray:
        return distances(r, self.centroids)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v (array<double>): vectors that are not null or zero and hold finite numbers only, of the most common length."""
    v = F.col(vector).cast("array<double>")
    good = vectors.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("bigint").alias("key"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return good.where(fine)


def fit(vectors: DataFrame, k: int, sample: int, recall: float, seed: int) -> Index | None:
    stats = vectors.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).orderBy(F.desc("n"), "size").first()
    if stats is None:
        return None
    size, n, norm = stats["size"], stats["n"], float(stats["m"]) ** 0.5
    draw = F.xxhash64("key", F.lit(seed)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(1 << 40)
    rows = vectors.where((F.size("v") == size) & (draw < min(1.0, sample / n))).limit(2 * sample).select("key", "v").toArrow()
    order = np.unique(rows["key"].to_numpy(), return_index=True)[1]  # a repeated row counts once
    x = _matrix(rows["v"].combine_chunks())[order]
    random = np.random.default_rng(seed)
    rotation = np.linalg.qr(random.normal(size=(size + 1, size + 1)))[0]
    index = Index(size, norm, rotation, np.zeros((1, size + 1)), 1, np.zeros((0, size + 1)), rows["key"].to_numpy()[order], x, np.zeros(len(x), np.int64))
    if not len(x):
        return index
    index.sample = r = index.rotated(x)
    lists = int(min(MOST_LISTS, max(1, n**0.5), max(1, len(r) // 10)))
    index.centroids = centroids = r[random.choice(len(r), lists, replace=False)]
    for _ in range(8):
        cell = np.concatenate([distances(r[i : i + 4096], centroids).argmin(1) for i in range(0, len(r), 4096)])
        count = np.bincount(cell, minlength=lists)
        total = np.zeros_like(centroids)
        np.add.at(total, cell, r)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    cell = np.concatenate([distances(r[i : i + 4096], centroids).argmin(1) for i in range(0, len(r), 4096)])
    index.sample_list = cell
    some = np.sort(random.choice(len(r), min(len(r), 500), replace=False))
    q = index.rotated(x[some], query=True)
    d = distances(q, r)
    d[np.arange(len(some)), some] = np.inf
    near = np.argsort(d, axis=1)[:, : min(k, max(1, len(r) - 1))]
    rank = np.argsort(np.argsort(index.list_distances(q), axis=1), axis=1)
    need = np.take_along_axis(rank, cell[near], 1)
    index.probes = int(np.quantile(need, recall, method="higher")) + 1
    return index


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _raw(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, np.float64)
    return pa.array([row.tobytes() for row in x], pa.binary())


def _unraw(column: pa.Array, size: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), size)


def _assign(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                some = batch.slice(at, 4096)
                x = _matrix(some.column("v"))
                cell = shared.value.list_distances(shared.value.rotated(x)).argmin(1)
                yield pa.RecordBatch.from_arrays([some.column("key"), pa.array(cell.astype(np.int32)), _raw(x)], names=["key", "list", "raw"])

    return run


def _probe(shared, sizes, k: int):
    """Each query in the lists that it probes, with its bound; more lists than usual if those hold too few vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                x = _matrix(some.column("v"))
                r = index.rotated(x, query=True)
                order = np.argsort(index.list_distances(r), axis=1, kind="stable")
                probes = np.maximum(index.probes, (np.cumsum(sizes.value[order], axis=1) < k + 1).sum(1) + 1)
                probes = np.minimum(probes, order.shape[1])
                bound, known, scores = np.full(len(r), np.inf), [[] for _ in r], [[] for _ in r]
                if len(index.sample) > k:  # the query itself may be one of the sample, so one more
                    far = distances(r, index.sample)
                    rank = np.argsort(order, axis=1)
                    far[rank[:, index.sample_list] >= probes[:, None]] = np.inf
                    near = np.argpartition(far, k, axis=1)[:, : k + 1]
                    bound = np.take_along_axis(far, near, 1).max(1) * (1 + 1e-6) + 1e-9
                    for i in np.flatnonzero(np.isfinite(bound)):
                        known[i] = index.sample_ids[near[i]].tolist()
                        scores[i] = np.einsum("ij,j->i", index.sample_raw[near[i]], x[i]).tolist()
                first = np.concatenate([[0], np.cumsum(probes)])[:-1]
                which = np.repeat(np.arange(len(r)), probes)
                cell = np.concatenate([order[i, :p] for i, p in enumerate(probes)]).astype(np.int32) if len(r) else np.zeros(0, np.int32)
                raw = _raw(x)
                once = np.full(len(which), -1)  # what is known of a query goes with the first of its rows
                once[first] = np.arange(len(first))
                made = [pa.array([v[i] if i >= 0 else None for i in once.tolist()], pa.list_(kind)) for v, kind in ((known, pa.int64()), (scores, pa.float64()))]
                yield pa.RecordBatch.from_arrays([some.column("key").take(pa.array(which)), pa.array(cell), raw.take(pa.array(which)), pa.array(bound[which]), *made], names=["key", "list", "raw", "bound", "known", "scores"])

    return run


def scan_list(q: np.ndarray, bound: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, vector) pairs that no test abandoned; q, r rotated."""
    size = q.shape[1]
    a, b, total = None, None, None
    for d in range(0, size, COLUMNS):
        e = min(size, d + COLUMNS)
        slack = (1 + CONFIDENCE / e**0.5) ** 2 * e / size if e < size else 1.0
        if a is None:
            first = distances(q[:, d:e], r[:, d:e])
            a, b = np.nonzero(first <= bound[:, None] * slack)
            total = first[a, b]
            continue
        for i in range(0, len(a), PAIRS):
            j = slice(i, i + PAIRS)
            x = q[a[j], d:e] - r[b[j], d:e]
            total[j] += np.einsum("ij,ij->i", x, x)
        keep = total <= bound[a] * slack
        a, b, total = a[keep], b[keep], total[keep]
    return a, b


def _search(shared, k: int):
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        index: Index = shared.value
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        x, y = _unraw(vectors["raw"], index.size), _unraw(queries["raw"], index.size)
        ids, qids = vectors["key"].to_numpy(), queries["key"].to_numpy()
        order = np.argsort(ids, kind="stable")
        x, ids = x[order], ids[order]
        a, b = scan_list(index.rotated(y, query=True), queries["bound"].to_numpy(), index.rotated(x))
        other = qids[a] != ids[b]
        a, b = a[other], b[other]
        score = np.concatenate([np.einsum("ij,ij->i", y[a[i : i + PAIRS]], x[b[i : i + PAIRS]]) for i in range(0, len(a), PAIRS)] or [np.zeros(0)])
        best = np.lexsort([ids[b], -score, a])
        rank = np.arange(len(best)) - np.searchsorted(a[best], a[best])
        best = best[rank < k]
        return pa.table([qids[a[best]], ids[b[best]], score[best]], schema=schema)

    return run


def search(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20, sample: int = SAMPLE, recall: float = 0.96, part_vectors: int = PART_VECTORS, part_queries: int = PART_QUERIES, seed: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found among the vectors with another key.

    Keys are integers and name one vector each; a repeated row counts once. Nearest first, ties to the smaller
    key; score is the inner product of the given vectors in double precision. Vectors that are null or zero, hold null or
    non-finite numbers, have a null key or another length than most take no part.
    """
    spark = vectors.sparkSession
    good = usable(vectors, key, vector)
    index = fit(good, k, sample, recall, seed)
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if index is None:
        return spark.createDataFrame([], empty)
    shared = spark.sparkContext.broadcast(index)  # sample and centroids bound it
    fits = F.size("v") == index.size
    placed = stored(good.where(fits).mapInArrow(_assign(shared), "key bigint, list int, raw binary"), "lists")
    counts = {r["list"]: r["n"] for r in placed.groupBy("list").agg(F.count("*").alias("n")).collect()}  # MOST_LISTS at most
    sizes = spark.sparkContext.broadcast(np.array([counts.get(i, 0) for i in range(len(index.centroids))], np.int64))
    probing = stored(usable(queries, key, vector).where(fits).mapInArrow(_probe(shared, sizes, k), "key bigint, list int, raw binary, bound double, known array<bigint>, scores array<double>"), "probes")
    asked = {r["list"]: r["n"] for r in probing.groupBy("list").agg(F.count("*").alias("n")).collect()}
    parts = F.broadcast(spark.createDataFrame([(i, -(-counts.get(i, 0) // part_vectors) or 1, -(-asked.get(i, 0) // part_queries) or 1) for i in range(len(index.centroids))], "list int, vp int, qp int"))
    one = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.join(parts, "list").select("key", "list", "raw", one("vp", 1).alias("v"), every("qp").alias("q"))
    right = probing.join(parts, "list").select("key", "list", "raw", "bound", one("qp", 2).alias("q"), every("vp").alias("v"))
    found = left.groupBy("list", "v", "q").cogroup(right.groupBy("list", "v", "q")).applyInArrow(_search(shared, k), "query_id bigint, vec_id bigint, score double")
    known = probing.where("known IS NOT NULL").select(F.col("key").alias("query_id"), F.explode(F.arrays_zip("known", "scores")).alias("x")).select("query_id", F.col("x.known").alias("vec_id"), F.col("x.scores").alias("score")).where("vec_id <> query_id")
    found = found.unionAll(known).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
