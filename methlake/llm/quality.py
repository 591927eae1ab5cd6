"""Quality classifier: logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a whole text: its words, word pairs, word shapes (runs of upper case, lower case, digits and each mark, one sign
a run) and shape pairs, the latter with a sign for a word that repeats its predecessor; hashed to buckets, weighted by the
square root of their share. Training takes a bounded sample of labelled rows (`most`), one row at a time; scoring is a scan
with the weights broadcast, each score a sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methlake.llm.shared import small_batches
from methlake.llm.words import NOT_SPACE, Words, counted, mix, pieces, utf8

BUCKETS = 1 << 18
#: Byte classes of word shapes: upper case, lower case (all other scripts too), digits; marks stay themselves.
SHAPE = np.array([65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256)], np.uint8)


def _shapes(words: Words) -> np.ndarray:
    kinds = SHAPE[words.data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[words.starts] = True
    place = np.cumsum(keep) - 1
    short = Words.__new__(Words)
    short.data = kinds[keep]
    short.starts, short.ends = place[words.starts], place[words.ends - 1] + 1
    return short.hashes()


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, weight) pairs of all texts and the first pair of each text; a text without words has none."""
    data, offsets = utf8(column)
    words = Words(data, offsets, NOT_SPACE)
    text_of = words.text_of
    n = len(words)
    keys = []
    if n:
        h, s = words.hashes(), _shapes(words)
        pair = np.flatnonzero(text_of[1:] == text_of[:-1])
        same = (h[pair] == h[pair + 1]).astype(np.uint64)
        for salt, values, of in (
            (1, h, text_of),
            (2, h[pair] * np.uint64(31) + h[pair + 1], text_of[pair]),
            (3, s, text_of),
            (4, (s[pair] * np.uint64(31) + s[pair + 1]) * np.uint64(2) + same, text_of[pair]),
        ):
            keys.append(of.astype(np.int64) * BUCKETS + (mix(values + np.uint64(salt)) & np.uint64(BUCKETS - 1)).astype(np.int64))
    key, count = counted(np.concatenate(keys) if keys else np.zeros(0, np.int64))
    first = np.searchsorted(key, np.arange(len(offsets)) * BUCKETS)
    size = np.maximum(1, np.diff(words.first))
    return (key % BUCKETS).astype(np.int32), np.sqrt(count / size[key // BUCKETS]).astype(np.float32), first


@dataclass
class QualityModel:
    weights: np.ndarray
    bias: float

    def scores(self, column: pa.Array) -> np.ndarray:
        place, value, first = features(column)
        total = np.concatenate([[0.0], np.cumsum(self.weights[place].astype(np.float64) * value)])
        return 1 / (1 + np.exp(-np.clip(total[first[1:]] - total[first[:-1]] + self.bias, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 6000, epochs: int = 3, updates: int = 5000, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, seed: int = 11) -> QualityModel:
    """Learn from about `most` labelled rows at the most, drawn by the key's hash; labels other than 0 and 1 are left out.

    updates: least number of updates, so that few rows are gone over more often than `epochs` times. Without any labelled
    row every score is 1/2.
    """
    small_batches(docs.sparkSession)
    usable = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label"))
    n = usable.count()
    draw = F.xxhash64("key", F.lit(seed)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(1 << 40)
    drawn = usable.withColumn("draw", draw).where(F.col("draw") < min(1.0, most / max(n, 1))).orderBy("draw", "key", "label").limit(2 * most)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(drawn), "key").limit(4 * most)  # the drawn labels are 2 x most rows at the most
    got = rows.mapInArrow(_features, T.StructType([T.StructField("draw", T.DoubleType()), T.StructField("label", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("weights", T.BinaryType())])).toArrow()
    wanted = got["label"].to_numpy()
    order = np.lexsort([wanted, got["draw"].to_numpy()])
    places, values = got["places"].to_pylist(), got["weights"].to_pylist()
    z, g, w = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    zb = gb = bias = 0.0
    for _ in range(max(epochs, -(-updates // max(1, len(order))))):
        for i in order:
            p, x = np.frombuffer(places[i], np.int32), np.frombuffer(values[i], np.float32).astype(np.float64)
            wi = w[p] = np.where(np.abs(z[p]) <= l1, 0.0, -(z[p] - np.sign(z[p]) * l1) / ((beta + np.sqrt(g[p])) / alpha + l2))
            bias = -zb / ((beta + gb**0.5) / alpha)
            error = 1 / (1 + np.exp(-np.clip(wi @ x + bias, -35, 35))) - wanted[i]
            step = error * x
            z[p] += step - (np.sqrt(g[p] + step * step) - np.sqrt(g[p])) / alpha * wi
            g[p] += step * step
            zb += error - ((gb + error * error) ** 0.5 - gb**0.5) / alpha * bias
            gb += error * error
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(g)) / alpha + l2))
    return QualityModel(w.astype(np.float32), float(-zb / ((beta + gb**0.5) / alpha)) if len(order) else 0.0)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        place, value, first = features(piece.column("text"))
        cut = list(zip(first[:-1], first[1:]))
        yield pa.RecordBatch.from_arrays(
            [piece.column("draw"), piece.column("label"), pa.array([place[a:b].tobytes() for a, b in cut], pa.binary()), pa.array([value[a:b].tobytes() for a, b in cut], pa.binary())],
            names=["draw", "label", "places", "weights"],
        )


def score(docs: DataFrame, model: QualityModel, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold); null and empty texts get the bias alone."""
    small_batches(docs.sparkSession)
    kept = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, text):
            s = shared.value.scores(piece.column(text))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*piece.schema.names, "score", "predicted"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
