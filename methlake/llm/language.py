"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the 2-, 3- and 4-byte windows of its lower-cased letters, hashed to buckets; the text's vector is the
mean of their embeddings. Embeddings and softmax are trained together by stochastic gradient descent in numpy on a bounded
sample of labelled rows (`per_language`); part of it is held back to fit the temperature and the rejection threshold.
Whole texts count, in training and in prediction. Prediction is a scan: the model (buckets x languages numbers) is broadcast.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methlake.llm.shared import small_batches
from methlake.llm.words import mix, pieces, ranges, release, utf8

BUCKETS = 1 << 15
SIZES = (2, 3, 4)
UNKNOWN = "und"
#: Lower-case letters stay, bytes of other scripts stay, all else is a space.
LETTERS = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)], np.uint8)
PAD = 4
#: Versions of a text that are in no language.
NEGATIVES = ("scrambled", "respelt")


def subwords(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of each size by place, which of them count, first place of each text)."""
    data, offsets = utf8(column)
    sizes = np.diff(offsets)
    first = np.concatenate([[0], np.cumsum(sizes + PAD)])
    stream = np.full(first[-1] + PAD, 0x20, np.uint64)
    stream[ranges(first[:-1] + 1, sizes)] = LETTERS[data]
    n = int(first[-1])
    code, found, real = stream[:n].copy(), [], []
    for k in range(1, max(SIZES)):
        code |= stream[k : n + k] << np.uint64(8 * k)
        if k + 1 in SIZES:
            found.append((mix(code * np.uint64(8) + np.uint64(k)) & np.uint64(BUCKETS - 1)).astype(np.int32))
            real.append((stream[:n] != 0x20) | (stream[1 : n + 1] != 0x20))  # windows of the padding do not count
    return np.array(found), np.array(real), first


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: what a subword adds to the mean logit
    bias: np.ndarray
    temperature: float
    threshold: float
    seen: np.ndarray  # buckets that any training text has
    strange: float = 0.0  # share of other buckets in held-back texts
    limit: float = np.inf  # excess of them (`excess`) above which a text is in no learned language
    false_rejects: float = 0.0  # shares of held-back texts, and of their scrambled and respelt versions, above the limit
    true_rejects: float = 0.0

    def scores(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, text x language, and each text's excess of strange subwords."""
        found, real, first = subwords(column)
        total, count, strange = np.zeros((len(first) - 1, len(self.languages))), np.zeros(len(first) - 1), np.zeros(len(first) - 1)
        if len(total):
            for f, r in zip(found, real):
                total += np.add.reduceat(self.table[f] * r[:, None], first[:-1], axis=0)
                count += np.add.reduceat(r.astype(np.float64), first[:-1])
                strange += np.add.reduceat((r & ~self.seen[f]).astype(np.float64), first[:-1])
        return softmax((total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature), excess(strange, count, self.strange)


def excess(strange: np.ndarray, count: np.ndarray, share: float) -> np.ndarray:
    """How many standard deviations more strange subwords a text has than held-back texts would; few words prove little."""
    return (strange - count * share) / np.sqrt(count * share * (1 - share) + 1)


def softmax(x: np.ndarray) -> np.ndarray:
    if not x.size:
        return x
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _then_release(fn):
    """fn, after which the driver gives back the memory that it took."""

    @functools.wraps(fn)
    def run(*args, **named):
        try:
            return fn(*args, **named)
        finally:
            release()

    return run


@_then_release
def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", per_language: int = 800, size: int = 16, epochs: int = 4, steps: int = 400, batch: int = 32, rate: float = 2.0, seed: int = 7) -> LanguageModel:
    """Learn from rows with text and language; at most about per_language x languages of them, drawn by the text's hash.

    steps: least number of gradient steps, so that few rows are gone over more often than `epochs` times.
    Rejection is calibrated on held-back texts against the same texts in no language: with their letters scrambled, and
    respelt in a permuted alphabet. A text is rejected for subwords that no training text has, where their excess is more than
    half as much again as that of any rightly named held-back text; and for a score below `threshold`, under which lie
    wrongly named held-back texts only. Equal texts are drawn once. Without any labelled row the model knows no language.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return LanguageModel([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0, np.zeros(BUCKETS, bool))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    draw = (F.xxhash64("text", F.lit(seed)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(1 << 40)).alias("draw")
    drawn = rows.withColumn("draw", draw).where(F.col("draw") < share[F.col("lang")]).dropDuplicates(["draw", "lang"])
    drawn = drawn.orderBy("draw", "lang").limit(2 * per_language * len(counts))
    features = drawn.mapInArrow(_features, T.StructType([T.StructField("draw", T.DoubleType()), T.StructField("lang", T.StringType()), T.StructField("places", T.BinaryType()), T.StructField("weights", T.BinaryType()), T.StructField("total", T.LongType()), *[T.StructField(f"{k}_{c}", T.BinaryType()) for k in NEGATIVES for c in ("at", "n")]])).toArrow()
    languages = sorted(counts)
    number = {k: i for i, k in enumerate(languages)}
    order = np.lexsort([np.array(features["lang"].to_pylist()), features["draw"].to_numpy()])
    wanted = np.array([number[x] for x in features["lang"].to_pylist()])[order]
    places, weights = features["places"].to_pylist(), features["weights"].to_pylist()
    texts = [(np.frombuffer(places[i], np.int32), np.frombuffer(weights[i], np.float32)) for i in order]
    held = _held_back(features["draw"].to_numpy()[order])
    embed, out, bias = _descend([t for t, h in zip(texts, held) if not h], wanted[~held], len(languages), size, max(epochs, -(-steps * batch // max(1, len(texts)))), batch, rate, seed)
    table = (embed @ out).astype(np.float32)
    rest = [t for t, h in zip(texts, held) if h] or texts
    truth = wanted[held] if held.any() else wanted
    logits = np.array([w @ table[p] for p, w in rest]) + bias
    grid = np.geomspace(0.002, 5.0, 90)
    # a doubt of one text in all keeps the temperature finite where the languages are told apart without an error
    doubt = np.full(logits.shape, 1 / (len(truth) + 2) / max(1, len(languages) - 1))
    doubt[np.arange(len(truth)), truth] = 1 - 1 / (len(truth) + 2)
    nll = [-(doubt * np.log(np.maximum(softmax(logits / t), 1e-300))).sum(1).mean() for t in grid]
    temperature = float(grid[int(np.argmin(nll))])
    p = softmax(logits / temperature)
    right = p.argmax(1) == truth
    model = LanguageModel(languages, table, bias, temperature, rejection(p.max(1), right), np.zeros(BUCKETS, bool))
    for t, h in zip(texts, held):
        if not h or not held.any():
            model.seen[t[0]] = True
    mine = order[held] if held.any() else order
    totals = features["total"].to_numpy()[mine]
    strange = {"own": np.array([np.round(w[~model.seen[p]].astype(float).sum() * n) for (p, w), n in zip(rest, totals)])}
    count = {"own": totals.astype(float)}
    for kind in NEGATIVES:
        at, n = ([np.frombuffer(features[f"{kind}_{c}"][int(i)].as_py(), np.int32) for i in mine] for c in ("at", "n"))
        strange[kind], count[kind] = (np.array([x[~model.seen[a]].sum() for a, x in zip(at, n)], float), np.array([x.sum() for x in n], float))
    model.strange = float(strange["own"].sum() / max(1.0, count["own"].sum()))
    over = {k: excess(strange[k], count[k], model.strange) for k in strange}
    model.limit = max(6.0, 1.5 * float(over["own"][right].max(initial=0.0)))
    model.false_rejects = float(np.mean(over["own"] > model.limit))
    model.true_rejects = float(np.mean(np.concatenate([over[k] for k in NEGATIVES]) > model.limit))
    return model


def rejection(score: np.ndarray, right: np.ndarray) -> float:
    """The least threshold under which all wrongly named texts lie that score below every rightly named one; 0 without any."""
    wrong = score[~right & (score < score[right].min(initial=np.inf))]
    return min(0.5, float(np.nextafter(wrong.max(), np.inf))) if len(wrong) and right.any() else 0.0


_RESPELT = LETTERS.copy()  # letters in an alphabet of another order; other scripts' bytes likewise
_RESPELT[97:123] = 97 + np.random.default_rng(1).permutation(26)
_RESPELT[65:91] = _RESPELT[97:123]
_RESPELT[128:192] = 128 + np.random.default_rng(2).permutation(64)


def _changed(column: pa.Array, scrambled: bool) -> pa.Array:
    """The texts with their letters in another order (by a seed of their length), or respelt."""
    data, offsets = utf8(column)
    out = (LETTERS if scrambled else _RESPELT)[data]
    for a, b in zip(offsets, offsets[1:]) if scrambled else ():
        letters = a + np.flatnonzero(out[a:b] != 0x20)
        out[letters] = out[np.random.default_rng(len(letters)).permutation(letters)]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(out)])


def _held_back(draw: np.ndarray) -> np.ndarray:
    """A fifth of the drawn texts, by their hash: calibration uses them, training does not."""
    return (draw * (1 << 40)).astype(np.int64) % 5 == 4


def _buckets(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct buckets, and how often it has each."""
    found, real, first = subwords(column)
    return [np.unique(found[:, a:b][real[:, a:b]], return_counts=True) for a, b in zip(first, first[1:])]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's distinct buckets and their shares; and the counts of held-back texts scrambled and respelt."""
    for piece in pieces(batches, "text"):
        text = piece.column("text")
        own = _buckets(text)
        made = [pa.array([p.astype(np.int32).tobytes() for p, _ in own], pa.binary()), pa.array([(c / max(1, c.sum())).astype(np.float32).tobytes() for _, c in own], pa.binary())]
        made.append(pa.array([int(c.sum()) for _, c in own], pa.int64()))
        names = ["draw", "lang", "places", "weights", "total"]
        held = pc.if_else(pa.array(_held_back(piece.column("draw").to_numpy())), text, None)  # only these are needed in no language
        for kind in NEGATIVES:
            some = _buckets(_changed(held, kind == "scrambled"))
            made += [pa.array([p.astype(np.int32).tobytes() for p, _ in some], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in some], pa.binary())]
            names += [f"{kind}_at", f"{kind}_n"]
        yield pa.RecordBatch.from_arrays([piece.column("draw"), piece.column("lang"), *made], names=names)


def _descend(texts, wanted, languages, size, epochs, batch, rate, seed):
    random = np.random.default_rng(seed)
    embed = random.normal(0, 0.3, (BUCKETS, size)).astype(np.float32)
    out, bias = random.normal(0, 0.3, (size, languages)).astype(np.float32), np.zeros(languages, np.float32)
    steps, done = max(1, epochs * -(-len(texts) // batch)), 0
    for _ in range(epochs):
        order = random.permutation(len(texts))
        for at in range(0, len(order), batch):
            mine = order[at : at + batch]
            place = np.concatenate([texts[i][0] for i in mine])
            weight = np.concatenate([texts[i][1] for i in mine])
            first = np.concatenate([[0], np.cumsum([len(texts[i][0]) for i in mine])])
            hidden = np.array([weight[a:b] @ embed[place[a:b]] for a, b in zip(first, first[1:])])
            error = softmax(hidden @ out + bias)
            error[np.arange(len(mine)), wanted[mine]] -= 1
            error /= len(mine)
            speed = rate * (1 - done / steps)
            back = error @ out.T
            out -= speed * hidden.T @ error
            bias -= speed * error.sum(0)
            # a mean dilutes each subword's gradient, so embeddings take larger steps
            gradient = np.repeat(back, np.diff(first), axis=0) * weight[:, None]
            np.add.at(embed, place, (-20 * speed * gradient).astype(np.float32))
            done += 1
    return embed, out, bias


def predict(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and rejected (no letter, a score under the calibrated threshold, or too
    many subwords that no training text has).

    A text that is null or has no letter gets `und` and score 0. Columns of docs with these names are replaced.
    """
    small_batches(docs.sparkSession)
    kept = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a number a bucket and language
    letter = "__letter"
    while letter in kept.columns:
        letter += "_"
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for piece in pieces(batches, text):
            has = piece.column(letter).to_numpy(zero_copy_only=False).astype(bool)
            p, over = model.scores(piece.column(text))
            if not model.languages:
                p = np.ones((piece.num_rows, 1))
                has[:] = False
            best = p.argmax(1) if len(p) else np.zeros(0, int)
            score = np.where(has, p.max(1) if len(p) else 0.0, 0.0)
            named = [model.languages[b] if h else UNKNOWN for b, h in zip(best, has)]
            made = [pa.array(named, pa.string()), pa.array(score, pa.float64()), pa.array(~has | (score < model.threshold) | (over > model.limit))]
            yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), *made], names=[*names, "lang_pred", "score", "rejected"])

    flagged = kept.withColumn(letter, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)))
    return flagged.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]))
