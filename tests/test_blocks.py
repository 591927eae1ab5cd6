"""Tensor files written side by side, and gradients of the columns that a batch touches."""

import numpy as np
import pytest

from methlake.model import gradients as G
from methlake.sources import tensors as TS

SHAPES = {"b": (3, 50_000), "a": (7,), "é": (2, 2, 2), "z": ()}


def blocks_of(spark, tensors):
    rows = []
    for name, a in tensors.items():
        flat = a.ravel()
        rows += [(name, list(a.shape), b, flat[b * TS.BLOCK : (b + 1) * TS.BLOCK].tolist()) for b in range(max(1, -(-flat.size // TS.BLOCK)))]
    return spark.createDataFrame(rows, TS.BLOCKS_SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def tensors():
    rnd = np.random.default_rng(0)
    return {n: rnd.normal(size=s).astype(np.float32) for n, s in SHAPES.items()}


def test_side_by_side_gives_the_bytes_of_one_stream(spark, tensors, tmp_path, monkeypatch):
    blocks = blocks_of(spark, tensors)
    monkeypatch.setattr(TS, "TASK_BLOCKS", 1)  # several tasks
    TS.write_tensors(blocks, str(tmp_path / "a.safetensors"))
    monkeypatch.setattr(TS, "seekable", lambda path: None)
    TS.write_tensors(blocks, str(tmp_path / "b.safetensors"))
    raw = (tmp_path / "a.safetensors").read_bytes()
    assert raw == (tmp_path / "b.safetensors").read_bytes() and not list(tmp_path.glob("*.part"))
    assert raw.endswith(tensors["é"].tobytes())
    back = {}
    for r in TS.read_tensors(spark, str(tmp_path / "a.safetensors")).orderBy("name", "block").collect():
        back.setdefault(r["name"], []).extend(r["values"])
    assert all(np.array_equal(np.array(back[n], np.float32), a.ravel()) for n, a in tensors.items())


def test_blocks_that_miss_or_repeat_leave_no_file(spark, tensors, tmp_path):
    blocks = blocks_of(spark, tensors)
    path = str(tmp_path / "c.safetensors")
    with pytest.raises(RuntimeError, match="wrote"):
        TS.write_tensors(blocks.filter("NOT (name = 'b' AND block = 1)"), path, SHAPES)
    with pytest.raises(ValueError, match="twice"):
        TS.write_tensors(blocks.unionAll(blocks.filter("name = 'a'")), path, SHAPES)
    with pytest.raises(Exception, match="block 0 has 7 values"):
        TS.write_tensors(blocks, path, SHAPES | {"a": (8,)})
    assert not (tmp_path / "c.safetensors").exists()


def test_touched_columns_add_up_to_the_dense_sums(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 64)
    rnd = np.random.default_rng(3)
    width, rows, dense, parts = 150, 4, np.zeros((4, 150)), []
    for _ in range(5):  # so many tasks
        columns = G.Columns("w", rows, width)
        for _ in range(3):  # so many batches
            n = int(rnd.integers(0, 4))
            deltas = rnd.normal(size=(n, rows))
            picks = [rnd.permutation(40)[: rnd.integers(0, 12)] * 3 for _ in range(n)]
            plus, minus = [p[::2] for p in picks], [p[1::2] for p in picks]
            columns.add(deltas, plus, minus)
            for d, p, m in zip(deltas, plus, minus):
                dense[:, p] += d[:, None]
                dense[:, m] -= d[:, None]
        assert columns.sums.shape[1] <= 40
        parts.append(columns.rows())
        parts.append(G.rows_of({"w": np.ones((rows, width)), G.STATS: np.array([1.0, 2.0])}))
    got = {}
    import pandas as pd

    def whole(pdf):
        total = np.zeros(max(1, min(G.BLOCK, int(np.prod(pdf["shape"].iloc[0])) - int(pdf["block"].iloc[0]) * G.BLOCK)))
        for values, places in zip(pdf["values"], pdf["places"]):
            if places is None:
                total += values
            else:
                total[np.frombuffer(places, "<i4")] += values
        return total

    for (name, block), pdf in pd.concat(parts).groupby(["name", "block"]):
        got[name, block] = whole(pdf)
    assert np.allclose(np.concatenate([got["w", b] for b in range(-(-rows * width // 64))]), dense.ravel() + 5)
    assert got[G.STATS, 0].tolist() == [5.0, 10.0]


def test_sum_blocks_takes_whole_and_sparse_rows(spark):
    rows = [("w", [2, 3], 0, [1.0] * 6, None), ("w", [2, 3], 0, [5.0, 7.0], np.array([1, 4], "<i4").tobytes()), ("v", [2], 0, [3.0], np.array([1], "<i4").tobytes())]
    got = {r["name"]: r["values"] for r in G.sum_blocks(spark.createDataFrame(rows, G.PARTS_SCHEMA).repartition(3)).collect()}
    assert got == {"w": [1, 6, 1, 1, 8, 1], "v": [0, 3]}
