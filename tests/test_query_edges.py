"""Registered queries against their SQL on values at the edges of single precision and of rounding."""

import math

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from methlake.plans import catalog
from parity import compare, connect


def _folder(path, rows: np.ndarray) -> str:
    table = pa.table({
        "vec_id": pa.array(range(len(rows)), pa.int64()),
        "embedding": pa.array(list(rows.astype(np.float32)), pa.list_(pa.float32())),
        "label": pa.array([i % 10 for i in range(len(rows))], pa.int32()),
    })
    pq.write_table(table, f"{path}/embeddings.parquet")
    return str(path)


def _edges(by: int) -> np.ndarray:
    """Values of single precision whose product with a number falls on the two sides of an integer in single and in double."""
    x = (np.arange(-60 * by // 100, 60 * by // 100) / by).astype(np.float32)
    x = np.concatenate([np.nextafter(x, np.float32(-1)), x, np.nextafter(x, np.float32(1))])
    return x[np.floor(x * np.float32(by)) != np.floor(x.astype(float) * by)]


@pytest.mark.parametrize("name, by", [("code_histogram", 1000), ("immune_projection", 1000), ("matrix_product", 100)])
def test_products_of_single_precision(spark, tmp_path, name, by):
    sf = _folder(tmp_path, np.random.default_rng(3).choice(_edges(by), (60, 64)))
    assert compare(spark, connect(sf), catalog.QUERIES[name], catalog.SQL[name], sf) is None


def test_what_rounds_to_zero_keeps_its_sign(spark, tmp_path):
    sf = _folder(tmp_path, np.tile([-1e-8, 1e-8, -0.0, 0.0, -0.3, 0.3, -90.0, 90.0], (3, 8)))
    got = {r["vec_id"]: r["y"] for r in catalog.QUERIES["silu"](spark, sf).collect()}
    want = dict(connect(sf).execute(catalog.SQL["silu"]).fetchall())
    assert got == want
    signs = [{k: [math.copysign(1, v) for v in y] for k, y in rows.items()} for rows in (got, want)]
    assert signs[0] == signs[1]


def test_rows_are_dealt_into_parts_that_grow_with_their_scan(spark, tmp_path):
    from methlake.plans.registry import SHARES, dealt

    spark.range(4000).repartition(40).write.parquet(f"{tmp_path}/t")
    scan = spark.read.parquet(f"{tmp_path}/t")
    files = scan.rdd.getNumPartitions()
    assert dealt(scan, scan, "id").rdd.getNumPartitions() == max(4, SHARES * files)


def test_profiles_do_not_depend_on_the_order_of_rows(spark):
    from fractions import Fraction

    from methlake.training import purity

    code = np.random.default_rng(7).integers(0, 256, (3, 60_000))
    code[code > purity.TOP_CODE] = purity.MISSING_CODE
    frame = spark.createDataFrame(pa.table({"col": np.repeat([0, 1, 2], 60_000), "code": code.ravel().astype(np.int32)}))
    got = {r["col"]: r["mean"] for r in purity.profile(frame.repartition(5)).collect()}
    kept = [[Fraction(2 * int(c) + 1, 500) for c in one if c <= purity.TOP_CODE] for one in code]
    for col, betas in enumerate(kept):
        assert abs(Fraction(got[col]) / (sum(betas) / len(betas)) - 1) < Fraction(1, 1 << 52)
