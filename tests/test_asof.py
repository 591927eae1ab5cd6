"""As-of joins against a search in sorted lists."""

import bisect
import random

import pytest

from methlake.operators.asof import asof_join
from methlake.training.augment import pick_background
from pyspark.sql import functions as F


@pytest.mark.parametrize("direction", ["backward", "forward"])
def test_asof_join(spark, direction):
    rnd = random.Random(5)
    key = lambda: rnd.choice([1, 1, 1, 1, 2, 3, None])  # noqa: E731 - one key has most rows
    left = [(i, key(), rnd.choice([None, *range(60)])) for i in range(400)]
    right = [(key(), rnd.choice([None, *range(0, 60, 3)]), i, f"r{i}") for i in range(150)]
    got = asof_join(
        spark.createDataFrame(left, "id int, k int, at int").withColumn("name", F.lit("clash")), spark.createDataFrame(right, "k int, at int, t int, name string"),
        F.col("at"), F.col("at"), ["t", "name"], ["k"], direction, tie="t",
    )
    want = {}
    for i, k, at in left:
        near = [(a, t, n) for rk, a, t, n in right if rk == k and k is not None and a is not None and at is not None and (a <= at if direction == "backward" else a >= at)]
        best = (max if direction == "backward" else min)(near, default=(None, None, None))
        want[i] = (k, at, best[1], best[2])
    assert got.columns == ["id", "k", "at", "t", "name"]
    assert {r["id"]: (r["k"], r["at"], r["t"], r["name"]) for r in got.collect()} == want


def test_asof_join_of_empty_sides(spark):
    left, none = spark.createDataFrame([(1, 5)], "id int, at int"), spark.createDataFrame([], "at int, x string")
    assert [tuple(r) for r in asof_join(left, none, F.col("at"), F.col("at"), ["x"]).collect()] == [(1, 5, None)]
    assert asof_join(left.filter("false"), none, F.col("at"), F.col("at"), ["x"]).collect() == []
    with pytest.raises(ValueError):
        asof_join(left, none, F.col("at"), F.col("at"), ["x"], direction="sideways")


def test_background_from_a_bank_of_a_million(spark):
    n = 1_000_000
    bank = spark.range(n).select(F.col("id").cast("int").alias("bank_idx"), (F.col("id") * 0.5 + F.col("id") % 3 * 0.1 + 0.5).alias("cum_weight"))
    draws = spark.range(3000).select("id", (F.col("id") / 3000.0).alias("u_bg"))
    cum = [i * 0.5 + i % 3 * 0.1 + 0.5 for i in range(n)]
    top = max(cum)
    got = {r["id"]: r["bank_idx"] for r in pick_background(draws, bank).collect()}
    order = sorted(range(n), key=lambda i: (cum[i], i))
    edges = [cum[i] for i in order]
    assert got == {i: order[min(bisect.bisect_left(edges, i / 3000.0 * top), n - 1)] for i in range(3000)}
