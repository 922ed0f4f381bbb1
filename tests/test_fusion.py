"""Vectors of fixed width against numpy, and what a projection does to distances."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import fusion


def vectors(spark, rows, n, width):
    df = spark.createDataFrame([(i, [None if x is None else float(x) for x in r]) for i, r in enumerate(rows)], "i int, x array<double>")
    return np.array([r.v for r in df.select("i", fusion.fused([(F.col("x"), n)], width).alias("v")).orderBy("i").collect()])


def test_filled_and_projected(spark):
    x = np.random.default_rng(2).normal(size=(60, 80))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert vectors(spark, x, 80, 128) == pytest.approx(np.hstack([unit, np.zeros((60, 48))]))
    for width in (64, 80):
        assert vectors(spark, x, 80, width) == pytest.approx(unit @ fusion.projection(80, width), abs=1e-12)


@pytest.mark.parametrize("width", [64, 128])
def test_projection_keeps_distances(spark, width):
    n = 512
    x = np.random.default_rng(5).normal(size=(40, n))
    unit, got = x / np.linalg.norm(x, axis=1, keepdims=True), vectors(spark, x, n, width)
    pairs = [(i, j) for i in range(40) for j in range(i)]
    # draws have variance 1 / n, so squared distances are scaled by width / n
    stretch = [np.linalg.norm(got[i] - got[j]) / np.linalg.norm(unit[i] - unit[j]) / np.sqrt(width / n) for i, j in pairs]
    assert np.mean(stretch) == pytest.approx(1, abs=0.06) and np.mean(np.abs(np.array(stretch) - 1)) < 1.2 / np.sqrt(width)


def test_spread_and_nulls(spark):
    df = spark.createDataFrame([(1.0, 3.0, 2.0), (4.0, 4.0, 4.0), (None, 5.0, -5.0)], "a double, b double, c double")
    out = [r.v for r in df.select(fusion.spread([F.col(c) for c in "abc"]).alias("v")).collect()]
    assert out == [[0.0, 1.0, 0.5], [0.0, 0.0, 0.0], [0.5, 1.0, 0.0]]
    empty = vectors(spark, [[None, None, None], [0, 0, 0]], 3, 5)
    assert empty.shape == (2, 5) and not empty.any()
    none = spark.range(1).select(fusion.fused([(F.lit(None).cast("array<double>"), 3), (F.array(F.lit(2.0)), 1)], 5).alias("v")).first().v
    assert none == [0.0, 0.0, 0.0, 1.0, 0.0]


def test_norm_and_ends_are_worked_out_once_a_row(spark):
    v = F.array(*(F.lit(float(i)) for i in range(5)))
    assert str(fusion.fused([(v, 5)], 8)).count("sqrt(") == 1
    assert str(fusion.spread([F.lit(1.0), F.lit(2.0)])).count("array_max(") == 1
