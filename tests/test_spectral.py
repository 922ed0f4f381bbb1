"""Eigenvectors of graphs against numpy."""

import numpy as np
import pytest

from tapeloom.operators import spectral


def laplacian(n, edges):
    a = np.zeros((n, n))
    for i, j, w in edges:
        if i != j and w and w > 0:
            a[i, j] += w / 2
            a[j, i] += w / 2
    d = a.sum(1)
    r = np.where(d > 0, 1 / np.sqrt(np.where(d > 0, d, 1)), 0)
    return np.eye(n) - r[:, None] * a * r[None]


def found(spark, n, edges, k):
    v, values = spectral.embedding(spark.range(n).withColumnRenamed("id", "k"), spark.createDataFrame(edges, "src long, dst long, w double"), k)
    return np.array([r.v for r in v.orderBy("k").collect()]), values


@pytest.mark.parametrize(("n", "links"), [(25, 80), (150, 500)])
def test_residuals_and_values(spark, n, links):
    rng = np.random.default_rng(n)
    edges = [(int(rng.integers(n)), int(rng.integers(n)), float(rng.random())) for _ in range(links)] + [(0, 1, None), (1, 2, -1.0)]
    x, values = found(spark, n, edges, 4)
    lap = laplacian(n, edges)
    assert values == pytest.approx(np.linalg.eigvalsh(lap)[:4], abs=1e-8)
    assert np.abs(lap @ x - x * values).max() < 1e-6 and x.T @ x == pytest.approx(np.eye(4), abs=1e-8)
    assert all(c[np.abs(c).round(6).argmax()] > 0 for c in x.T)


def test_small_graphs(spark):
    x, values = found(spark, 3, [(0, 1, 1.0)], 4)
    assert x.shape == (3, 4) and len(values) == 3 and not x[:, 3].any() and values == pytest.approx([0, 1, 2], abs=1e-9)
    assert found(spark, 0, [], 2)[0].shape == (0,)
