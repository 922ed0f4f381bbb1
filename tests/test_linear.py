"""Gram matrices, projections, sweeps and mixtures of any size against numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import linear


def table(spark, k, dates=3, rows=60, seed=1):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(k, k)) * 0.4 + np.eye(k)
    out, data = [], {}
    for d in range(dates):
        x = rng.normal(size=(rows, k)) @ mix
        if k > 4:
            x[:, 3] = -x[:, 1]  # explained by another one
            x[:, 4] = 2.5  # does not vary
        y = x @ rng.normal(size=k) + rng.normal(size=rows)
        data[d] = (x, y)
        out += [(d, i, float(y[i]), *map(float, x[i])) for i in range(rows)]
    names = [f"c{i}" for i in range(k)]
    return spark.createDataFrame(out, "ts int, symbol int, y double, " + ", ".join(f"{c} double" for c in names)), names, data


def scaled(x):
    sd = x.std(0)
    return np.where(sd > 1e-10, (x - x.mean(0)) / np.where(sd > 1e-10, sd, 1), 0)


@pytest.mark.parametrize("k", [3, 8, 21])
def test_projections_and_regressions(spark, k):
    df, names, data = table(spark, k)
    q = {(r.ts, r.symbol): r.q for r in linear.orthogonal_factors(df, names).collect()}
    vif = {(r.ts, r.factor): r.vif for r in linear.inflation(df, names).collect()}
    fit = {(r.ts, r.factor): (r.slope, r.t) for r in linear.regressions(df, names, "y").collect()}
    left = {(r.ts, r.factor): r.left for r in linear.left_of_factors(df, names).collect()}
    for d, (x, y) in data.items():
        z, want = scaled(x), []
        for j in range(k):
            v = z[:, j].copy()
            for p in want:
                if p @ p > 1e-6 * len(z):
                    v -= p * (p @ v) / (p @ p)
            want.append(v)
        want = np.stack(want, 1)
        got = np.array([q[d, i] for i in range(len(z))])
        assert got == pytest.approx(want, abs=1e-8)
        used = [j for j in range(k) if want[:, j] @ want[:, j] > 1e-6 * len(z)]
        design = np.column_stack([np.ones(len(z)), z[:, used]])
        slopes, *_ = np.linalg.lstsq(design, y, rcond=None)
        rest = y - design @ slopes
        cov = np.linalg.inv(design.T @ design) * (rest @ rest) / (len(z) - design.shape[1])
        assert {n for t, n in fit if t == d} == {names[j] for j in used}
        for place, j in enumerate(used, 1):
            assert fit[d, names[j]] == pytest.approx((slopes[place], slopes[place] / math.sqrt(cov[place, place])), rel=1e-6)
            others = np.column_stack([np.ones(len(z)), z[:, [i for i in used if i != j]]])
            free = z[:, j] - others @ np.linalg.lstsq(others, z[:, j], rcond=None)[0]
            assert vif[d, names[j]] == pytest.approx(len(z) / (free @ free), rel=1e-6)
            assert left[d, names[j]] == pytest.approx(want[:, j] @ want[:, j] / len(z), abs=1e-9)
        assert all(vif[d, names[j]] is None and left[d, names[j]] < 1e-9 for j in range(k) if j not in used)


def test_greedy_removal(spark):
    df, names, data = table(spark, 8, dates=1, rows=400)
    x = scaled(data[0][0])
    c, kept = x.T @ x / len(x), []
    for j in range(8):
        kept.append(not any(kept[i] and abs(c[i, j]) > 0.7 for i in range(j)))
    got = {r.factor: r.kept for r in linear.uncorrelated(df, names).collect()}
    assert [got[n] for n in names] == kept and not all(kept)


def test_one_row_and_none(spark):
    df, names, _ = table(spark, 3)
    one = df.filter("ts = 0 AND symbol = 0")
    assert linear.orthogonal_factors(one, names).select("q").first()[0] == [0.0, 0.0, 0.0]
    assert linear.regressions(one, names, "y").collect() == [] and linear.orthogonal_factors(df.filter(F.lit(False)), names).collect() == []


def plain_mixture(x, k, rounds):
    z = (x - x.mean(0)) / x.std(0)
    n, d = z.shape
    w, m, c = np.full(k, 1 / k), np.zeros((k, d)), np.repeat(np.eye(d)[None], k, 0)
    m[:, 0] = np.linspace(-1, 1, k)
    seen = []
    for _ in range(rounds):
        p = np.stack([w[j] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", z - m[j], np.linalg.inv(c[j]), z - m[j])) / np.sqrt((2 * np.pi) ** d * np.linalg.det(c[j])) for j in range(k)], 1)
        seen.append(np.log(p.sum(1)).mean())
        r = p / p.sum(1, keepdims=True)
        w = r.mean(0)
        m = r.T @ z / r.sum(0)[:, None]
        c = np.stack([((z - m[j]) * r[:, [j]]).T @ (z - m[j]) / r[:, j].sum() + 1e-6 * np.eye(d) for j in range(k)])
    return w, m, c, seen


def test_mixture_is_that_of_a_loop_and_likelihood_does_not_fall(spark):
    from tapeloom.operators import mixture

    rng = np.random.default_rng(5)
    true = rng.integers(0, 3, 900)
    x = rng.normal(size=(900, 4)) @ (np.eye(4) + 0.3) + np.array([[-4, 1, 0, 0], [0, 0, 2, 0], [4, -1, 0, 3]])[true]
    rows = [(i, i, *map(float, v)) for i, v in enumerate(x)] + [(1000, 0, float("nan"), 0.0, 0.0, 0.0), (1001, 0, None, 0.0, 0.0, 0.0), (1002, 0, float("inf"), 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "symbol int, ts int, a double, b double, c double, d double").repartition(5)
    model = mixture.fit(df, list("abcd"), rounds=12, gain=-1)
    w, m, c, seen = plain_mixture(x, 3, 12)
    assert model.weights == pytest.approx(w) and model.means == pytest.approx(m, abs=1e-8) and model.covariances == pytest.approx(c, abs=1e-8)
    assert model.likelihoods == pytest.approx(seen) and all(b >= a - 1e-9 for a, b in zip(seen, seen[1:], strict=False))
    out = mixture.regimes(df, list("abcd"), mixture.fit(df, list("abcd"))).collect()
    assert len(out) == 900 and np.mean([r.regime == true[r.symbol] for r in out]) > 0.9
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in out)
    with pytest.raises(ValueError):
        mixture.fit(df.filter("symbol > 999"), list("abcd"))


def test_gram_adds_products_in_tasks_and_takes_pairs_that_are_there(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (1, 3.0, None), (1, 2.0, 5.0), (None, 4.0, 1.0), (None, 6.0, 2.0)], "ts int, a double, b double")
    out = linear.gram(df, ["a", "b"], "ts")
    assert "MapInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {r.ts: r for r in out.collect()}
    assert [got[1].n, got[None].n] == [3, 2] and got[1].means == [2.0, 3.5] and got[None].means == [5.0, 1.5]
    assert got[1].s[0][1] == pytest.approx((12 / 2 - 7) / (math.sqrt(14 / 3 - 4) * 1.5)) and got[None].s[0][1] == pytest.approx(1.0)


def test_mixture_reads_its_rows_once(spark):
    """However many rounds: what a round reads are packed blocks, and all rows are in them."""
    from tapeloom.operators import mixture

    seen = spark.sparkContext.accumulator(0)

    def told(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    x = np.random.default_rng(5).normal(size=(5000, 2))
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "symbol int, a double, b double").repartition(3)
    model = mixture.fit(df.mapInArrow(told, df.schema), ["a", "b"], rounds=4, gain=-1)
    assert seen.value == 5000
    assert model.centre == pytest.approx(x.mean(0)) and model.scale == pytest.approx(x.std(0)) and model.weights.sum() == pytest.approx(1)
