"""Folds in time, stacking and the search over settings, against numpy and planted signals."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import ensemble

SCHEMA = "symbol int, ts timestamp, y double, a double, b double, noise double, extra string"
FEATURES = ["a", "b", "noise"]


def planted(spark, dates=40, symbols=30, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(dates):
        for s in range(symbols):
            a, b, noise = map(float, rng.normal(size=3))
            y = None if d >= dates - 2 else float(np.sign(round(a * b + 0.2 * rng.normal(), 1)))
            rows.append((s, dt.datetime(2020, 1, 1) + dt.timedelta(days=d), y, a, b, noise, "x"))
    return spark.createDataFrame(rows, SCHEMA)


def test_folds():
    d = list(range(40))
    for folds in (ensemble.purged(40, 5, 3), ensemble.forward(40, 5, 3)):
        tested = [list(range(f.lo, f.hi)) for f in folds]
        assert len({x for t in tested for x in t}) == sum(map(len, tested))
        for f, t in zip(folds, tested, strict=True):
            fitted = [x for x in d if (x < f.lo - 3) or (not f.forward and x >= f.hi + 3)]
            assert all(abs(x - y) > 2 for x in fitted for y in t)
    assert sorted(x for f in ensemble.purged(40, 5, 3) for x in range(f.lo, f.hi)) == d
    assert ensemble.forward(4, 5, 3) == []


def test_stack_finds_what_is_planted(spark):
    rows = planted(spark)
    out = ensemble.stack(rows, FEATURES, k=3, embargo=2).toPandas()
    assert len(out) == 1200 and not out.duplicated(["symbol", "ts"]).any()
    known, new = out[out.y.notna()], out[out.y.isna()]
    assert len(new) == 60 and new.fold.isna().all() and new.score.notna().all() and set(known.fold) == {0, 1, 2}
    # trees see the product of two features, a line doesn't
    assert np.corrcoef(known.forest, known.y)[0, 1] > 0.5 and abs(np.corrcoef(known.linear, known.y)[0, 1]) < 0.2
    assert np.corrcoef(known.score, known.y)[0, 1] > 0.5
    assert ((known.call == 1) == (known.score > ensemble.SURE)).all()
    again = ensemble.stack(rows, FEATURES, k=3, embargo=2).toPandas()
    order = ["symbol", "ts"]
    assert out.sort_values(order).score.to_numpy() == pytest.approx(again.sort_values(order).score.to_numpy())


def test_ridge_and_coefficients(spark):
    rng = np.random.default_rng(1)
    p, y = rng.normal(size=(200, 2)), rng.integers(-1, 2, 200).astype(float)
    rows = spark.createDataFrame([(i % 2, float(y[i]), float(y[i] > 0), float(p[i, 0]), float(p[i, 1])) for i in range(200)], "fold int, y double, up double, m double, n double")
    intercept, w = ensemble.ridge(rows, ["m", "n"], 1.0)
    z, t = p - p.mean(0), y - y.mean()
    want = np.linalg.solve(z.T @ z + np.eye(2), z.T @ t)
    assert [w["m"], w["n"]] == pytest.approx(list(want)) and intercept == pytest.approx(y.mean() - want @ p.mean(0))
    for r in ensemble.coefficients(rows.withColumn("flat", F.lit(0.5)), ["m", "n", "flat"]).collect():
        half = np.arange(200) % 2 == r.fold
        assert r.ic == pytest.approx(0.0 if r.learner == "flat" else np.corrcoef(p[half, ["m", "n"].index(r.learner)], y[half])[0, 1])
    assert ensemble.ridge(rows.limit(0), ["m", "n"]) == (0.0, {"m": 0.5, "n": 0.5})


def test_little_or_unsound_rows(spark):
    odd = planted(spark, dates=6, symbols=3)
    holes = odd.withColumn("a", F.when(F.col("symbol") == 0, F.lit(None)).when(F.col("symbol") == 1, F.lit(float("nan"))).otherwise(F.col("a")))
    out = ensemble.stack(holes, FEATURES, k=3, embargo=1).collect()
    assert len(out) == 6 and all(r.score is None and r.call is None for r in out)
    assert ensemble.stack(odd.limit(0), FEATURES).collect() == []
    assert ensemble.tested_forward(odd.limit(0), FEATURES).collect() == []


def test_search_prefers_what_fits(spark):
    out = sorted(ensemble.searched(planted(spark), FEATURES, {"depth": (1, 3), "rounds": (2, 6)}, k=2, embargo=2).collect(), key=lambda r: r.place)
    assert len(out) == 4 and out[0].depth == 3 and out[0].ic > 0.4 and all(r.folds == 2 for r in out)
    assert [r.ic for r in out] == sorted((r.ic for r in out), reverse=True)


def test_partitions_are_the_fits_own(spark, monkeypatch):
    """As many whatever the session's number, so that tasks and what they send don't grow with it, and trees are the same; more where rows ask for them."""
    rows, was = planted(spark), spark.conf.get("spark.sql.shuffle.partitions")
    said = []
    try:
        for n in (3, 50):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            table = ensemble.Table(rows, FEATURES)
            assert table.rows.rdd.getNumPartitions() == ensemble.PARTS and table.dates == 38 and table.rows.count() == 1200
            table.close()
            out = ensemble.tested_forward(rows, FEATURES, {"boosted": ensemble.boosted(depth=2, rounds=2)}, k=2, embargo=2).collect()
            said.append(sorted((r.fold, r.n, round(r.ic, 9)) for r in out))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert said[0] == said[1] and len(said[0]) == 2
    monkeypatch.setattr(ensemble, "PART_ROWS", 30)
    table = ensemble.Table(rows, FEATURES)
    assert table.rows.rdd.getNumPartitions() == 38
    table.close()
