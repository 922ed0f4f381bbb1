"""Adaptive windows, walk-forward grids and chances of gaps against plain loops and tables."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import drift, engines

SERIES = "symbol string, ts timestamp, x double"


def stamps(n):
    return [dt.datetime(2020, 1, 1) + dt.timedelta(hours=i) for i in range(n)]


def series(seed, parts):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(mean, 0.1, size=n) for mean, n in parts]).tolist()


def plain(xs, bound):
    """Lists and means of slices."""
    window, out = [], []
    for x in xs:
        window.append(x)
        if bound.most and len(window) > bound.most:
            window = window[1:]
        m, cut = len(window), 0
        if m >= bound.least:
            for n0 in bound.cuts(m).tolist():
                a, b = window[:n0], window[n0:]
                if len(b) < bound.side:
                    continue
                if abs(sum(a) / len(a) - sum(b) / len(b)) > float(bound.gap(np.array([n0]), m)[0]):
                    cut = n0
                    break
        window = window[cut:]
        out.append((cut, len(window), sum(window) / len(window)))
    return out


@pytest.mark.parametrize("name", ["halves", "both_sides"])
def test_windows_against_a_loop(spark, name):
    many = {"steady": series(1, [(0, 300)]), "jumps": series(2, [(0, 120), (3, 200), (-1, 90)]), "short": [1.0], "long": series(3, [(0, 700), (1.5, 900)]), "flat": [5.0] * 80, None: series(5, [(0, 60), (4, 60)])}
    rows = [(s, t, x) for s, xs in many.items() for t, x in zip(stamps(len(xs)), xs, strict=True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = drift.windows(spark.createDataFrame(rows[::-1], SERIES), name).orderBy("symbol", "ts").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    cuts = 0
    for s, xs in many.items():
        mine = [r for r in got if r.symbol == s]
        want = plain(xs, drift.BOUNDS[name])
        assert [(r.cut, r.width) for r in mine] == [w[:2] for w in want], s
        assert [r["mean"] for r in mine] == pytest.approx([w[2] for w in want], abs=1e-9)
        cuts += sum(w[0] > 0 for w in want)
    assert cuts >= 4


def test_window_is_forgotten_beyond_its_most():
    window = drift.Open(drift.BOUNDS["both_sides"])
    for i in range(20_000):
        window.add(float(i % 2))
    assert window.width == 1000 and len(window.sums) <= 4096 and window.mean == pytest.approx(0.5)


def test_status_and_unsound_rows(spark):
    xs = series(7, [(0, 100), (5, 100)])
    rows = [("a", t, x) for t, x in zip(stamps(200), xs, strict=True)] + [("a", stamps(1)[0], None), ("a", stamps(1)[0], float("nan")), ("a", stamps(1)[0], float("inf")), ("b", stamps(1)[0], None)]
    got = drift.status(spark.createDataFrame(rows, SERIES)).collect()
    assert [(r.symbol, r.splits >= 1, r.size <= 130) for r in got] == [("a", True, True)]
    assert got[0]["mean"] == pytest.approx(np.mean(xs[-got[0]["size"]:])) and got[0]["std"] == pytest.approx(np.std(xs[-got[0]["size"]:]))
    assert drift.status(spark.createDataFrame([], SERIES)).collect() == []


def test_kolmogorov_table(spark):
    # tabulated critical values of the limit's distribution
    for lam, chance in ((1.22385, 0.10), (1.35810, 0.05), (1.62762, 0.01), (1.94947, 0.001)):
        assert spark.range(1).select(drift.kolmogorov(F.lit(lam))).first()[0] == pytest.approx(chance, rel=1e-4)
    assert spark.range(1).select(drift.kolmogorov(F.lit(0.0)), drift.kolmogorov(F.lit(0.2)), drift.kolmogorov(F.lit(50.0))).first()[:] == pytest.approx((1.0, 1.0, 0.0), abs=1e-9)


def walk(seed, n):
    rng = np.random.default_rng(seed)
    return (100 * np.exp(np.cumsum(rng.normal(0.001, 0.03, n)))).tolist()


def gains_of(closes, setting):
    stop, take, k = setting
    entry, out = 0.0, []
    for i, c in enumerate(closes):
        mean = np.mean(closes[max(0, i - k + 1) : i + 1])
        out.append(c / closes[i - 1] - 1 if entry else 0.0)
        if entry:
            made = c / entry - 1
            if made < -stop or made > take or c < mean:
                entry = 0.0
        elif c > mean:
            entry = c
    return out


def ratio(g):
    return round(float(np.mean(g) / np.std(g)), 9) if np.var(g) > 1e-14 else 0.0


def test_walk_forward_against_loops(spark):
    many = {"a": walk(1, 143), "b": walk(2, 80), "c": walk(3, 79), "flat": [7.0] * 90}
    bars = spark.createDataFrame([(s, t, c) for s, cs in many.items() for t, c in zip(stamps(len(cs)), cs, strict=True)], "symbol string, ts timestamp, close double")
    grid = engines.whole_grid()
    assert len(grid) == 27
    tried = engines.tried(bars, grid)
    got = {(r.symbol, r.window): (r.run.no, r.ratio, r.after) for r in engines.walked(tried).collect()}
    want, whole = {}, {}
    for s, cs in many.items():
        gains = [gains_of(cs, setting) for setting in grid]
        whole[s] = max(range(27), key=lambda no: (ratio(gains[no]), -no))
        for w in range(max(0, (len(cs) - 60) // 20)):
            at = 60 + 20 * w
            best = max(range(27), key=lambda no: (ratio(gains[no][at - 60 : at]), -no))
            want[s, w] = (best, ratio(gains[best][at - 60 : at]), math.prod(1 + g for g in gains[best][at : at + 20]) - 1)
    assert got.keys() == want.keys() and len(want) == 6
    for key, w in want.items():
        assert got[key][0] == w[0] and got[key][1:] == pytest.approx(w[1:], abs=1e-8), key
    assert {r.symbol: r.run.no for r in engines.best_setting(tried).collect()} == whole
    assert engines.walked(engines.tried(bars.limit(0), grid)).collect() == []


def test_drawn_settings_are_the_same_for_a_seed():
    a = engines.drawn(50, 7)
    assert a == engines.drawn(50, 7) != engines.drawn(50, 8)
    assert all(0.03 <= s <= 0.07 and 0.06 <= t <= 0.15 and 10 <= k <= 30 for s, t, k in a)
