"""Engines, optimisers and cool-downs against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tapeloom.operators import composites, engines, fold, learning, optimise
from tapeloom.operators.steps import doubles, rules


def day(i):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=i)


def test_purse_follows_its_rules(spark):
    rows = [("a", day(0), 1, 100.0, "buy"), ("a", day(0), 2, 50.0, "buy"), ("a", day(1), 1, 110.0, "sell"), ("a", day(1), 2, 55.0, "hold"), ("b", day(0), 1, 2_000_000.0, "buy"), ("a", day(2), 2, 40.0, "sell"), ("a", day(2), 2, 40.0, "sell")]
    out = {(r.strategy, r.ts): r for r in engines.portfolio(spark.createDataFrame(rows, "strategy string, ts timestamp_ntz, symbol long, price double, side string")).collect()}
    cash = engines.PURSE - 1000 * 100 * 1.001 - max(1000 * 100 * 0.0003, 5)
    second = int(cash * 0.1 / 50) // 100 * 100
    cash -= second * 50 * 1.001 + max(second * 50 * 0.0003, 5)
    assert out["a", day(0)].cash == pytest.approx(cash) and out["a", day(0)].value == pytest.approx(cash + 100_000 + second * 50)
    cash += 110_000 - 33 - 220
    assert out["a", day(1)].cash == pytest.approx(cash) and out["a", day(2)].trades == 4
    assert out["b", day(0)].value == engines.PURSE and len(out) == 4


def test_what_is_bought_today_is_not_sold_today(spark):
    rows = [("a", day(0), 1, 10.0, "buy"), ("a", day(0), 1, 10.0, "sell"), ("a", day(1), 1, 10.0, "sell")]
    out = [list(engines.purse("a", iter([r[1:] for r in rows])))[k][4] for k in (0, 1)]
    assert out == [1, 2]


@pytest.mark.parametrize("seconds", [1, 40, 3600, 100_000])
def test_cooldown_is_that_of_a_loop(spark, seconds):
    rng = random.Random(seconds)
    events = [(t, dt.datetime(2021, 5, 1) + dt.timedelta(seconds=round(rng.random() ** 3 * 200_000, 3))) for t in "ab" for _ in range(600)] + [("c", dt.datetime(2021, 5, 1))] * 3
    want = {}
    for t in "abc":
        last, n = None, 0
        for at in sorted(x for k, x in events if k == t):
            if last is None or (at - last).total_seconds() >= seconds:
                last, n = at, n + 1
        want[t] = (sum(k == t for k, _ in events), n)
    df = spark.createDataFrame(events, "event_type string, ts timestamp")
    for block in (60, 3600, 50_000):
        assert {r.event_type: (r.hits, r.fired) for r in learning.cooldown(df, seconds, block).collect()} == want
    assert learning.cooldown(df.limit(0), seconds).collect() == []
    # several levels of functions, each of a few
    before, learning.FAN = learning.FAN, 3
    try:
        assert {r.event_type: (r.hits, r.fired) for r in learning.cooldown(df, seconds, 12).collect()} == want
    finally:
        learning.FAN = before


def test_a_dense_type_is_cut_into_blocks(spark):
    """A million events of one type, nine tenths of them within one cool-down: no group holds more than a few blocks, and the count is that of a loop."""
    from pyspark.sql import functions as F

    seconds = F.when(F.col("id") % 10 == 0, F.col("id") * 0.37).otherwise(100_000 + F.col("id") * 0.0005)
    df = spark.range(1_000_000).select(F.lit("t").alias("event_type"), F.timestamp_micros((F.lit(1_600_000_000_000_000) + F.floor(seconds * 1_000_000)).cast("long")).alias("ts"))
    import numpy as np

    i = np.arange(1_000_000)
    at = np.sort(np.floor(np.where(i % 10 == 0, i * 0.37, 100_000 + i * 0.0005) * 1e6).astype(np.int64))
    n, k = 0, 0
    while k < len(at):
        n, k = n + 1, int(np.searchsorted(at, at[k] + 3_600_000_000, "left"))
    assert [(r.hits, r.fired) for r in learning.cooldown(df, 3600).collect()] == [(1_000_000, n)]


def test_solves():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) @ rng.normal(size=(6, 6))
    cov, mean = np.cov(x.T), np.abs(rng.normal(size=6))
    w = optimise.minimum_variance(cov)
    assert w.sum() == pytest.approx(1)
    for _ in range(200):
        other = w + rng.normal(size=6) * 0.05
        assert other @ cov @ other / other.sum() ** 2 >= w @ cov @ w - 1e-9
    parity = optimise.risk_parity(cov + 20 * np.eye(6))
    share = parity * ((cov + 20 * np.eye(6)) @ parity)
    assert np.ptp(share / share.sum()) < 1e-3 and parity.sum() == pytest.approx(1)
    s = optimise.maximum_sharpe(mean, cov, cap=1e9)
    for _ in range(200):
        other = s + rng.normal(size=6) * 0.05
        assert other @ mean / np.sqrt(other @ cov @ other) <= abs(s @ mean) / np.sqrt(s @ cov @ s) + 1e-9
    capped = optimise.constrained(np.array([0.7, 0.2, 0.05, 0.03, 0.02]))
    assert capped.sum() == pytest.approx(1) and capped.max() <= 0.25 + 1e-9


def test_views_tilt_the_market(spark):
    def weights(sizes, views, variance):
        assets = spark.createDataFrame([(i, s, float(v)) for i, (s, v) in enumerate(zip(sizes, variance, strict=True))], "name int, size double, variance double")
        rows = optimise.view_weights(assets, spark.createDataFrame(views, "name int, ret double, confidence double")).collect()
        return [r.weight for r in sorted(rows, key=lambda r: r.name)]

    rng = np.random.default_rng(4)
    half = rng.normal(size=(4, 4))
    cov = half @ half.T * 0.05 + 0.02 * np.eye(4)
    sizes, views = [4.0, 1.0, 3.0, 2.0], [(1, 0.3, 0.9), (3, -0.2, 0.3), (1, 0.1, 0.5), (9, 1.0, 1.0)]
    # the long way, by the views' gain and a dense solve
    pick = np.eye(4)[[1, 3, 1]]
    doubt = np.diag([(1 / c - 1) * 0.05 * cov[i, i] for i, _, c in views[:3]])
    gain = 0.05 * cov @ pick.T @ np.linalg.inv(pick @ (0.05 * cov) @ pick.T + doubt)
    prior = 2 * cov @ (np.array(sizes) / 10)
    mean = prior + gain @ (np.array([r for _, r, _ in views[:3]]) - pick @ prior)
    want = np.maximum(np.linalg.solve(0.05 * cov - gain @ pick @ (0.05 * cov) + np.outer(mean, mean), mean), 0)
    assert weights(sizes, views, np.diag(cov)) == pytest.approx(list(want / want.sum()), rel=1e-6)
    assert weights([1.0, 2.0, 3.0], [], [0.09] * 3) == pytest.approx([1 / 6, 2 / 6, 3 / 6])
    assert weights([0.0, None, -1.0], [], [0.09] * 3) == pytest.approx([1 / 3] * 3)
    assert weights([1.0, 3.0], [(0, -9.0, 1.0), (1, -9.0, 1.0)], [0.09] * 2) == pytest.approx([0.25, 0.75])
    assert weights([], [], []) == []


def test_long_series_fold_in_chunks(spark):
    n = 3 * fold.CHUNK + 7
    rows = [(1, day(i), float(i % 17) + 1) for i in range(n)]
    got = [r.ema for r in fold.ema_series(spark.createDataFrame(rows, "symbol long, ts timestamp, close double"), 12).orderBy("ts").collect()]
    state, want = rows[0][2], []
    for _, _, x in rows:
        state += (x - state) * 2 / 13
        want.append(state)
    assert got == pytest.approx(want)


def test_fractions_are_doubles(spark):
    assert doubles("a > 0.25 AND b1.5 < 2 AND c = '0.5'") == "a > 0.25e0 AND b1.5 < 2 AND c = '0.5'"
    r = rules({"y": "x * 0.1"}, {"z": "y + 1"}, out="z:3", where="x > 1.5")
    out = r.apply(spark.createDataFrame([(1.0,), (2.0,)], "x double"), "x")
    assert [tuple(v) for v in out.collect()] == [(2.0, 1.2)] and out.schema["z"].dataType.simpleString() == "double"
    assert out.select(F.col("z")).count() == 1


def test_walk_forward_runs_the_purse_anew_in_each_window(spark):
    rng = random.Random(5)
    rows = [("a", day(i), s, float(rng.randint(8, 12)), rng.choice(["buy", "sell", "hold"])) for i in range(17) for s in (1, 2)]
    out = composites.walk_forward(spark.createDataFrame(rows, "strategy string, ts timestamp_ntz, symbol long, price double, side string"), train=5, test=4, step=3).collect()
    want = set()
    for w, i in enumerate(range(0, 17 - 5 - 4, 3)):
        inside = [r[1:] for r in rows if day(i + 5) <= r[1] < day(i + 9)]
        want |= {(f"a@{w}", ts, round(cash, 6), round(value, 6), trades) for _, ts, cash, value, trades in engines.purse("", iter(inside))}
    assert {(r.strategy, r.ts, round(r.cash, 6), round(r.value, 6), r.trades) for r in out} == want and len(out) == len(want) == 12


def test_event_equity_refuses_large_orders_and_stops_after_a_loss(spark):
    rows = [(1, day(0), 100.0, "buy", 100.0), (1, day(1), 105.0, "hold", 105.0), (1, day(2), 110.0, "sell", 110.0), (1, day(3), 110.0, "sell", 110.0), (1, day(4), 110.0, "buy", None), (2, day(0), 2000.0, "buy", 10_000.0), (2, day(1), 100.0, "buy", 100.0), (3, day(0), 5000.0, "buy", 5000.0)]
    out = {(r.symbol, r.ts): r for r in composites.event_equity(spark.createDataFrame(rows, "symbol long, ts timestamp_ntz, close double, side string, price double")).collect()}
    assert [out[1, day(i)].trades for i in range(5)] == [1, 1, 2, 2, 2] and out[1, day(4)].quantity == 0
    assert out[1, day(4)].cash == pytest.approx(1e5 - 1000 * 1.0003 + 1100 * 0.9987)
    # the second symbol bought far above its close, the third's order is half of its equity
    assert out[2, day(1)].trades == 1 and out[3, day(0)].trades == 0
    empty = spark.createDataFrame([], "symbol long, ts timestamp_ntz, close double, side string, price double")
    assert composites.event_equity(empty).count() == 0
