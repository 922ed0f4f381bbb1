"""Queries of states, sizing, fallbacks and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import crosssection as x
from tapeloom.operators import fold, rules, states
from tapeloom.operators.timeseries import returns
from tapeloom.plans.panels import DECAY, IC, PANEL
from tapeloom.plans.registry import ALL, DIMS, MONTHLY, RETURNS, WEEKLY, W, over, query
from tapeloom.plans.series import RECURSIVE, _DIFFS, wilder_sql
from tapeloom.sources import market as m


@query("s03_source_fallback", f"WITH {MONTHLY}, a AS (SELECT symbol, ts, CASE WHEN n > 1 THEN close END AS close FROM bars), b AS (SELECT symbol, ts, open AS close FROM bars) SELECT coalesce(a.symbol, b.symbol) AS symbol, coalesce(a.ts, b.ts) AS ts, round(coalesce(a.close, b.close) + 1e-9, 6) AS close, CASE WHEN a.close IS NOT NULL THEN 'first' ELSE 'second' END AS origin FROM a FULL JOIN b ON a.symbol = b.symbol AND a.ts = b.ts")
def s03(spark, d):
    """Bars of a single tick have no close of their own in the first source."""
    b = m.monthly_bars(spark, d)
    out = states.fallback(b.select("symbol", "ts", F.when(F.col("n") > 1, F.col("close")).alias("close")), b.select("symbol", "ts", F.col("open").alias("close")), ["symbol", "ts"], "close")
    return out.withColumn("close", F.round(F.col("close") + 1e-9, 6))


@query("s11_enriched_snapshot", f"WITH {MONTHLY}, {DIMS}, k AS (SELECT symbol, count(*) AS bars, max(close) AS highest, avg(volume) AS mean_volume FROM bars GROUP BY 1) SELECT dims.symbol, industry, sector, bars, round(highest + 1e-9, 6) AS highest, round(mean_volume, 6) AS mean_volume FROM dims LEFT JOIN k USING (symbol)")
def s11(spark, d):
    k = m.monthly_bars(spark, d).groupBy("symbol").agg(F.count("*").alias("bars"), F.max("close").alias("highest"), F.avg("volume").alias("mean_volume"))
    return m.industries(spark, d).join(k, "symbol", "left").select("symbol", "industry", "sector", "bars", F.round(F.col("highest") + 1e-9, 6).alias("highest"), F.round("mean_volume", 6).alias("mean_volume"))


@query("p16_market_state", f"WITH {MONTHLY}, {RETURNS}, q AS (SELECT symbol, ts, stddev_pop(ret) {over(20)} AS v, avg(close) {over(5)} / avg(close) {over(20)} - 1 AS t, coalesce((close - min(close) {over(60)}) / nullif(max(close) {over(60)} - min(close) {over(60)}, 0), 0.5) AS p FROM r) SELECT symbol, ts, CASE WHEN v > 0.8 THEN 'high' WHEN v > 0.4 THEN 'medium' ELSE 'low' END AS volatility, CASE WHEN t > 0.05 THEN 'up' WHEN t < -0.05 THEN 'down' ELSE 'flat' END AS trend, CASE WHEN p > 0.8 THEN 'top' WHEN p < 0.2 THEN 'bottom' ELSE 'middle' END AS place FROM q")
def p16(spark, d):
    return states.market_state(m.monthly_bars(spark, d))


@query("p17_entry_signals", f"WITH {MONTHLY}, {RETURNS}, q AS (SELECT symbol, ts, close, ret, volume, avg(close) {over(20)} AS ma, min(close) {over(20)} AS lo, avg(volume) {over(20)} AS mv FROM r) SELECT symbol, ts, 'above_mean' AS rule, 0.3::DOUBLE AS weight FROM q WHERE close > ma * 1.05 UNION ALL SELECT symbol, ts, 'near_low', 0.4 FROM q WHERE close <= lo * 1.02 UNION ALL SELECT symbol, ts, 'oversold', 0.2 FROM q WHERE ret < -0.05 UNION ALL SELECT symbol, ts, 'volume_surge', 0.1 FROM q WHERE volume > 2 * mv")
def p17(spark, d):
    return states.entries(m.monthly_bars(spark, d))


@query("p23_valuation_level", f"WITH {MONTHLY}, {DIMS}, q AS (SELECT symbol, industry, c AS close FROM (SELECT symbol, arg_max(close, ts) AS c FROM bars GROUP BY 1) JOIN dims USING (symbol)), z AS (SELECT symbol, industry, close / avg(close) OVER (PARTITION BY industry) AS r FROM q) SELECT symbol, industry, round(r, 6) AS ratio, CASE WHEN r < 0.7 THEN 'cheap' WHEN r > 1.3 THEN 'dear' ELSE 'fair' END AS level FROM z")
def p23(spark, d):
    return states.valuation(m.monthly_bars(spark, d), m.industries(spark, d))


@query("p31_adaptive_kelly", f"WITH {MONTHLY}, {RETURNS}, y AS (SELECT *, close / max(close) {ALL} - 1 AS dd FROM r), q AS (SELECT symbol, count(*) AS n, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS p, coalesce(avg(CASE WHEN ret > 0 THEN ret END) / nullif(avg(CASE WHEN ret < 0 THEN -ret END), 0), 2.0) AS b, stddev_pop(ret) AS v, abs(min(dd)) AS d FROM y WHERE logret IS NOT NULL GROUP BY 1) SELECT symbol, round(greatest(0.05, least(0.5, (p - coalesce((1 - p) / nullif(b, 0), 0.0)) / 2 / (1 + v) / (1 + 2 * d) * least(1.0, n / 60.0::DOUBLE))), 6) AS kelly, CASE WHEN n >= 60 THEN 'high' WHEN n >= 30 THEN 'medium' ELSE 'low' END AS confidence FROM q")
def p31(spark, d):
    return states.adaptive_kelly(m.monthly_bars(spark, d))


@query("p34_atr_stops", RECURSIVE.format(bars=_DIFFS, source="c2", first="close, tr / 14 AS a", step=f"b.close, {wilder_sql(14, 'a', 'b.tr', 0)}") + ", g AS (SELECT symbol, ts, close, CASE WHEN rn - 1 >= 13 THEN a ELSE close * 0.02 END AS a FROM f), h AS (SELECT *, (CASE WHEN a / close > 0.5 THEN 3.0 WHEN a / close > 0.2 THEN 2.5 ELSE 2.0 END)::DOUBLE AS k FROM g) SELECT symbol, ts, round(close - a * k + 1e-9, 2) AS stop, round(close + a * k * 1.5 + 1e-9, 2) AS target, k AS multiplier FROM h")
def p34(spark, d):
    b = m.weekly_bars(spark, d)
    out = rules.stop_levels(b.join(fold.atr_wilder(b), ["symbol", "ts"]))
    return out.select("symbol", "ts", F.round(F.col("stop") + 1e-9, 2).alias("stop"), F.round(F.col("target") + 1e-9, 2).alias("target"), "multiplier")


@query("a13_smoothed_state", f"WITH {MONTHLY}, {RETURNS}, q AS (SELECT symbol, ts, CASE WHEN ret > 0 THEN 'up' ELSE 'down' END AS state FROM r), z AS (SELECT *, count(*) FILTER (WHERE state = 'up') {over(5)} AS u, count(*) FILTER (WHERE state = 'down') {over(5)} AS n FROM q) SELECT symbol, ts, state, CASE WHEN n >= 3 THEN 'down' WHEN u >= 3 THEN 'up' ELSE state END AS smoothed FROM z")
def a13(spark, d):
    r = returns(m.monthly_bars(spark, d)).select("symbol", "ts", F.when(F.col("ret") > 0, "up").otherwise("down").alias("state"))
    return states.mode_of_last(r)


@query("x03_rolling_ic", f"WITH {MONTHLY}, {PANEL}, {IC.format(source='p')}, q AS (SELECT ts, avg(ic) OVER w AS a, stddev_pop(ic) OVER w AS s FROM ic WINDOW w AS (ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)) SELECT ts, round(a, 6) AS mean, round(coalesce(a / nullif(s, 0), 0.0), 6) AS icir FROM q")
def x03(spark, d):
    return states.rolling_ic(x.ic(x.panel(m.monthly_bars(spark, d))))


@query("x31_factor_decay", f"WITH {MONTHLY}, {PANEL}, {IC.format(source='p')}, h AS (SELECT ic, ntile(2) OVER (ORDER BY ts) AS half FROM ic), q AS (SELECT avg(CASE WHEN half = 1 THEN ic END) AS e, avg(CASE WHEN half = 2 THEN ic END) AS l FROM h) SELECT 'momentum' AS factor, round(e, 6) AS early, round(l, 6) AS late, abs(l) < 0.5 * abs(e) AS decaying FROM q")
def x31(spark, d):
    return states.decaying(x.ic(x.panel(m.monthly_bars(spark, d))).withColumn("factor", F.lit("momentum")))


@query("x10_selected_horizons", f"WITH {MONTHLY}, {DECAY} SELECT h, round(ic, 6) AS ic FROM f WHERE abs(ic) >= 0.03")
def x10(spark, d):
    return x.ic_decay(m.monthly_bars(spark, d)).filter(F.abs("ic") >= 0.03).select("h", F.round("ic", 6).alias("ic"))


@query("l02_top_and_bottom", f"WITH {MONTHLY}, {PANEL}, q AS (SELECT ts, symbol, row_number() OVER (PARTITION BY ts ORDER BY x DESC, symbol) AS t, row_number() OVER (PARTITION BY ts ORDER BY x, symbol) AS b FROM p) SELECT ts, symbol, CASE WHEN t <= 3 THEN 'top' ELSE 'bottom' END AS side FROM q WHERE t <= 3 OR b <= 3")
def l02(spark, d):
    return states.extremes(x.panel(m.monthly_bars(spark, d)).select("ts", "symbol", "x"))


_MOVE = "f.weight + greatest(-0.2::DOUBLE, least(0.2::DOUBLE, CASE WHEN b.back > 0 THEN 1.0::DOUBLE WHEN b.back < 0 THEN 0.0::DOUBLE ELSE f.weight END - f.weight))"
_REWARD = f"(f.weight * b.ret - 0.001::DOUBLE * abs({_MOVE} - f.weight))"


@query("b14_environment", RECURSIVE.format(bars=f"{WEEKLY}, {RETURNS}, e AS (SELECT * EXCLUDE rn, coalesce(lag(ret) {W}, 0.0) AS back FROM r)", source="e", first="0.0::DOUBLE AS weight, 0.0::DOUBLE AS reward, 1.0::DOUBLE AS value", step=f"{_MOVE}, {_REWARD}, f.value * (1 + {_REWARD})") + " SELECT symbol, ts, round(weight + 1e-9, 6) AS weight, round(reward + 1e-9, 6) AS reward, round(value + 1e-9, 6) AS value FROM f")
def b14(spark, d):
    return states.environment(m.weekly_bars(spark, d)).select("symbol", "ts", *(F.round(F.col(c) + 1e-9, 6).alias(c) for c in ("weight", "reward", "value")))
