"""Queries of rule tables: each bar of a snapshot through ladders, signals, scores and sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.operators import fold, ladders, portfolio
from tapeloom.operators.snapshot import snapshot
from tapeloom.operators.steps import Rules
from tapeloom.operators.timeseries import W as BY_SYMBOL
from tapeloom.operators.timeseries import divergence, last, returns, rsi_winners
from tapeloom.plans.panels import _METRICS
from tapeloom.plans.registry import ALL, DIMS, MONTHLY, RETURNS, WEEKLY, W, over, prior, query
from tapeloom.plans.series import _DIFFS, _MACD, RECURSIVE, wilder_sql
from tapeloom.sources import market as m

_GAIN, _LOSS = "CASE WHEN diff > 0 THEN diff END", "CASE WHEN diff < 0 THEN -diff END"


def _winners(k: int) -> str:
    loss = f"coalesce(avg({_LOSS}) {over(k)}, 0.001)"
    return f"CASE WHEN count(diff) {over(k)} >= {k} THEN CASE WHEN {loss} > 0 THEN 100 - 100 / (1 + coalesce(avg({_GAIN}) {over(k)}, 0.0) / {loss}) ELSE 100.0 END ELSE 50.0 END::DOUBLE"


def _cutler(k: int) -> str:
    gain, loss = (f"avg(CASE WHEN diff IS NOT NULL THEN greatest({s}diff, 0.0) END) {over(k)}" for s in ("", "-"))
    return f"CASE WHEN count(diff) {over(k)} >= {k} THEN CASE WHEN {loss} > 0 THEN 100 - 100 / (1 + {gain} / {loss}) ELSE 100.0 END ELSE 50.0 END::DOUBLE"


SNAP = f"""{MONTHLY}, {RETURNS}, tr AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) {W}), 0.0), coalesce(abs(low - lag(close) {W}), 0.0)) AS tr FROM r),
snap AS (SELECT symbol, ts, rn, open, high, low, close, volume, amount, outer_vol, volume - outer_vol AS inner_vol, ret, logret, diff, tr, lag(close) {W} AS prev, ret * 100 AS change, volume / avg(volume) {ALL} * 100 AS turnover,
max(close) {over(12)} AS year_high, min(close) {over(12)} AS year_low, {", ".join(f"avg(close) {over(k)} AS ma{k}" for k in (5, 10, 20, 60))}, avg(volume) {over(20)} AS mean_volume, avg(volume) {over(5)} AS volume5, stddev_pop(close) {over(20)} AS sd,
coalesce(stddev_pop(logret) {over(20)}, 0.0) * sqrt(12.0::DOUBLE) AS vol, avg(tr) {over(14)} AS atr, {_winners(14)} AS rsi, {", ".join(f"{_cutler(k)} AS rsi{k}" for k in (6, 14, 25, 60))},
coalesce(close / lag(close, 5) {W} - 1, 0.0) AS mom5, coalesce(close / lag(close, 20) {W} - 1, 0.0) AS mom20, max(close) {prior(20)} AS hi20, min(close) {prior(20)} AS lo20, avg(ret) {over(20)} AS ret_mean,
coalesce(stddev_pop(CASE WHEN ret < 0 THEN ret END) {over(20)}, 0.0) AS down, coalesce(stddev_pop(ret) {over(20)}, 0.0) AS ret_sd, coalesce(volume / nullif(avg(volume) {prior(20)}, 0), 1.0) AS vol_ratio FROM tr)"""

#: A position that is held from a symbol's first bar on.
HELD = f"held AS (SELECT *, first_value(close) {ALL} AS cost, date_diff('day', first_value(ts) {ALL}, ts) AS held, max(close) {ALL} AS peak FROM snap)"
FUNDAMENTALS = "fund AS (SELECT l_suppkey AS symbol, sum(l_extendedprice * (1 - l_discount) * (1 - l_tax)) / 1e5 AS earnings FROM lineitem GROUP BY 1), pes AS (SELECT symbol, industry, cap / nullif(earnings, 0) * 10 AS pe FROM dims JOIN fund USING (symbol)), val AS (SELECT *, avg(pe) OVER (PARTITION BY industry) AS industry_pe FROM pes)"


def snap(spark: SparkSession, d: str) -> DataFrame:
    return snapshot(m.monthly_bars(spark, d))


def held(spark: SparkSession, d: str) -> DataFrame:
    so_far = BY_SYMBOL().rowsBetween(Window.unboundedPreceding, 0)
    return snap(spark, d).withColumns({"cost": F.first("close").over(so_far), "held": F.datediff("ts", F.first("ts").over(so_far)).cast("long"), "peak": F.max("close").over(so_far)})


def valued(spark: SparkSession, d: str) -> DataFrame:
    """symbol, industry, pe and the industry's mean pe; suppliers are a dimension."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 - F.col("l_tax"))
    fund = m.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg((F.sum(price) / 1e5).alias("earnings"))
    pes = m.industries(spark, d).join(fund, "symbol").select("symbol", "industry", (F.try_divide("cap", "earnings") * 10).alias("pe"))
    return pes.join(pes.groupBy("industry").agg(F.avg("pe").alias("industry_pe")), "industry")


def _with_value(spark: SparkSession, d: str) -> DataFrame:
    return snap(spark, d).join(valued(spark, d), "symbol")


_VALUED = f"{SNAP}, {DIMS}, {FUNDAMENTALS}, vs AS (SELECT * FROM snap JOIN val USING (symbol))"


def register(name: str, with_sql: str, source: str, rows, rule: Rules, *keys: str) -> None:
    keys = keys or ("symbol", "ts")
    query(name, f"WITH {with_sql} " + rule.sql(source, *keys))(lambda spark, d: rule.apply(rows(spark, d), *keys))


for _name, _rule in {
    "p01_p03_guards": ladders.GUARDED, "p06_volume_bands": ladders.VOLUME_BANDS, "p07_price_position": ladders.PRICE_POSITION, "p08_rsi_sentiment": ladders.SENTIMENT, "p10_kline_signal": ladders.KLINE, "p12_bollinger_rules": ladders.BOLLINGER_RULES,
    "p14_rsi_state": ladders.RSI_STATE, "w25_multi_rsi": ladders.MULTI_RSI, "p16_state_ladders": ladders.MARKET_STATE, "p17_entry_rules": ladders.ENTRY_SIGNALS, "p21_composite": ladders.COMPOSITE, "p25_technical_snapshot": ladders.TECHNICAL, "p27_scenarios": ladders.SCENARIOS,
    "p28_quant_signals": ladders.QUANT, "p29_rule_engine": ladders.RULE_ENGINE, "p32_kelly_cvar": ladders.KELLY_CVAR, "p40_volatility_regime": ladders.REGIME, "w42_widths": ladders.WIDTHS, "w43_snapshot_ratios": ladders.RATIOS, "w44_features": ladders.ALL_FEATURES,
    "w53_technical_mood": ladders.TECHNICAL_MOOD, "c05_c06_implied_volatility": ladders.IMPLIED, "c18_default_strategy": ladders.STRATEGY, "c25_cross_modal": ladders.MODAL,
}.items():
    register(_name, SNAP, "snap", snap, _rule)
for _name, _rule in {"p18_exit_rules": ladders.EXIT_SIGNALS, "p19_recommendation": ladders.RECOMMENDATION, "p20_time_stop": ladders.TIME_STOP, "p35_trailing_decay": ladders.TRAILING}.items():
    register(_name, f"{SNAP}, {HELD}", "held", held, _rule)
for _name, _rule in {"p23_sector_rating": ladders.SECTOR, "p26_fundamental_level": ladders.FUNDAMENTAL}.items():
    register(_name, _VALUED, "vs", _with_value, _rule)

register("p15_dynamic_rsi", f"{SNAP}, b5 AS (SELECT *, lag(rsi14, 5) {W} AS back5 FROM snap)", "b5", lambda s, d: snap(s, d).withColumn("back5", F.lag("rsi14", 5).over(BY_SYMBOL())), ladders.DYNAMIC_RSI)


@query("w26_rsi_momentum", f"WITH {SNAP}, x AS (SELECT symbol, ts, rn, rsi14, lag(rsi14, 5) {W} AS back5, avg(rsi14) {over(14)} AS now, avg(rsi14) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 27 PRECEDING AND 14 PRECEDING) AS before FROM snap) SELECT symbol, ts, round(coalesce(rsi14 - back5, 0.0) + 1e-9, 5) AS speed, round(coalesce((now - before) / 14, 0.0) + 1e-9, 5) AS slope FROM x")
def w26(spark, d):
    now, then = F.avg("rsi14").over(last(14)), F.avg("rsi14").over(BY_SYMBOL().rowsBetween(-27, -14))
    return snap(spark, d).select("symbol", "ts", F.round(F.coalesce(F.col("rsi14") - F.lag("rsi14", 5).over(BY_SYMBOL()), F.lit(0.0)) + 1e-9, 5).alias("speed"), F.round(F.coalesce((now - then) / 14, F.lit(0.0)) + 1e-9, 5).alias("slope"))


_CYCLES = ("day", "week", "month")


def _cycle_sql(unit: str) -> str:
    return f"""b_{unit} AS (SELECT o_orderpriority AS symbol, date_trunc('{unit}', o_orderdate) AS ts, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS close FROM orders GROUP BY 1, 2), r_{unit} AS (SELECT *, close - lag(close) {W} AS diff FROM b_{unit}),
k_{unit} AS (SELECT symbol, arg_max({unit}, ts) AS {unit} FROM (SELECT symbol, ts, {_winners(14)} AS {unit} FROM r_{unit}) GROUP BY 1)"""


def cycles(spark: SparkSession, d: str) -> DataFrame:
    """The latest strength of each symbol by day, week and month."""
    out = None
    orders = m.table(spark, d, "orders")
    for unit in _CYCLES:
        bars = orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.date_trunc(unit, "o_orderdate").alias("ts")).agg(F.max_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("close"))
        one = returns(bars).select("symbol", "ts", rsi_winners(14).alias("rsi")).groupBy("symbol").agg(F.max_by("rsi", "ts").alias(unit))
        out = one if out is None else out.join(one, "symbol")
    return out


register("p09_resonance", ", ".join(_cycle_sql(u) for u in _CYCLES) + ", cycles AS (SELECT symbol, day, week, month FROM k_day JOIN k_week USING (symbol) JOIN k_month USING (symbol))", "cycles", cycles, ladders.RESONANCE, "symbol")


def macd_snapshot(spark: SparkSession, d: str) -> DataFrame:
    b = m.weekly_bars(spark, d)
    back = F.lag("hist").over(BY_SYMBOL())
    out = fold.macd(b).join(b.select("symbol", "ts", "close"), ["symbol", "ts"]).withColumn("ind", F.col("hist"))
    return out.withColumns({"crossed": F.when((back <= 0) & (F.col("hist") > 0), "golden").when((back >= 0) & (F.col("hist") < 0), "death").otherwise("none"), "diverges": divergence(20)})


_MACD_SNAP = _MACD + f""", h AS (SELECT f.symbol, f.ts, bars.close, fast - slow AS dif, dea, fast - slow - dea AS hist FROM f JOIN bars ON f.symbol = bars.symbol AND f.ts = bars.ts), l AS (SELECT *, lag(hist) {W} AS back, """ + ", ".join(f"{fn}({c}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {a} PRECEDING AND {z}) AS {n}" for n, fn, c, a, z in (("ch", "max", "close", 19, "CURRENT ROW"), ("cl", "min", "close", 19, "CURRENT ROW"), ("ih", "max", "hist", 19, "CURRENT ROW"), ("il", "min", "hist", 19, "CURRENT ROW"), ("pch", "max", "close", 39, "20 PRECEDING"), ("pcl", "min", "close", 39, "20 PRECEDING"), ("pih", "max", "hist", 39, "20 PRECEDING"), ("pil", "min", "hist", 39, "20 PRECEDING"), ("k", "count", "hist", 39, "20 PRECEDING"))) + """ FROM h),
ms AS (SELECT *, CASE WHEN back <= 0 AND hist > 0 THEN 'golden' WHEN back >= 0 AND hist < 0 THEN 'death' ELSE 'none' END AS crossed, CASE WHEN k >= 20 AND ch > pch AND ih < pih THEN 'bearish' WHEN k >= 20 AND cl < pcl AND il > pil THEN 'bullish' ELSE 'none' END AS diverges FROM l)"""
query("p11_macd_rules", f"{_MACD_SNAP} " + ladders.MACD_RULES.sql("ms", "symbol", "ts"))(lambda spark, d: ladders.MACD_RULES.apply(macd_snapshot(spark, d), "symbol", "ts"))

_ADX = RECURSIVE.format(bars=_DIFFS, source="c2", first="0.0::DOUBLE AS tr, 0.0::DOUBLE AS plus, 0.0::DOUBLE AS minus", step=", ".join(wilder_sql(14, x, f"b.{x}", 1) for x in ("tr", "plus", "minus"))) + f", g AS (SELECT *, coalesce(plus * 100 / nullif(tr, 0), 50.0) AS plus_di, coalesce(minus * 100 / nullif(tr, 0), 50.0) AS minus_di FROM f), h AS (SELECT *, coalesce(100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0), 0.0) AS dx FROM g), ax AS (SELECT symbol, ts, plus_di, minus_di, avg(CASE WHEN rn - 1 >= 14 THEN dx END) {over(14)} AS adx FROM h)"
query("p43_adx_factor", f"{_ADX} " + ladders.ADX_FACTOR.sql("ax", "symbol", "ts"))(lambda spark, d: ladders.ADX_FACTOR.apply(fold.adx(m.weekly_bars(spark, d)), "symbol", "ts"))

_ORDERS = "o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'sell' ELSE 'buy' END AS side, o_totalprice AS value, floor(o_totalprice / 10) AS shares, 1e6::DOUBLE AS adv FROM orders)"
register("p37_p38_cost_variants", _ORDERS, "o", lambda s, d: m.table(s, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "sell").otherwise("buy").alias("side"), F.col("o_totalprice").alias("value"), F.floor(F.col("o_totalprice") / 10).cast("double").alias("shares"), F.lit(1e6).alias("adv")), ladders.COST_VARIANTS, "o_orderkey", "side")
register("p45_verdict", f"{MONTHLY}, {RETURNS}, {_METRICS}, v AS (SELECT symbol, round(annual, 5) AS annual, round(worst, 5) AS max_dd, round(coalesce((annual - 0.02) / nullif(vol, 0), 0.0), 5) AS sharpe, round(win, 5) AS win_rate FROM z)", "v", lambda s, d: portfolio.metrics(m.monthly_bars(s, d)), ladders.VERDICT, "symbol")
register("w54_volatility_trend", f"{SNAP}, t AS (SELECT symbol, ts, rn, avg(vol) {over(5)} AS recent, avg(vol) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING) AS earlier FROM snap)", "(SELECT * FROM t WHERE rn >= 20)", lambda s, d: snap(s, d).withColumns({"recent": F.avg("vol").over(last(5)), "earlier": F.avg("vol").over(BY_SYMBOL().rowsBetween(-19, -5))}).filter("rn >= 20"), ladders.TREND_OF_VOL)


@query("w55_metric_trend", f"WITH {SNAP}, q AS (SELECT symbol, ret, rn, count(*) OVER (PARTITION BY symbol) AS n FROM snap), z AS (SELECT symbol, n, avg(CASE WHEN rn <= 10 THEN ret END) AS early, avg(CASE WHEN rn > n - 10 THEN ret END) AS late, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS hits FROM q GROUP BY 1, 2) SELECT symbol, round(early + 1e-9, 6) AS early, round(late + 1e-9, 6) AS late, CASE WHEN n < 20 THEN 'short' WHEN late > early + 0.05 THEN 'improving' WHEN late < early - 0.05 THEN 'declining' ELSE 'stable' END AS trend, CASE WHEN hits > 0.55 THEN 'healthy' WHEN hits > 0.45 THEN 'watch' ELSE 'unhealthy' END AS health FROM z")
def w55(spark, d):
    q = snap(spark, d).select("symbol", "ret", "rn", F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    z = q.groupBy("symbol", "n").agg(F.avg(F.when(F.col("rn") <= 10, F.col("ret"))).alias("early"), F.avg(F.when(F.col("rn") > F.col("n") - 10, F.col("ret"))).alias("late"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("hits"))
    trend = F.when(F.col("n") < 20, "short").when(F.col("late") > F.col("early") + 0.05, "improving").when(F.col("late") < F.col("early") - 0.05, "declining").otherwise("stable")
    return z.select("symbol", F.round(F.col("early") + 1e-9, 6).alias("early"), F.round(F.col("late") + 1e-9, 6).alias("late"), trend.alias("trend"), F.when(F.col("hits") > 0.55, "healthy").when(F.col("hits") > 0.45, "watch").otherwise("unhealthy").alias("health"))


@query("w47_expanding", f"WITH {SNAP} SELECT symbol, ts, round(avg(close) {ALL} + 1e-9, 5) AS mean, round(stddev_pop(close) {ALL} + 1e-9, 5) AS std, round(min(close) {ALL} + 1e-9, 5) AS low, round(max(close) {ALL} + 1e-9, 5) AS high, count(*) {ALL} AS n FROM snap")
def w47(spark, d):
    f = BY_SYMBOL().rowsBetween(Window.unboundedPreceding, 0)
    c = "close"
    return m.monthly_bars(spark, d).select("symbol", "ts", *(F.round(v.over(f) + 1e-9, 5).alias(k) for k, v in (("mean", F.avg(c)), ("std", F.stddev_pop(c)), ("low", F.min(c)), ("high", F.max(c)))), F.count("*").over(f).alias("n"))


@query("w50_sequences", f"WITH {SNAP}, q AS (SELECT symbol, ts, list(round(close + 1e-9, 4)) {over(20)} AS closes, list(round(volume + 1e-9, 4)) {over(20)} AS volumes, count(*) {over(20)} AS n FROM snap) SELECT symbol, ts, array_to_string(list_transform(closes, lambda x: cast(cast(floor(x) AS BIGINT) AS VARCHAR)), ',') AS closes, array_to_string(list_transform(volumes, lambda x: cast(cast(floor(x) AS BIGINT) AS VARCHAR)), ',') AS volumes FROM q WHERE n >= 20")
def w50(spark, d):
    """Windows of the last 20 bars as sequences, one array for each field."""
    said = lambda c: F.array_join(F.transform(F.collect_list(F.round(F.col(c) + 1e-9, 4)).over(last(20)), lambda x: F.floor(x).cast("string")), ",")
    q = m.monthly_bars(spark, d).select("symbol", "ts", said("close").alias("closes"), said("volume").alias("volumes"), F.count("*").over(last(20)).alias("n"))
    return q.filter("n >= 20").select("symbol", "ts", "closes", "volumes")


@query("w36_downside_score", f"WITH {SNAP}, q AS (SELECT symbol, ts, coalesce(down / nullif(ret_sd, 0), 0.0) AS r, down FROM snap) SELECT symbol, ts, round(r + 1e-9, 6) AS ratio, round(greatest(0.0, least(10.0, 10 - down * 10)) + 1e-9, 5) AS score FROM q")
def w36(spark, d):
    return snap(spark, d).select("symbol", "ts", F.round(F.coalesce(F.try_divide("down", "ret_sd"), F.lit(0.0)) + 1e-9, 6).alias("ratio"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(10.0), 10 - F.col("down") * 10)) + 1e-9, 5).alias("score"))


@query("c04_one_step_adx", f"WITH {MONTHLY}, q AS (SELECT symbol, ts, high - lag(high) {W} AS up, lag(low) {W} - low AS down FROM bars), z AS (SELECT symbol, ts, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS p, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS n FROM q) SELECT symbol, ts, round(coalesce(100 * p / nullif(p + n, 0), 0.0) + 1e-9, 4) AS plus_di, round(coalesce(100 * n / nullif(p + n, 0), 0.0) + 1e-9, 4) AS minus_di, round(coalesce(100 * abs(p - n) / nullif(p + n, 0), 0.0) + 1e-9, 4) AS dx FROM z")
def c04(spark, d):
    up, down = F.col("high") - F.lag("high").over(BY_SYMBOL()), F.lag("low").over(BY_SYMBOL()) - F.col("low")
    b = m.monthly_bars(spark, d).select("symbol", "ts", F.when((up > down) & (up > 0), up).otherwise(0.0).alias("p"), F.when((down > up) & (down > 0), down).otherwise(0.0).alias("n"))
    part = lambda x: F.round(F.coalesce(F.try_divide(100 * x, F.col("p") + F.col("n")), F.lit(0.0)) + 1e-9, 4)
    return b.select("symbol", "ts", part(F.col("p")).alias("plus_di"), part(F.col("n")).alias("minus_di"), part(F.abs(F.col("p") - F.col("n"))).alias("dx"))


for _name, _rule in {"c31_flow_split": ladders.FLOW_SPLIT, "c29_classes": ladders.CLASSES, "m05_m06_ensemble": ladders.ENSEMBLE, "c07_m07_regime_vector": ladders.REGIME_VECTOR}.items():
    register(_name, SNAP, "snap", snap, _rule)
register("c15_c17_marked_positions", f"{SNAP}, {HELD}", "held", held, ladders.MARKED)

_GARCH = RECURSIVE.format(bars=f"{WEEKLY}, c AS (SELECT *, coalesce(ln(close / lag(close) {W}), 0.0) AS r FROM bars)", source="c", first="(1e-6::DOUBLE / (1 - 0.05::DOUBLE - 0.94::DOUBLE)) AS v, r", step="1e-6::DOUBLE + 0.05::DOUBLE * f.r * f.r + 0.94::DOUBLE * f.v, b.r") + ", gs AS (SELECT symbol, ts, v AS variance, rn AS place FROM f)"
query("c03_garch_state", f"{_GARCH} " + ladders.GARCH_STATE.sql("gs", "symbol", "ts"))(lambda spark, d: ladders.GARCH_STATE.apply(fold.garch(m.weekly_bars(spark, d)).withColumn("place", F.row_number().over(BY_SYMBOL())), "symbol", "ts"))


@query("c08_regime_shares", f"WITH {SNAP}, q AS ({ladders.REGIME_VECTOR.sql('snap', 'symbol', 'ts')}) SELECT ts, regime, count(*) AS symbols, round(count(*) / sum(count(*)) OVER (PARTITION BY ts), 6) AS share FROM q GROUP BY 1, 2")
def c08(spark, d):
    q = ladders.REGIME_VECTOR.apply(snap(spark, d), "symbol", "ts").groupBy("ts", "regime").agg(F.count("*").alias("symbols"))
    return q.withColumn("share", F.round(F.col("symbols") / F.sum("symbols").over(Window.partitionBy("ts")), 6))
