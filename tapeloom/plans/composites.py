"""Queries of composites: readings made of several operators, the event engine and the purse by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import composites, drift, fold
from tapeloom.operators.steps import doubles
from tapeloom.operators.timeseries import W as BY_SYMBOL
from tapeloom.plans.engines import orders, windows_sql
from tapeloom.plans.ladders import FUNDAMENTALS, HELD, SNAP, held, register, snap, valued
from tapeloom.plans.registry import ALL, DIMS, W, over, query
from tapeloom.plans.series import _DIFFS, RECURSIVE, rounded, wilder_sql
from tapeloom.sources import market as m

register("p02_history_guards", SNAP, "snap", snap, composites.GUARDS)

_SMOOTH = f"{wilder_sql(14, 'gain', 'greatest(b.d, 0.0)', 1)}, {wilder_sql(14, 'loss', 'greatest(-b.d, 0.0)', 1)}"
_WILDER = "CASE WHEN f.rn - 1 < 14 THEN 50.0 WHEN f.loss > 0 THEN 100 - 100 / (1 + f.gain / f.loss) ELSE 100.0 END"


def with_strength(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    out = rows.join(fold.rsi_wilder(m.monthly_bars(spark, d)).withColumnRenamed("rsi", "wilder"), ["symbol", "ts"])
    return out.withColumn("wilder5", F.lag("wilder", 5).over(BY_SYMBOL()))


_STRENGTH = RECURSIVE.format(bars=f"{SNAP}, c AS (SELECT symbol, ts, coalesce(diff, 0.0) AS d FROM snap)", source="c", first="0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss", step=_SMOOTH) + f", wr AS (SELECT f.symbol, f.ts, {_WILDER} AS wilder FROM f), wl AS (SELECT *, lag(wilder, 5) {W} AS wilder5 FROM wr), ws AS (SELECT * FROM snap JOIN wl USING (symbol, ts)) "
query("c02_strength_analysis", _STRENGTH + composites.STRENGTH.sql("ws", "symbol", "ts"))(lambda spark, d: composites.STRENGTH.apply(with_strength(spark, d, snap(spark, d)), "symbol", "ts"))


def holdings(spark: SparkSession, d: str) -> DataFrame:
    variance = fold.garch(m.monthly_bars(spark, d)).select("symbol", "ts", "variance")
    return with_strength(spark, d, held(spark, d)).join(valued(spark, d).select("symbol", "pe", "industry_pe"), "symbol").join(variance, ["symbol", "ts"])


_HOLDING = RECURSIVE.format(bars=f"{SNAP}, {HELD}, {DIMS}, {FUNDAMENTALS}, c AS (SELECT symbol, ts, coalesce(diff, 0.0) AS d, coalesce(logret, 0.0) AS r FROM snap)", source="c", first="0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss, (1e-6::DOUBLE / (1 - 0.05::DOUBLE - 0.94::DOUBLE)) AS v, r", step=f"{_SMOOTH}, 1e-6::DOUBLE + 0.05::DOUBLE * f.r * f.r + 0.94::DOUBLE * f.v, b.r") + f", wr AS (SELECT f.symbol, f.ts, f.v AS variance, {_WILDER} AS wilder FROM f), wl AS (SELECT *, lag(wilder, 5) {W} AS wilder5 FROM wr), hv AS (SELECT held.*, val.pe, val.industry_pe, wl.variance, wl.wilder, wl.wilder5 FROM held JOIN val ON held.symbol = val.symbol JOIN wl ON held.symbol = wl.symbol AND held.ts = wl.ts) "
query("c21_holding_analysis", _HOLDING + composites.HOLDING.sql("hv", "symbol", "ts"))(lambda spark, d: composites.HOLDING.apply(holdings(spark, d), "symbol", "ts"))

_FAST, _SLOW = "(f.ema12 + (b.close - f.ema12) * (2.0::DOUBLE / 13))", "(f.ema26 + (b.close - f.ema26) * (2.0::DOUBLE / 27))"


@query("c30_technical_features", RECURSIVE.format(bars=_DIFFS, source="c2", first="close AS ema12, close AS ema26, 0.0::DOUBLE AS signal, 0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss, close", step=f"{_FAST}, {_SLOW}, f.signal + ({_FAST} - {_SLOW} - f.signal) * (2.0::DOUBLE / 10), {_SMOOTH}, b.close") + f", g AS (SELECT *, ema12 - ema26 AS macd, 100 - 100 / (1 + gain / (loss + 1e-10)) AS rsi, avg(close) {over(20)} AS middle, stddev_samp(close) {over(20)} AS sd FROM f) SELECT symbol, ts, round(ema12 + 1e-9, 4) AS ema12, round(ema26 + 1e-9, 4) AS ema26, round(macd + 1e-9, 4) AS macd, round(signal + 1e-9, 4) AS signal, round(macd - signal + 1e-9, 4) AS histogram, round(rsi + 1e-9, 4) AS rsi, round(middle + 2 * sd + 1e-9, 4) AS upper, round(middle + 1e-9, 4) AS middle, round(middle - 2 * sd + 1e-9, 4) AS lower FROM g WHERE rn >= 20")
def c30(spark, d):
    return rounded(composites.technical_features(m.weekly_bars(spark, d)), "symbol", "ts", digits=4)


_TRIED = " ".join(f"CROSS JOIN (SELECT unnest({values}) AS {k})" for k, values in composites.TRIED.items())
_SCORE = " + ".join(f"10 - abs({k} - {liked}) * {cost}" for k, (liked, cost) in composites.LIKED.items())


@query("c19_parameter_preference", doubles(f"WITH g AS (SELECT kelly::DOUBLE AS kelly, atr::DOUBLE AS atr, rsi::DOUBLE AS rsi, vol::DOUBLE AS vol FROM (SELECT 1 AS one) {_TRIED}), s AS (SELECT *, round({_SCORE}, 4) AS score FROM g) SELECT *, row_number() OVER (ORDER BY score DESC, kelly, atr, rsi, vol)::INTEGER AS place FROM s"))
def c19(spark, d):
    return composites.preferences(spark)


_ERRORS = f"{SNAP}, e0 AS (SELECT symbol, ts, abs(ret - lag(ret_mean) {W}) AS x FROM snap)"


@query("c10_drift_status", f"""WITH RECURSIVE {_ERRORS}, {windows_sql('e0', 'both_sides')}, o AS (SELECT symbol, max(i) AS n, max_by(i - start, i) AS size FROM f WHERE i > 0 GROUP BY 1)
SELECT o.symbol, sum(CASE WHEN f.cut > 0 THEN 1 ELSE 0 END)::BIGINT AS splits, max(o.size) AS size, round(avg(CASE WHEN p.i > n - size THEN x END), 6) AS mean, round(stddev_pop(CASE WHEN p.i > n - size THEN x END), 6) AS std,
CASE WHEN max(CASE WHEN p.i > n - size AND f.cut > 0 THEN 1 ELSE 0 END) > 0 THEN 'train_again' ELSE 'keep' END AS advice FROM o JOIN p USING (symbol) JOIN f ON f.symbol = p.symbol AND f.i = p.i WHERE p.i > 0 GROUP BY 1""")
def c10(spark, d):
    """Errors of a forecast: the mean of the last twenty returns against the next one."""
    errors = snap(spark, d).select("symbol", "ts", F.abs(F.col("ret") - F.lag("ret_mean").over(BY_SYMBOL())).alias("x"))
    return drift.status(errors).select("symbol", "splits", "size", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "advice")


def event_orders(spark: SparkSession, d: str) -> DataFrame:
    """A bar's order by its place: two buys to a sale, of each kind in turn; none on the first bar."""
    rn, some = F.col("rn"), F.col("prev").isNotNull()
    side, kind = F.when(rn % 3 == 0, "sell").otherwise("buy"), F.when(rn % 4 == 0, "limit").when(rn % 4 == 1, "stop").otherwise("market")
    return snap(spark, d).select("symbol", "ts", "open", "high", "low", "close", "volume", F.when(some, side).alias("side"), F.when(some, kind).alias("kind"), (F.col("prev") * (1 + (rn % 5 - 2) * 0.05)).alias("level"))


_NOW = "(f.cash + f.quantity * b.close)"
_PASSES = f"b.price IS NOT NULL AND (f.peak - {_NOW}) / f.peak < 0.15"
_BUYS, _SELLS = f"({_PASSES} AND b.side = 'buy' AND 10 * b.close <= {_NOW} * 0.3)", f"({_PASSES} AND b.side = 'sell' AND f.quantity > 0)"
_SOLD = "least(10.0, f.quantity)"
_CASH = f"CASE WHEN {_BUYS} THEN f.cash - 10 * b.price * 1.0003 WHEN {_SELLS} THEN f.cash + {_SOLD} * b.price * 0.9987 ELSE f.cash END"
_HAS = f"CASE WHEN {_BUYS} THEN f.quantity + 10 WHEN {_SELLS} THEN f.quantity - {_SOLD} ELSE f.quantity END"
_EQUITY = f"({_CASH} + {_HAS} * b.close)"
_FILLS = """eo AS (SELECT symbol, ts, open, high, low, close, volume, CASE WHEN prev IS NOT NULL THEN CASE WHEN rn % 3 = 0 THEN 'sell' ELSE 'buy' END END AS side, CASE WHEN prev IS NOT NULL THEN CASE WHEN rn % 4 = 0 THEN 'limit' WHEN rn % 4 = 1 THEN 'stop' ELSE 'market' END END AS kind, prev * (1 + ((rn % 5) - 2) * 0.05) AS level FROM snap),
ef AS (SELECT *, CASE WHEN volume > 0 THEN 10 / volume * 0.5 ELSE 0.0 END AS impact, CASE WHEN kind = 'market' THEN least(greatest(open * CASE WHEN side = 'buy' THEN 1.0005 ELSE 0.9995 END, low), high) WHEN kind = 'limit' AND side = 'buy' AND low <= level THEN least(level, open) WHEN kind = 'limit' AND side = 'sell' AND high >= level THEN greatest(level, open)
WHEN kind = 'stop' AND side = 'buy' AND high >= level THEN least(level * 1.01, high) WHEN kind = 'stop' AND side = 'sell' AND low <= level THEN greatest(level * 0.99, low) END AS fill FROM eo), ep AS (SELECT symbol, ts, close, side, fill * CASE WHEN side = 'buy' THEN 1 + impact ELSE greatest(0.0, 1 - impact) END AS price FROM ef)"""


@query("b07_event_equity", doubles(RECURSIVE.format(bars=f"{SNAP}, {_FILLS}", source="ep", first="100000.0 AS cash, 0.0 AS quantity, 100000.0 AS peak, 0.0 AS trades, 100000.0 AS equity", step=f"{_CASH}, {_HAS}, greatest(f.peak, {_EQUITY}), f.trades + CASE WHEN {_BUYS} OR {_SELLS} THEN 1.0 ELSE 0.0 END, {_EQUITY}")) + " SELECT symbol, ts, round(cash + 1e-9, 2) AS cash, quantity, round(equity + 1e-9, 2) AS equity, trades FROM f")
def b07(spark, d):
    out = composites.event_equity(composites.event_prices(event_orders(spark, d)))
    return out.select("symbol", "ts", F.round(F.col("cash") + 1e-9, 2).alias("cash"), "quantity", F.round(F.col("equity") + 1e-9, 2).alias("equity"), "trades")


@query("b02_walk_forward_purse")
def b02(spark, d):
    out = composites.walk_forward(orders(spark, d))
    return out.select("strategy", "ts", F.round("cash", 2).alias("cash"), F.round("value", 2).alias("value"), "trades")
