"""Queries of back-tests, drift, learning rates and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.operators import drift, engines, fold, optimise
from tapeloom.operators.timeseries import W as BY_SYMBOL
from tapeloom.operators.timeseries import last, returns, rsi_cutler
from tapeloom.plans.ladders import SNAP, _cutler, snap
from tapeloom.plans.registry import ALL, DIMS, MONTHLY, RETURNS, WEEKLY, W, over, query
from tapeloom.plans.series import RECURSIVE
from tapeloom.sources import market as m

_FAST, _SLOW = "(f.fast + (b.close - f.fast) * (2.0::DOUBLE / 13))", "(f.slow + (b.close - f.slow) * (2.0::DOUBLE / 27))"
_DEA = f"(f.dea + ({_FAST} - {_SLOW} - f.dea) * (2.0::DOUBLE / 10))"
_HIST = f"({_FAST} - {_SLOW} - {_DEA})"
_GAIN = "(b.close / nullif(f.entry, 0) - 1)"
_LEAVE = f"(f.entry > 0 AND ({_GAIN} < -0.05 OR {_GAIN} > 0.15 OR (b.rsi > 60 AND {_HIST} < 0)))"
_ENTER = f"(f.entry <= 0 AND b.close > b.mean AND b.rsi < 45 AND {_HIST} > 0)"


@query("b08_c18_rsi_macd_strategy", RECURSIVE.format(bars=f"{WEEKLY}, {RETURNS}, c AS (SELECT symbol, ts, close, {_cutler(14)} AS rsi, avg(close) {over(20)} AS mean FROM r)", source="c", first="close AS fast, close AS slow, 0.0::DOUBLE AS dea, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS pnl, 0.0::DOUBLE AS trades, 0.0::DOUBLE AS wins", step=f"{_FAST}, {_SLOW}, {_DEA}, CASE WHEN {_LEAVE} THEN 0.0 WHEN {_ENTER} THEN b.close ELSE f.entry END, f.pnl + CASE WHEN {_LEAVE} THEN {_GAIN} ELSE 0.0 END, f.trades + CASE WHEN {_LEAVE} THEN 1.0 ELSE 0.0 END, f.wins + CASE WHEN {_LEAVE} AND {_GAIN} > 0 THEN 1.0 ELSE 0.0 END") + " SELECT symbol, ts, round(entry + 1e-9, 4) AS entry, round(pnl + 1e-9, 5) AS pnl, trades, wins FROM f")
def b08(spark, d):
    b = m.weekly_bars(spark, d)
    rows = returns(b).select("symbol", "ts", "close", rsi_cutler(14).alias("rsi"), F.avg("close").over(last(20)).alias("mean")).join(fold.macd(b).select("symbol", "ts", "hist"), ["symbol", "ts"])
    return engines.strategy(rows).select("symbol", "ts", F.round(F.col("entry") + 1e-9, 4).alias("entry"), F.round(F.col("pnl") + 1e-9, 5).alias("pnl"), "trades", "wins")


_ON = ", ".join(f"CASE WHEN avg(close) {over(k)} > avg(close) {over(10)} THEN 1.0 ELSE 0.0 END AS on_{k}" for k in engines.SHORT)
_GRID = f"{MONTHLY}, {RETURNS}, g0 AS (SELECT symbol, ts, ret, rn, {_ON} FROM r), g1 AS (SELECT symbol, ts, ret, rn, " + ", ".join(f"coalesce(lag(on_{k}) {W}, 0.0) AS on_{k}" for k in engines.SHORT) + " FROM g0), gr AS (" + " UNION ALL ".join(f"SELECT symbol, ts, rn, {k} AS short, on_{k} * ret AS gain FROM g1" for k in engines.SHORT) + ")"
_SENSE = "SELECT symbol, short, exp(sum(ln(1 + gain))) - 1 AS total, avg(gain) AS mean, coalesce(avg(gain) / nullif(stddev_pop(gain), 0), 0.0) AS sharpe FROM gr"


@query("b04_b06_parameter_grid", f"WITH {_GRID}, s AS ({_SENSE} GROUP BY 1, 2) SELECT symbol, short, round(total, 5) AS total, round(mean, 6) AS mean, round(sharpe, 5) AS sharpe FROM s")
def b04(spark, d):
    s = engines.sensitivity(engines.grid(m.monthly_bars(spark, d)))
    return s.select("symbol", "short", F.round("total", 5).alias("total"), F.round("mean", 6).alias("mean"), F.round("sharpe", 5).alias("sharpe"))


@query("b05_walk_forward_grid", f"WITH {_GRID}, s AS ({_SENSE} WHERE rn <= 40 GROUP BY 1, 2), best AS (SELECT symbol, arg_max(short, row(round(sharpe, 9), -short)) AS short FROM s GROUP BY 1) SELECT gr.symbol, gr.short, count(*) AS bars, round(exp(sum(ln(1 + gain))) - 1, 5) AS after FROM gr JOIN best ON gr.symbol = best.symbol AND gr.short = best.short WHERE rn > 40 GROUP BY 1, 2")
def b05(spark, d):
    return engines.chosen(engines.grid(m.monthly_bars(spark, d))).select("symbol", "short", "bars", F.round("after", 5).alias("after"))


def _tried_sql(bars: str, settings: engines.Settings) -> str:
    """CTEs up to f: the gain of each bar of each setting."""
    lengths = sorted({k for _, _, k in settings})
    rows = ", ".join(f"({no}, {s}::DOUBLE, {t}::DOUBLE, {k})" for no, (s, t, k) in enumerate(settings))
    mean = "CASE length " + " ".join(f"WHEN {k} THEN m{k}" for k in lengths) + " END"
    keyed = f"{bars}, st AS (SELECT * FROM (VALUES {rows}) v(no, stop, take, length)), mb AS (SELECT symbol, ts, close, lag(close) {W} AS prev, {', '.join(f'avg(close) {over(k)} AS m{k}' for k in lengths)} FROM bars), tb AS MATERIALIZED (SELECT row(symbol, no) AS symbol, ts, close, prev, stop, take, {mean} AS mean FROM mb, st)"
    held, made = "f.entry > 0", "(b.close / nullif(f.entry, 0) - 1)"
    step = f"CASE WHEN {held} AND ({made} < -b.stop OR {made} > b.take OR b.close < b.mean) THEN 0.0 WHEN f.entry <= 0 AND b.close > b.mean THEN b.close ELSE f.entry END, CASE WHEN {held} THEN b.close / b.prev - 1 ELSE 0.0 END"
    return RECURSIVE.format(bars=keyed, source="tb", first="CASE WHEN close > mean THEN close ELSE 0.0 END::DOUBLE AS entry, 0.0::DOUBLE AS gain", step=step).replace(" b AS (", " b AS MATERIALIZED (")


_SUMS = ", ".join(f"sum({v}) OVER (PARTITION BY symbol ORDER BY ts) AS {k}" for k, v in (("logs", "ln(1 + gain)"), ("ones", "gain"), ("squares", "gain * gain")))
_PAST = lambda c, k: f"coalesce(lag({c}, {k}) {W}, 0.0)"
_RATIO = "CASE WHEN squares - ones * ones > 1e-14 THEN round(ones / sqrt(squares - ones * ones), 9) ELSE 0.0 END AS ratio"
_CHOSEN = "no, st.stop, st.take, st.length AS mean, round(ratio, 6) AS ratio"


def _settings(q: DataFrame, *more: str) -> DataFrame:
    return q.select("symbol", *(["window"] if "window" in q.columns else []), "run.no", "run.stop", "run.take", "run.mean", F.round("ratio", 6).alias("ratio"), *(F.round(c, 6).alias(c) for c in more))


@query("b05_rolling_walk_forward", f"{_tried_sql(WEEKLY, engines.whole_grid())}, s AS (SELECT symbol, ts, rn, {_SUMS} FROM f), q AS (SELECT symbol, rn, exp(logs - {_PAST('logs', 20)}) - 1 AS after, ({_PAST('ones', 20)} - {_PAST('ones', 80)}) / 60 AS ones, ({_PAST('squares', 20)} - {_PAST('squares', 80)}) / 60 AS squares FROM s), "
f"k AS (SELECT symbol[1] AS symbol, symbol[2] AS no, (rn - 60) // 20 - 1 AS window, after, {_RATIO} FROM q WHERE rn >= 80 AND (rn - 60) % 20 = 0) SELECT symbol, window, {_CHOSEN}, round(after, 6) AS after FROM k JOIN st USING (no) QUALIFY row_number() OVER (PARTITION BY symbol, window ORDER BY ratio DESC, no) = 1".replace("window", '"window"'))
def b05_rolling(spark, d):
    """Windows of 60 weeks choose among 27 settings, and the 20 weeks after them show what the choice brings."""
    return _settings(engines.walked(engines.tried(m.weekly_bars(spark, d), engines.whole_grid())), "after")


@query("b06_random_search", f"{_tried_sql(MONTHLY, engines.drawn())}, q AS (SELECT symbol, avg(gain) AS ones, avg(gain * gain) AS squares, exp(sum(ln(1 + gain))) - 1 AS total FROM f GROUP BY 1), k AS (SELECT symbol[1] AS symbol, symbol[2] AS no, total, {_RATIO} FROM q) SELECT symbol, {_CHOSEN}, round(total, 6) AS total FROM k JOIN st USING (no) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ratio DESC, no) = 1")
def b06_random(spark, d):
    """Twenty settings drawn by a seed, tried on all months of each symbol."""
    return _settings(engines.best_setting(engines.tried(m.monthly_bars(spark, d), engines.drawn())), "total")


_EVENT = "ev AS (SELECT symbol, ts, open, high, low, prev, CASE WHEN rn % 2 = 0 THEN 'buy' ELSE 'sell' END AS side, CASE rn % 3 WHEN 0 THEN 'market' WHEN 1 THEN 'limit' ELSE 'stop' END AS kind, prev * (1 + ((rn % 5) - 2) * 0.05::DOUBLE) AS level FROM snap WHERE prev IS NOT NULL)"


@query("b07_event_fills", f"""WITH {SNAP}, {_EVENT}, fl AS (SELECT *, CASE WHEN kind = 'market' THEN open * CASE WHEN side = 'buy' THEN 1.001 ELSE 0.999 END WHEN kind = 'limit' THEN CASE WHEN side = 'buy' AND low <= level THEN least(open, level) WHEN side = 'sell' AND high >= level THEN greatest(open, level) END
WHEN side = 'buy' AND high >= level THEN greatest(open, level) * 1.001 WHEN side = 'sell' AND low <= level THEN least(open, level) * 0.999 END AS fill FROM ev) SELECT symbol, ts, side, kind, round(fill + 1e-9, 4) AS fill FROM fl""")
def b07(spark, d):
    rn = F.col("rn")
    orders = snap(spark, d).filter("prev IS NOT NULL").select("symbol", "ts", "open", "high", "low", F.when(rn % 2 == 0, "buy").otherwise("sell").alias("side"), F.when(rn % 3 == 0, "market").when(rn % 3 == 1, "limit").otherwise("stop").alias("kind"), (F.col("prev") * (1 + (rn % 5 - 2) * 0.05)).alias("level"))
    return engines.order_fills(orders).select("symbol", "ts", "side", "kind", F.round(F.col("fill") + 1e-9, 4).alias("fill"))


def orders(spark: SparkSession, d: str) -> DataFrame:
    """Two strategies' orders: with the trend, and against it."""
    s = snap(spark, d).filter("rn >= 5")
    trend = F.when(F.col("ma5") > F.col("ma10"), "buy").when(F.col("ma5") < F.col("ma10"), "sell").otherwise("hold")
    dip = F.when(F.col("rsi14") < 40, "buy").when(F.col("rsi14") > 60, "sell").otherwise("hold")
    runs = F.explode(F.array(*(F.struct(F.lit(n).alias("strategy"), side.alias("side")) for n, side in (("trend", trend), ("dip", dip)))))
    return s.select("ts", "symbol", F.round(F.col("close") + 1e-9, 4).alias("price"), runs.alias("r")).select("r.strategy", F.col("ts").cast("timestamp_ntz").alias("ts"), "symbol", "price", "r.side")


@query("b01_b10_portfolio")
def b01(spark, d):
    out = engines.portfolio(orders(spark, d))
    return out.select("strategy", "ts", F.round("cash", 2).alias("cash"), F.round("value", 2).alias("value"), "trades")


@query("b12_cut_scan", f"""WITH {SNAP}, q AS (SELECT symbol, ts, ret AS x, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM snap), z AS (SELECT symbol, count(*) {ALL} AS n0, sum(x) {ALL} AS s0, count(*) OVER (PARTITION BY symbol) AS m, sum(x) OVER (PARTITION BY symbol) AS s FROM q WHERE back <= 40),
y AS (SELECT symbol, n0, abs(s0 / n0 - (s - s0) / (m - n0)) AS gap, sqrt(m / (2.0::DOUBLE * n0 * (m - n0)) * ln(4 * ln(m) / 0.002::DOUBLE)) AS bound FROM z WHERE n0 >= 5 AND m - n0 >= 5 AND n0 <= floor(m / 2)) SELECT symbol, round(max(gap), 6) AS gap, min(CASE WHEN gap > bound THEN n0 END) AS cut, max(CASE WHEN gap > bound THEN 1 ELSE 0 END)::INTEGER AS drifted FROM y GROUP BY 1""")
def b12(spark, d):
    return engines.cut_scan(snap(spark, d).select("symbol", "ts", F.col("ret").alias("x")))


def windows_sql(source: str, bound: str) -> str:
    """CTEs p (sums of `source`'s x by symbol and place) and f: each place's window, its first value after `start`, and what was cut there."""
    b = drift.BOUNDS[bound]
    m = "(g.i - g.start)"
    n0, d, high = "(c.i - g.start)", f"{b.delta}::DOUBLE", f"{m} // 2" if b.halves else f"{m} - {b.side + 1}"
    share = f"({m} / ({n0} * ({m} - {n0}))::DOUBLE)"
    gap = f"sqrt({share} / 2 * ln(4 * ln({m}) / {d}))" if b.halves else f"sqrt({share} * ln(4 / {d}) / 2 + ln(4 / {d}) * ln(4 / {d}) / (6 * {m}))"
    most = f"CASE WHEN f.i + 1 - f.start > {b.most} THEN 1 ELSE 0 END" if b.most else "0"
    return f"""p AS MATERIALIZED (SELECT symbol, ts, x, row_number() {W} AS i, sum(x) {ALL} AS s FROM {source} WHERE x IS NOT NULL UNION ALL SELECT DISTINCT symbol, NULL, NULL, 0, 0.0 FROM {source} WHERE x IS NOT NULL),
f AS (SELECT symbol, 0::BIGINT AS i, 0::BIGINT AS start, 0::BIGINT AS cut FROM p WHERE i = 0 UNION ALL SELECT g.symbol, g.i, g.start + coalesce(min({n0}), 0), coalesce(min({n0}), 0) FROM (SELECT f.symbol, f.i + 1 AS i, f.start + {most} AS start FROM f) g
JOIN p e ON e.symbol = g.symbol AND e.i = g.i JOIN p a ON a.symbol = g.symbol AND a.i = g.start LEFT JOIN p c ON c.symbol = g.symbol AND {m} >= {b.least} AND {n0} BETWEEN {b.side} AND {high} AND abs((c.s - a.s) / {n0} - (e.s - c.s) / ({m} - {n0})) > {gap} GROUP BY g.symbol, g.i, g.start)"""


_CUT = " SELECT p.symbol, p.ts, f.cut, p.i - f.start AS width, round((p.s - a.s) / (p.i - f.start), 6) AS mean FROM f JOIN p ON p.symbol = f.symbol AND p.i = f.i JOIN p a ON a.symbol = f.symbol AND a.i = f.start WHERE p.i > 0"
_HITS = f"{MONTHLY}, {RETURNS}, e0 AS (SELECT symbol, ts, abs(ret) AS x FROM r WHERE logret IS NOT NULL)"


@query("b12_adaptive_window", f"WITH RECURSIVE {_HITS}, {windows_sql('e0', 'halves')}{_CUT}")
def b12_halves(spark, d):
    """Each bar's window of moves, cut where its older side's mean is another."""
    moves = returns(m.monthly_bars(spark, d)).filter("logret IS NOT NULL").select("symbol", "ts", F.abs("ret").alias("x"))
    return drift.windows(moves, "halves").select("symbol", "ts", "cut", "width", F.round("mean", 6).alias("mean"))


@query("b12_adaptive_window_both_sides", f"WITH RECURSIVE {_HITS}, {windows_sql('e0', 'both_sides')}{_CUT}")
def b12_both(spark, d):
    moves = returns(m.monthly_bars(spark, d)).filter("logret IS NOT NULL").select("symbol", "ts", F.abs("ret").alias("x"))
    return drift.windows(moves, "both_sides").select("symbol", "ts", "cut", "width", F.round("mean", 6).alias("mean"))


_LR = f"{WEEKLY}, {RETURNS}, e AS (SELECT * EXCLUDE rn, ret AS x, CASE WHEN abs(ret) > 0.05 THEN 1 ELSE 0 END AS drifted, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS won FROM r)"


@query("b13_b16_learning_rate", RECURSIVE.format(bars=_LR, source="e", first="(CASE WHEN drifted > 0 THEN 0.005 ELSE 0.01 END)::DOUBLE AS rate, x AS mean, (CASE WHEN won > 0 THEN 1.05 ELSE 0.95 END)::DOUBLE AS weight", step="CASE WHEN b.drifted > 0 THEN greatest(0.001::DOUBLE, f.rate * 0.5) ELSE least(0.01::DOUBLE, f.rate * 1.01::DOUBLE) END, f.mean * 0.99::DOUBLE + b.x * 0.01::DOUBLE, greatest(0.1::DOUBLE, least(2.0::DOUBLE, f.weight * CASE WHEN b.won > 0 THEN 1.05::DOUBLE ELSE 0.95::DOUBLE END))") + " SELECT symbol, ts, round(rate + 1e-9, 6) AS rate, round(mean + 1e-9, 6) AS mean, round(weight + 1e-9, 5) AS weight FROM f")
def b13(spark, d):
    r = returns(m.weekly_bars(spark, d)).select("symbol", "ts", F.col("ret").alias("x"), F.when(F.abs("ret") > 0.05, 1).otherwise(0).alias("drifted"), F.when(F.col("ret") > 0, 1).otherwise(0).alias("won"))
    return engines.learning_rate(r).select("symbol", "ts", F.round(F.col("rate") + 1e-9, 6).alias("rate"), F.round(F.col("mean") + 1e-9, 6).alias("mean"), F.round(F.col("weight") + 1e-9, 5).alias("weight"))


@query("b17_smoothed_weights", RECURSIVE.format(bars=f"{WEEKLY}, e AS (SELECT symbol, ts, volume / sum(volume) OVER (PARTITION BY ts) AS w FROM bars)", source="e", first="w AS smooth", step="0.3::DOUBLE * b.w + (1 - 0.3::DOUBLE) * f.smooth") + " SELECT symbol, ts, round(smooth / sum(smooth) OVER (PARTITION BY ts) + 1e-9, 6) AS weight FROM f")
def b17(spark, d):
    b = m.weekly_bars(spark, d)
    total = b.groupBy("ts").agg(F.sum("volume").alias("total"))
    w = b.join(total, "ts").select("symbol", "ts", (F.col("volume") / F.col("total")).alias("w"))
    return engines.smoothed_weights(w).select("symbol", "ts", F.round(F.col("weight") + 1e-9, 6).alias("weight"))


@query("b15_advantages", RECURSIVE.format(bars=f"{WEEKLY}, {RETURNS}, e AS (SELECT symbol, ts AS spot, ret + 0.99::DOUBLE * coalesce(lead(logret) {W}, 0.0) - coalesce(logret, 0.0) AS delta, -row_number() {W} AS ts FROM (SELECT symbol, ts, ret, coalesce(logret, 0.0) AS logret FROM r))", source="e", first="spot, delta AS advantage", step="b.spot, b.delta + 0.99::DOUBLE * 0.95::DOUBLE * f.advantage") + " SELECT symbol, spot AS ts, round(advantage + 1e-9, 6) AS advantage FROM f")
def b15(spark, d):
    r = returns(m.weekly_bars(spark, d)).select("symbol", "ts", F.col("ret").alias("reward"), F.coalesce("logret", F.lit(0.0)).alias("value"))
    return fold.advantages(r).select("symbol", "ts", F.round(F.col("advantage") + 1e-9, 6).alias("advantage"))


def _sectors(spark, d):
    return optimise.sector_returns(m.monthly_bars(spark, d), m.industries(spark, d))


for _name, _how in {"o01_maximum_sharpe": "sharpe", "o02_minimum_variance": "minimum", "o03_risk_parity": "parity", "o05_constrained": "constrained"}.items():
    query(_name)(lambda spark, d, how=_how: optimise.weights_table(_sectors(spark, d), how))


def _views_sql(variance: str) -> str:
    return f"""WITH {MONTHLY}, {RETURNS}, {DIMS}, sr AS (SELECT ts, sector, avg(ret) AS ret, avg(volume) AS size FROM r JOIN dims USING (symbol) GROUP BY 1, 2), a AS (SELECT sector, avg(size) AS size, avg(ret) AS mean, {variance} AS variance FROM sr GROUP BY 1),
best AS (SELECT sector FROM a ORDER BY mean DESC, sector DESC LIMIT 1), q AS (SELECT sector, size / sum(size) OVER () * (2.0::DOUBLE / 0.05) + CASE WHEN sector IN (FROM best) THEN 0.1::DOUBLE / greatest((1 / 0.6::DOUBLE - 1) * 0.05 * variance, 1e-10) ELSE 0.0 END AS pull FROM a) SELECT sector, round(greatest(pull, 0.0) / sum(greatest(pull, 0.0)) OVER (), 6) AS weight FROM q"""


for _name, _variance, _said in (("o04_black_litterman", optimise.VARIANCE, f"{optimise.VARIANCE}::DOUBLE"), ("o04_views_own_variance", None, "var_pop(ret)")):
    query(_name, _views_sql(_said))(lambda spark, d, variance=_variance: optimise.view_table(_sectors(spark, d), variance=variance).select("sector", F.round("weight", 6).alias("weight")))


_DECOMPOSED = f"{MONTHLY}, {RETURNS}, p AS (SELECT ts, avg(ret) AS p FROM r GROUP BY 1), t AS (SELECT var_pop(p) AS variance FROM p), k AS (SELECT count(DISTINCT symbol) AS symbols FROM r), c AS (SELECT symbol, count(*) AS bars, var_pop(ret) AS own, covar_pop(ret, p) AS cov FROM r JOIN p USING (ts) GROUP BY 1), dc AS (SELECT *, coalesce(cov / nullif(sqrt(variance), 0), 0.0) AS marginal, coalesce(cov / nullif(variance * symbols, 0), 0.0) AS component FROM c, t, k)"


@query("a17_portfolio_variance", f"WITH {_DECOMPOSED} SELECT round(max(variance), 8) AS variance, round(sum(own / symbols / symbols), 8) AS specific, round(sqrt(max(variance)), 7) AS volatility FROM dc")
def a17(spark, d):
    dc = optimise.decomposition(returns(m.monthly_bars(spark, d)))
    return dc.agg(F.round(F.max("variance"), 8).alias("variance"), F.round(F.sum(F.col("own") / F.col("symbols") / F.col("symbols")), 8).alias("specific"), F.round(F.sqrt(F.max("variance")), 7).alias("volatility"))


@query("o06_risk_contributions", f"WITH {_DECOMPOSED} SELECT symbol, bars, round(marginal, 6) AS marginal, round(component, 6) AS component, round(coalesce(own / symbols / symbols / nullif(variance, 0), 0.0), 6) AS specific FROM dc")
def o06(spark, d):
    dc = optimise.decomposition(returns(m.monthly_bars(spark, d)))
    return dc.select("symbol", "bars", F.round("marginal", 6).alias("marginal"), F.round("component", 6).alias("component"), F.round(F.coalesce(F.try_divide(F.col("own") / F.col("symbols") / F.col("symbols"), F.col("variance")), F.lit(0.0)), 6).alias("specific"))


_PORT = f"{MONTHLY}, {RETURNS}, p AS (SELECT ts, avg(ret) AS p FROM r GROUP BY 1), v AS (SELECT ts, p, exp(sum(ln(1 + p)) OVER (ORDER BY ts)) AS value FROM p), dd AS (SELECT *, value / max(value) OVER (ORDER BY ts) - 1 AS dd FROM v)"


def portfolio_path(spark, d):
    """A row for each date: the ordered windows are over dates alone."""
    p = optimise.portfolio_returns(returns(m.monthly_bars(spark, d)))
    order = Window.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    v = p.withColumn("value", F.exp(F.sum(F.log1p("p")).over(order)))
    return v.withColumn("dd", F.col("value") / F.max("value").over(order) - 1)


@query("o07_drawdown_limit", f"WITH {_PORT} SELECT ts, round(dd, 6) AS dd, dd >= -0.15 AS within FROM dd")
def o07(spark, d):
    return portfolio_path(spark, d).select("ts", F.round("dd", 6).alias("dd"), (F.col("dd") >= -0.15).alias("within"))


@query("a18_portfolio_report", f"WITH {_PORT} SELECT count(*) AS dates, round(avg(p) * 12, 6) AS annual, round(stddev_pop(p) * sqrt(12.0::DOUBLE), 6) AS vol, round(coalesce((avg(p) * 12 - 0.02) / nullif(stddev_pop(p) * sqrt(12.0::DOUBLE), 0), 0.0), 5) AS sharpe, round(max(value), 5) AS highest, round(min(dd), 6) AS max_dd FROM dd")
def a18(spark, d):
    v = portfolio_path(spark, d)
    vol = F.stddev_pop("p") * F.sqrt(F.lit(12.0))
    return v.agg(F.count("*").alias("dates"), F.round(F.avg("p") * 12, 6).alias("annual"), F.round(vol, 6).alias("vol"), F.round(F.coalesce(F.try_divide(F.avg("p") * 12 - 0.02, vol), F.lit(0.0)), 5).alias("sharpe"), F.round(F.max("value"), 5).alias("highest"), F.round(F.min("dd"), 6).alias("max_dd"))


@query("a04_metric_variants", f"WITH {SNAP}, q AS (SELECT symbol, count(*) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd, sum(CASE WHEN ret > 0 THEN ret ELSE 0.0 END) AS gain, sum(CASE WHEN ret < 0 THEN -ret ELSE 0.0 END) AS loss, avg(CASE WHEN ret > 0 THEN ret END) AS win, avg(CASE WHEN ret < 0 THEN -ret END) AS lost FROM snap GROUP BY 1) SELECT symbol, round(coalesce(mean / nullif(sd, 0), 0.0) * sqrt(252.0::DOUBLE), 5) AS sharpe_252, round(coalesce(mean / nullif(sd, 0), 0.0) * sqrt(12.0::DOUBLE), 5) AS sharpe_12, round(coalesce((gain - loss) / nullif(loss, 0), 0.0), 5) AS gain_to_pain, round(coalesce(win / nullif(lost, 0), 0.0), 5) AS payoff, round(mean, 7) AS expectancy FROM q")
def a04(spark, d):
    r, ret = snap(spark, d), F.col("ret")
    q = r.groupBy("symbol").agg(F.avg(ret).alias("mean"), F.stddev_samp(ret).alias("sd"), F.sum(F.when(ret > 0, ret).otherwise(0.0)).alias("gain"), F.sum(F.when(ret < 0, -ret).otherwise(0.0)).alias("loss"), F.avg(F.when(ret > 0, ret)).alias("win"), F.avg(F.when(ret < 0, -ret)).alias("lost"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    sharpe = ratio(F.col("mean"), F.col("sd"))
    return q.select("symbol", F.round(sharpe * F.sqrt(F.lit(252.0)), 5).alias("sharpe_252"), F.round(sharpe * F.sqrt(F.lit(12.0)), 5).alias("sharpe_12"), F.round(ratio(F.col("gain") - F.col("loss"), F.col("loss")), 5).alias("gain_to_pain"), F.round(ratio(F.col("win"), F.col("lost")), 5).alias("payoff"), F.round("mean", 7).alias("expectancy"))


@query("a06_window_summary", f"WITH {SNAP}, q AS (SELECT symbol, floor((rn - 1) / 12)::BIGINT AS win, exp(sum(ln(1 + ret))) - 1 AS gain, count(*) AS n FROM snap GROUP BY 1, 2) SELECT win, count(*) AS symbols, round(avg(gain), 6) AS mean, round(stddev_pop(gain), 6) AS std, round(avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END), 6) AS consistent FROM q WHERE n = 12 GROUP BY 1")
def a06(spark, d):
    q = snap(spark, d).groupBy("symbol", F.floor((F.col("rn") - 1) / 12).alias("win")).agg((F.exp(F.sum(F.log1p("ret"))) - 1).alias("gain"), F.count("*").alias("n")).filter("n = 12")
    return q.groupBy("win").agg(F.count("*").alias("symbols"), F.round(F.avg("gain"), 6).alias("mean"), F.round(F.stddev_pop("gain"), 6).alias("std"), F.round(F.avg(F.when(F.col("gain") > 0, 1.0).otherwise(0.0)), 6).alias("consistent"))


@query("a09_c14_recent_wins", f"WITH {SNAP}, q AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM snap WHERE logret IS NOT NULL), z AS (SELECT symbol, coalesce(avg(CASE WHEN back <= 60 THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END), 0.55) AS p, coalesce(coalesce(avg(CASE WHEN back <= 60 AND ret > 0 THEN ret END), 1.0) / nullif(coalesce(avg(CASE WHEN back <= 60 AND ret < 0 THEN -ret END), 1.0), 0), 2.0) AS b FROM q GROUP BY 1) SELECT symbol, round(p, 6) AS win_rate, round(b, 5) AS payoff, round(p - (1 - p) / b, 5) AS kelly, round((p - (1 - p) / b) / 2, 5) AS half, CASE WHEN p > 0.55 THEN 'high' WHEN p > 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM z")
def a09(spark, d):
    q = snap(spark, d).filter("logret IS NOT NULL").select("symbol", "ret", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))).alias("back"))
    now, ret = F.col("back") <= 60, F.col("ret")
    mean = lambda cond, v: F.coalesce(F.avg(F.when(now & cond, v)), F.lit(1.0))
    z = q.groupBy("symbol").agg(F.coalesce(F.avg(F.when(now, F.when(ret > 0, 1.0).otherwise(0.0))), F.lit(0.55)).alias("p"), F.coalesce(F.try_divide(mean(ret > 0, ret), mean(ret < 0, -ret)), F.lit(2.0)).alias("b"))
    p, kelly = F.col("p"), F.col("p") - (1 - F.col("p")) / F.col("b")
    return z.select("symbol", F.round(p, 6).alias("win_rate"), F.round("b", 5).alias("payoff"), F.round(kelly, 5).alias("kelly"), F.round(kelly / 2, 5).alias("half"), F.when(p > 0.55, "high").when(p > 0.5, "medium").otherwise("low").alias("confidence"))


@query("a12_analyst_vote", f"""WITH {SNAP}, v AS (SELECT symbol, ts, CASE WHEN rsi14 < 40 THEN 'bullish' WHEN rsi14 > 60 THEN 'bearish' ELSE 'neutral' END AS a, CASE WHEN ma5 > ma20 THEN 'bullish' WHEN ma5 < ma20 THEN 'bearish' ELSE 'neutral' END AS b, CASE WHEN mom5 > 0.05 THEN 'bullish' WHEN mom5 < -0.05 THEN 'bearish' ELSE 'neutral' END AS c FROM snap),
k AS (SELECT symbol, ts, (a = 'bullish')::INTEGER + (b = 'bullish')::INTEGER + (c = 'bullish')::INTEGER AS up, (a = 'bearish')::INTEGER + (b = 'bearish')::INTEGER + (c = 'bearish')::INTEGER AS down FROM v) SELECT symbol, ts, up, down, CASE WHEN up > down THEN 'bullish' WHEN down > up THEN 'bearish' ELSE 'neutral' END AS consensus, round(CASE WHEN up > down THEN up WHEN down > up THEN down ELSE 3 - up - down END / 3, 6) AS agreement FROM k""")
def a12(spark, d):
    s = snap(spark, d)
    says = (F.when(F.col("rsi14") < 40, 1).when(F.col("rsi14") > 60, -1).otherwise(0), F.when(F.col("ma5") > F.col("ma20"), 1).when(F.col("ma5") < F.col("ma20"), -1).otherwise(0), F.when(F.col("mom5") > 0.05, 1).when(F.col("mom5") < -0.05, -1).otherwise(0))
    count = lambda sign: sum(F.when(v == sign, 1).otherwise(0) for v in says)
    k = s.select("symbol", "ts", count(1).alias("up"), count(-1).alias("down"))
    up, down = F.col("up"), F.col("down")
    return k.select("symbol", "ts", "up", "down", F.when(up > down, "bullish").when(down > up, "bearish").otherwise("neutral").alias("consensus"), F.round(F.when(up > down, up).when(down > up, down).otherwise(3 - up - down) / 3, 6).alias("agreement"))


@query("c20_worst_return", f"WITH {SNAP}, q AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret, ts) AS place, count(*) OVER (PARTITION BY symbol) AS n FROM snap) SELECT symbol, round(CASE WHEN max(n) < 20 THEN 0.05 ELSE -min(ret) END, 6) AS var, round(CASE WHEN max(n) < 20 THEN 0.03 ELSE -avg(CASE WHEN place <= greatest(1, floor(n * 0.05)) THEN ret END) END, 6) AS cvar FROM q GROUP BY 1")
def c20(spark, d):
    """The worst return and the mean of the worst twentieth; stated values where there are fewer than 20."""
    q = snap(spark, d).select("symbol", "ret", F.row_number().over(Window.partitionBy("symbol").orderBy("ret", "ts")).alias("place"), F.count("*").over(Window.partitionBy("symbol")).alias("n"))
    tail = F.avg(F.when(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("n") * 0.05)), F.col("ret")))
    return q.groupBy("symbol").agg(F.round(F.when(F.max("n") < 20, 0.05).otherwise(-F.min("ret")), 6).alias("var"), F.round(F.when(F.max("n") < 20, 0.03).otherwise(-tail), 6).alias("cvar"))
