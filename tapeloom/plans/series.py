"""Queries over single series: scans, windows and recursive scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import fold, timeseries as t
from tapeloom.plans.registry import ALL, MONTHLY, RETURNS, WEEKLY, W, corr_sql, over, prior, query, ratio
from tapeloom.sources import market as m

#: Prices are quotients with few digits, so many lie midway between two roundings; engines part there without this.
NUDGE = 1e-9
BAR = "symbol, ts, " + ", ".join(f"round({c} + 1e-9, 6) AS {c}" for c in ("open", "high", "low", "close")) + ", volume, amount, outer_vol, n"


def rounded(df, *keys: str, digits: int = 6):
    return df.select(*keys, *(F.round(F.col(c) + NUDGE, digits).alias(c) for c in df.columns if c not in keys))


def _bars(df):
    return df.select("symbol", "ts", *(F.round(F.col(c) + NUDGE, 6).alias(c) for c in ("open", "high", "low", "close")), "volume", "amount", "outer_vol", "n")


@query("s05_resample_monthly", f"WITH {MONTHLY} SELECT {BAR} FROM bars")
def s05_monthly(spark, d):
    return _bars(m.monthly_bars(spark, d))


@query("s05_resample_weekly", f"WITH {WEEKLY} SELECT {BAR} FROM bars")
def s05_weekly(spark, d):
    return _bars(m.weekly_bars(spark, d))


@query("st10_hourly_ohlc", """SELECT event_type AS symbol, date_trunc('hour', ts) AS ts, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close,
count(*)::DOUBLE AS volume, round(sum(value), 2) AS amount, 0.0::DOUBLE AS outer_vol, count(*) AS n FROM events GROUP BY 1, 2""")
def st10(spark, d):
    return m.hourly_bars(spark, d)


@query("s06_tail", f"WITH {MONTHLY} SELECT symbol, ts, round(close + 1e-9, 6) AS close, back FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars) WHERE back <= 5")
def s06(spark, d):
    return m.tail(m.monthly_bars(spark, d), 5).select("symbol", "ts", F.round(F.col("close") + NUDGE, 6).alias("close"), F.col("back").cast("long").alias("back"))


@query("s08_date_range", "SELECT l_suppkey AS symbol, count(*) AS n, sum(l_quantity) AS volume FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY 1")
def s08(spark, d):
    return m.table(spark, d, "lineitem").filter("l_shipdate >= timestamp'1996-01-01' and l_shipdate < timestamp'1997-01-01'").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("volume"))


@query("s09_moving_averages", f"WITH {MONTHLY} SELECT symbol, ts, " + ", ".join(f"round(avg(close) {over(k)} + 1e-9, 6) AS ma{k}" for k in (5, 10, 20, 60)) + " FROM bars")
def s09(spark, d):
    return m.monthly_bars(spark, d).select("symbol", "ts", *(F.round(F.avg("close").over(t.last(k)) + NUDGE, 6).alias(f"ma{k}") for k in (5, 10, 20, 60)))


@query("s10_bar_summary", f"WITH {MONTHLY} SELECT symbol, count(*) AS n, round(max(close), 6) AS highest, round(min(close), 6) AS lowest, round(avg(close) FILTER (WHERE close > 0), 6) AS mean_close, round(avg(volume) FILTER (WHERE volume > 0), 6) AS mean_volume, round(stddev_pop(close), 6) AS std FROM bars GROUP BY 1")
def s10(spark, d):
    c, v = F.col("close"), F.col("volume")
    return m.monthly_bars(spark, d).groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.max(c), 6).alias("highest"), F.round(F.min(c), 6).alias("lowest"), F.round(F.avg(F.when(c > 0, c)), 6).alias("mean_close"), F.round(F.avg(F.when(v > 0, v)), 6).alias("mean_volume"), F.round(F.stddev_pop(c), 6).alias("std"))


@query("s01_quote_fields", f"""WITH {MONTHLY}, q AS (SELECT symbol, ts, 'v_x="1~name' || symbol || '~' || lpad(symbol::VARCHAR, 6, '0') || '~' || round(close + 1e-9, 2)::DECIMAL(18,2) || '~~' || 'bad' || '~' || volume::BIGINT || '~9/' || round(low + 1e-9, 2)::DECIMAL(18,2) || '/1"' AS line FROM bars)
SELECT symbol, ts, lpad(symbol::VARCHAR, 6, '0') AS code, 'name' || symbol AS name, string_split(line, '~')[4]::DOUBLE AS price, NULL::DOUBLE AS prev_close, NULL::DOUBLE AS open, string_split(line, '~')[7]::DOUBLE AS volume, string_split(string_split(line, '~')[8], '/')[2]::DOUBLE AS low FROM q""")
def s01(spark, d):
    b = m.monthly_bars(spark, d)
    price = lambda c: F.round(F.col(c) + NUDGE, 2).cast("decimal(18,2)").cast("string")
    line = F.concat(F.lit('v_x="1~name'), "symbol", F.lit("~"), F.lpad(F.col("symbol").cast("string"), 6, "0"), F.lit("~"), price("close"), F.lit("~~bad~"), F.col("volume").cast("long"), F.lit("~9/"), price("low"), F.lit('/1"'))
    return b.select("symbol", "ts", m.quote_fields(line).alias("q")).select("symbol", "ts", "q.code", "q.name", "q.price", "q.prev_close", "q.open", "q.volume", "q.low")


@query("s13_unit_numbers", "SELECT c_custkey, round(c_acctbal, 2) * CASE WHEN c_custkey % 3 = 0 THEN 1.0 WHEN c_custkey % 3 = 1 THEN 10000.0 ELSE 1.0 END AS value FROM customer")
def s13(spark, d):
    said = F.concat(F.round("c_acctbal", 2).cast("decimal(18,2)").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "%").when(F.col("c_custkey") % 3 == 1, "万").otherwise(" "))
    return m.table(spark, d, "customer").select("c_custkey", m.unit_number(said).alias("value"))


@query("s21_data_quality", f"""WITH {MONTHLY}, q AS (SELECT symbol, count(*) AS bars, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (WHERE coalesce(open, 0) = 0) + count(*) FILTER (WHERE coalesce(high, 0) = 0) + count(*) FILTER (WHERE coalesce(low, 0) = 0) + count(*) FILTER (WHERE coalesce(close, 0) = 0) + count(*) FILTER (WHERE coalesce(volume, 0) = 0) AS missing, count(*) FILTER (WHERE high < low) AS crossed FROM bars GROUP BY 1)
SELECT *, round(missing / (bars * 5), 6) AS missing_rate, (100 - CASE WHEN missing / (bars * 5) > 0.05 THEN 30 WHEN missing / (bars * 5) > 0.01 THEN 10 ELSE 0 END - CASE WHEN bars < 60 THEN 20 ELSE 0 END - CASE WHEN crossed > 0 THEN 40 ELSE 0 END)::INTEGER AS score FROM q""")
def s21(spark, d):
    return m.quality(m.monthly_bars(spark, d))


@query("w01_w03_rolling", f"""WITH {MONTHLY} SELECT symbol, ts, round(close - lag(close) {W} + 1e-9, 6) AS delta, round(max(close) {over(20)} + 1e-9, 6) AS hi, round(min(close) {over(20)} + 1e-9, 6) AS lo, round(avg(close) {over(20)} + 1e-9, 6) AS mean, round(sum(close) {over(20)} + 1e-9, 6) AS total, round(stddev_samp(close) {over(20)} + 1e-9, 6) AS std FROM bars""")
def w01(spark, d):
    return rounded(t.rolling(m.monthly_bars(spark, d), 20).select("symbol", "ts", "delta", "hi", "lo", "mean", "total", "std"), "symbol", "ts")


@query("w04_ts_rank", f"WITH {MONTHLY}, x AS (SELECT symbol, ts, close, count(*) {over(10)} AS n, list(close) {over(10)} AS v FROM bars) SELECT symbol, ts, CASE WHEN n >= 10 THEN len(list_filter(v, lambda a: a <= close)) / 10.0::DOUBLE ELSE 0.5 END::DOUBLE AS rank FROM x")
def w04(spark, d):
    return m.monthly_bars(spark, d).select("symbol", "ts", t.ts_rank("close", 10).alias("rank"))


@query("w05_ts_corr", f"WITH {MONTHLY} SELECT symbol, ts, CASE WHEN count(*) {over(10)} >= 10 THEN round({corr_sql('close', 'volume', over(10))}, 6) ELSE 0.0 END AS corr FROM bars")
def w05(spark, d):
    return m.monthly_bars(spark, d).select("symbol", "ts", F.round(t.ts_corr("close", "volume", 10), 6).alias("corr"))


@query("w06_ts_arg", f"WITH {MONTHLY}, x AS (SELECT symbol, ts, count(*) {over(10)} AS n, list(close) {over(10)} AS v, max(close) {over(10)} AS hi, min(close) {over(10)} AS lo FROM bars) SELECT symbol, ts, (CASE WHEN n >= 10 THEN list_position(v, hi) - 1 ELSE 5 END)::INTEGER AS argmax, (CASE WHEN n >= 10 THEN list_position(v, lo) - 1 ELSE 5 END)::INTEGER AS argmin FROM x")
def w06(spark, d):
    return m.monthly_bars(spark, d).select("symbol", "ts", t.ts_arg("close", 10, True).alias("argmax"), t.ts_arg("close", 10, False).alias("argmin"))


@query("w08_returns", f"WITH {MONTHLY}, {RETURNS} SELECT symbol, ts, round(ret + 1e-9, 6) AS ret, round(logret + 1e-9, 6) AS logret FROM r")
def w08(spark, d):
    return rounded(t.returns(m.monthly_bars(spark, d)).select("symbol", "ts", "ret", "logret"), "symbol", "ts")


def _alpha_sql() -> str:
    out = {}
    for p in (2, 5, 10, 20, 30, 60):
        out[f"momentum_{p}"] = f"coalesce(close / lag(close, {p}) {W} - 1, 0.0)"
        out[f"volatility_{p}"] = f"stddev_pop(ret) {over(p)}"
    for p in (1, 3, 5):
        out[f"reversal_{p}"] = f"-coalesce(close / lag(close, {p}) {W} - 1, 0.0)"
    for p in (5, 10, 20):
        out[f"volume_ratio_{p}"] = ratio("volume", f"avg(volume) {prior(p)}", "1.0")
        out[f"amihud_{p}"] = f"coalesce(avg(abs(ret) / volume) {prior(p)}, 0.0)"
        for x, name in (("close", "price"), ("volume", "volume")):
            out[f"{name}_position_{p}"] = ratio(f"{x} - min({x}) {prior(p)}", f"max({x}) {prior(p)} - min({x}) {prior(p)}", "0.5")
        out[f"volume_price_corr_{p}"] = f"CASE WHEN count(*) {prior(p)} >= {p} THEN {corr_sql('close', 'volume', prior(p))} ELSE 0.0 END"
    for p in (5, 10):
        out[f"volume_momentum_{p}"] = f"coalesce(volume / lag(volume, {p}) {W} - 1, 0.0)"
    for a, b in ((5, 10), (5, 20), (10, 20)):
        out[f"ma_ratio_{a}_{b}"] = ratio(f"avg(close) {prior(a)}", f"avg(close) {prior(b)}", "1.0")
    up, down = f"stddev_pop(CASE WHEN ret > 0 THEN ret END) {ALL}", f"stddev_pop(CASE WHEN ret < 0 THEN ret END) {ALL}"
    out |= {"upside_vol": f"coalesce({up}, 0.0)", "downside_vol": f"coalesce({down}, 0.0)", "vol_ratio": ratio(up, down, "1.0")}
    out["skew_20"] = f"CASE WHEN count(*) {over(20)} >= 20 THEN coalesce(skewness(ret) {over(20)}, 0.0) ELSE 0.0 END"
    out["kurt_20"] = f"CASE WHEN count(*) {over(20)} >= 20 THEN coalesce(kurtosis(ret) {over(20)}, 0.0) ELSE 0.0 END"
    out["autocorr_10"] = f"CASE WHEN count(back) {prior(10)} >= 10 THEN {corr_sql('ret', 'back', prior(10))} ELSE 0.0 END"
    return f"WITH {MONTHLY}, {RETURNS}, b AS (SELECT *, lag(ret, 10) {W} AS back FROM r) SELECT symbol, ts, " + ", ".join(f"round({v}, 6) AS {k}" for k, v in out.items()) + " FROM b"


@query("w09_w20_alpha_factors", _alpha_sql())
def w09(spark, d):
    return t.alpha_factors(m.monthly_bars(spark, d))


RSI = "CASE WHEN {l} > 0 THEN 100 - 100 / (1 + {g} / {l}) ELSE 100.0 END"


def _rsi_sql() -> str:
    g, lo = "greatest(diff, 0.0)", "greatest(-diff, 0.0)"
    a = RSI.format(g=f"avg({g}) {over(14)}", l=f"avg({lo}) {over(14)}")
    b = RSI.format(g=f"coalesce(avg(CASE WHEN diff > 0 THEN diff END) {over(14)}, 0.0)", l=f"coalesce(avg(CASE WHEN diff < 0 THEN -diff END) {over(14)}, 0.001)")
    c = RSI.format(g=f"(sum({g}) {over(14)} / 14)", l=f"(sum({lo}) {over(14)} / 14)")
    # greatest skips nulls in this dialect, so a first bar's change is taken out by its own test
    g2 = "diff, 0.0"
    a, b, c = (x.replace(f"greatest({g2})", "CASE WHEN diff IS NOT NULL THEN greatest(diff, 0.0) END").replace("greatest(-diff, 0.0)", "CASE WHEN diff IS NOT NULL THEN greatest(-diff, 0.0) END") for x in (a, b, c))
    return f"WITH {MONTHLY}, {RETURNS} SELECT symbol, ts, round(CASE WHEN count(diff) {over(14)} >= 14 THEN {a} ELSE 50.0 END + 1e-9, 6) AS cutler, round(CASE WHEN count(diff) {over(14)} >= 14 THEN {b} ELSE 50.0 END + 1e-9, 6) AS winners, round(CASE WHEN count(diff) {over(14)} > 0 THEN {c} ELSE 50.0 END + 1e-9, 6) AS recent FROM r"


@query("w21_w24_rsi", _rsi_sql())
def w21(spark, d):
    r = t.returns(m.monthly_bars(spark, d))
    known = F.col("diff").isNotNull()
    r = r.select("symbol", "ts", "diff", t.rsi_cutler(14).alias("cutler"), t.rsi_winners(14).alias("winners"), F.when(F.count("diff").over(t.last(14)) > 0, t.rsi_recent_gains(14)).otherwise(50.0).alias("recent"), known.alias("known"))
    return rounded(r.select("symbol", "ts", "cutler", "winners", "recent"), "symbol", "ts")


RECURSIVE = "WITH RECURSIVE {bars}, b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS rn FROM {source}), f AS (SELECT symbol, ts, rn, {first} FROM b WHERE rn = 1 UNION ALL SELECT b.symbol, b.ts, b.rn, {step} FROM f JOIN b ON b.symbol = f.symbol AND b.rn = f.rn + 1)"


@query("w27_ema", RECURSIVE.format(bars=MONTHLY, source="bars", first="close AS ema", step="f.ema + (b.close - f.ema) * (2.0::DOUBLE / 13)") + " SELECT symbol, ts, round(ema + 1e-9, 4) AS ema FROM f")
def w27(spark, d):
    return rounded(fold.ema_series(m.monthly_bars(spark, d), 12), "symbol", "ts", digits=4)


_FAST, _SLOW = "(f.fast + (b.close - f.fast) * (2.0::DOUBLE / 13))", "(f.slow + (b.close - f.slow) * (2.0::DOUBLE / 27))"
_MACD = RECURSIVE.format(bars=WEEKLY, source="bars", first="close AS fast, close AS slow, 0.0::DOUBLE AS dea", step=f"{_FAST}, {_SLOW}, f.dea + ({_FAST} - {_SLOW} - f.dea) * (2.0::DOUBLE / 10)")


@query("w28_macd", _MACD + " SELECT symbol, ts, round(fast - slow + 1e-9, 4) AS dif, round(dea + 1e-9, 4) AS dea, round(fast - slow - dea + 1e-9, 4) AS hist FROM f")
def w28(spark, d):
    return rounded(fold.macd(m.weekly_bars(spark, d)), "symbol", "ts", digits=4)


@query("w29_macd_cross", _MACD + f", h AS (SELECT symbol, ts, fast - slow - dea AS hist FROM f), l AS (SELECT *, lag(hist) {W} AS back FROM h) SELECT symbol, ts, round(hist, 4) AS hist, CASE WHEN back <= 0 AND hist > 0 THEN 'golden' WHEN back >= 0 AND hist < 0 THEN 'death' ELSE 'none' END AS \"cross\" FROM l")
def w29(spark, d):
    return fold.macd_cross(m.weekly_bars(spark, d))


def wilder_sql(p: int, state: str, x: str, first: int) -> str:
    i = "(b.rn - 1)"
    return f"CASE WHEN {i} < {first} THEN 0.0 WHEN {i} < {first + p} THEN f.{state} + {x} / {p} ELSE (f.{state} * {p - 1} + {x}) / {p} END"


_DIFFS = f"{WEEKLY}, c AS (SELECT *, coalesce(close - lag(close) {W}, 0.0) AS d, greatest(high - low, coalesce(abs(high - lag(close) {W}), 0.0), coalesce(abs(low - lag(close) {W}), 0.0)) AS tr, high - lag(high) {W} AS up, lag(low) {W} - low AS down FROM bars), c2 AS (SELECT *, CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS plus, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS minus FROM c)"


@query("w23_rsi_wilder", RECURSIVE.format(bars=_DIFFS, source="c2", first="0.0::DOUBLE AS gain, 0.0::DOUBLE AS loss", step=f"{wilder_sql(14, 'gain', 'greatest(b.d, 0.0)', 1)}, {wilder_sql(14, 'loss', 'greatest(-b.d, 0.0)', 1)}") + " SELECT symbol, ts, round(CASE WHEN rn - 1 < 14 THEN 50.0 WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) ELSE 100.0 END + 1e-9, 4) AS rsi FROM f")
def w23(spark, d):
    return rounded(fold.rsi_wilder(m.weekly_bars(spark, d)), "symbol", "ts", digits=4)


@query("w32_atr_wilder", RECURSIVE.format(bars=_DIFFS, source="c2", first="tr / 14 AS atr", step=wilder_sql(14, "atr", "b.tr", 0)) + " SELECT symbol, ts, CASE WHEN rn - 1 >= 13 THEN round(atr, 2) END AS atr FROM f")
def w32(spark, d):
    return rounded(fold.atr_wilder(m.weekly_bars(spark, d)), "symbol", "ts", digits=2)


@query("w34_adx", RECURSIVE.format(bars=_DIFFS, source="c2", first="0.0::DOUBLE AS tr, 0.0::DOUBLE AS plus, 0.0::DOUBLE AS minus", step=", ".join(wilder_sql(14, x, f"b.{x}", 1) for x in ("tr", "plus", "minus"))) + f", g AS (SELECT *, coalesce(plus * 100 / nullif(tr, 0), 50.0) AS pdi, coalesce(minus * 100 / nullif(tr, 0), 50.0) AS mdi FROM f), h AS (SELECT *, coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0.0) AS dx FROM g) SELECT symbol, ts, round(pdi + 1e-9, 4) AS plus_di, round(mdi + 1e-9, 4) AS minus_di, round(avg(CASE WHEN rn - 1 >= 14 THEN dx END) {over(14)} + 1e-9, 4) AS adx FROM h")
def w34(spark, d):
    return rounded(fold.adx(m.weekly_bars(spark, d)), "symbol", "ts", digits=4)


@query("w37_garch", RECURSIVE.format(bars=f"{WEEKLY}, c AS (SELECT *, coalesce(ln(close / lag(close) {W}), 0.0) AS r FROM bars)", source="c", first="(1e-6::DOUBLE / (1 - 0.05::DOUBLE - 0.94::DOUBLE)) AS v, r", step="1e-6::DOUBLE + 0.05::DOUBLE * f.r * f.r + 0.94::DOUBLE * f.v, b.r") + " SELECT symbol, ts, round(v + 1e-9, 6) AS variance, round(1e-6::DOUBLE / (1 - 0.05::DOUBLE - 0.94::DOUBLE) + pow(0.99::DOUBLE, 5) * (v - 1e-6::DOUBLE / (1 - 0.05::DOUBLE - 0.94::DOUBLE)) + 1e-9, 6) AS forecast_5 FROM f")
def w37(spark, d):
    return rounded(fold.garch(m.weekly_bars(spark, d)), "symbol", "ts")


@query("b03_trailing_stop", RECURSIVE.format(bars=WEEKLY, source="bars", first="close AS peak, close AS entry, 0.0::DOUBLE AS pnl, 0.0::DOUBLE AS trades", step="""
CASE WHEN f.peak > 0 AND b.close < greatest(f.peak, b.close) * 0.9::DOUBLE THEN 0.0 WHEN f.peak > 0 THEN greatest(f.peak, b.close) ELSE b.close END,
CASE WHEN f.peak > 0 AND b.close < greatest(f.peak, b.close) * 0.9::DOUBLE THEN 0.0 WHEN f.peak > 0 THEN f.entry ELSE b.close END,
f.pnl + CASE WHEN f.peak > 0 AND b.close < greatest(f.peak, b.close) * 0.9::DOUBLE THEN b.close / f.entry - 1 ELSE 0.0 END,
f.trades + CASE WHEN f.peak > 0 AND b.close < greatest(f.peak, b.close) * 0.9::DOUBLE THEN 1.0 ELSE 0.0 END""") + " SELECT symbol, ts, round(peak + 1e-9, 4) AS peak, round(entry + 1e-9, 4) AS entry, round(pnl + 1e-9, 4) AS pnl, round(trades + 1e-9, 4) AS trades FROM f")
def b03(spark, d):
    return rounded(fold.trailing_stop(m.weekly_bars(spark, d)), "symbol", "ts", digits=4)


@query("w30_divergence", f"WITH {MONTHLY}, {RETURNS}, x AS (SELECT *, avg(ret) {over(5)} AS ind FROM r), y AS (SELECT symbol, ts, " + ", ".join(f"{f}({c}) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {a} PRECEDING AND {b}) AS {n}" for n, f, c, a, b in (("ch", "max", "close", 9, "CURRENT ROW"), ("cl", "min", "close", 9, "CURRENT ROW"), ("ih", "max", "ind", 9, "CURRENT ROW"), ("il", "min", "ind", 9, "CURRENT ROW"), ("pch", "max", "close", 19, "10 PRECEDING"), ("pcl", "min", "close", 19, "10 PRECEDING"), ("pih", "max", "ind", 19, "10 PRECEDING"), ("pil", "min", "ind", 19, "10 PRECEDING"), ("k", "count", "ind", 19, "10 PRECEDING"))) + " FROM x) SELECT symbol, ts, CASE WHEN k >= 10 AND ch > pch AND ih < pih THEN 'bearish' WHEN k >= 10 AND cl < pcl AND il > pil THEN 'bullish' ELSE 'none' END AS divergence FROM y")
def w30(spark, d):
    r = t.returns(m.monthly_bars(spark, d)).withColumn("ind", F.avg("ret").over(t.last(5)))
    return r.select("symbol", "ts", t.divergence(10).alias("divergence"))


@query("w31_bollinger", f"WITH {MONTHLY}, x AS (SELECT symbol, ts, close, avg(close) {over(20)} AS a, stddev_pop(close) {over(20)} AS s FROM bars) SELECT symbol, ts, round(a + 1e-9, 6) AS middle, round(a + 2.0 * s + 1e-9, 6) AS upper, round(a - 2.0 * s + 1e-9, 6) AS lower, round(coalesce(4 * s / nullif(a, 0), 0.0) + 1e-9, 6) AS bandwidth, round(coalesce((close - (a - 2.0 * s)) / nullif(4 * s, 0), 0.5) + 1e-9, 6) AS percent_b, CASE WHEN coalesce(4 * s / nullif(a, 0), 0.0) < 0.05 THEN 'narrow' WHEN coalesce(4 * s / nullif(a, 0), 0.0) > 0.15 THEN 'wide' ELSE 'normal' END AS squeeze FROM x")
def w31(spark, d):
    b = t.bollinger(m.monthly_bars(spark, d))
    return b.select("symbol", "ts", *(F.round(F.col(c) + NUDGE, 6).alias(c) for c in ("middle", "upper", "lower", "bandwidth", "percent_b")), "squeeze")


@query("w33_atr_simple", f"WITH {MONTHLY}, x AS (SELECT symbol, ts, greatest(high - low, coalesce(abs(high - lag(close) {W}), 0.0), coalesce(abs(low - lag(close) {W}), 0.0)) AS tr FROM bars) SELECT symbol, ts, " + ", ".join(f"round(avg(tr) {over(k)}, 6) AS atr_{k}" for k in (7, 14, 21)) + " FROM x")
def w33(spark, d):
    return t.true_range(m.monthly_bars(spark, d)).select("symbol", "ts", *(F.round(F.avg("tr").over(t.last(k)), 6).alias(f"atr_{k}") for k in (7, 14, 21)))


@query("w35_realised_volatility", f"WITH {MONTHLY}, {RETURNS} SELECT symbol, ts, " + ", ".join(f"round(stddev_pop(logret) {over(k)} * sqrt(252) * 100, 6) AS vol_{k}" for k in (5, 20, 60)) + f", round(coalesce(stddev_pop(CASE WHEN logret < 0 THEN logret END) {over(20)} / nullif(stddev_pop(logret) {over(20)}, 0), 0.0), 6) AS downside_ratio FROM r")
def w35(spark, d):
    return t.realised(m.monthly_bars(spark, d))


@query("w38_w41_volume", f"WITH {MONTHLY}, {RETURNS}, v AS (SELECT *, coalesce(volume / lag(volume) {W} - 1, 0.0) AS vc FROM r) SELECT symbol, ts, round(sum(sign(coalesce(diff, 0.0)) * volume) {ALL}, 6) AS obv, round(sum(volume * ret) {over(21)}, 6) AS vpt_21, round(coalesce(volume / avg(volume) {prior(60)}, 1.0) - 1, 6) AS vmom_60, CASE WHEN count(*) {over(21)} >= 21 THEN round({corr_sql('ret', 'vc', over(21))}, 6) ELSE 0.0 END AS vp_change_corr_21, round((high - low) / (high + low), 6) AS range_proxy FROM v")
def w38(spark, d):
    return t.volume_indicators(m.monthly_bars(spark, d))


@query("w46_drawdown", f"WITH {MONTHLY}, x AS (SELECT symbol, ts, close / max(close) {ALL} - 1 AS dd FROM bars), y AS (SELECT *, sum(CASE WHEN dd >= 0 THEN 1 ELSE 0 END) {ALL} AS island FROM x) SELECT symbol, ts, round(dd, 6) AS dd, round(min(dd) {ALL}, 6) AS max_dd, (CASE WHEN dd < 0 THEN row_number() OVER (PARTITION BY symbol, island ORDER BY ts) - 1 ELSE 0 END)::INTEGER AS dd_bars FROM y")
def w46(spark, d):
    return t.drawdown(m.monthly_bars(spark, d))


@query("w48_labels", f"WITH {MONTHLY}, x AS (SELECT symbol, ts, lead(close, 5) {W} / close - 1 - 0.0015 AS f FROM bars) SELECT symbol, ts, round(f, 6) AS forward, (CASE WHEN f > 0.02 THEN 1 WHEN f < -0.02 THEN -1 WHEN f IS NOT NULL THEN 0 END)::INTEGER AS label FROM x WHERE f IS NOT NULL")
def w48(spark, d):
    return t.labels(m.monthly_bars(spark, d)).filter("forward is not null")


def _ml_sql() -> str:
    wl = f"coalesce(avg(CASE WHEN diff < 0 THEN -diff END) {over(14)}, 0.001)"
    rsi = f"CASE WHEN count(diff) {over(14)} >= 14 THEN " + RSI.format(g=f"coalesce(avg(CASE WHEN diff > 0 THEN diff END) {over(14)}, 0.0)", l=wl) + " ELSE 50.0 END"
    made = {f"mom_{p}": (f"coalesce(close / lag(close, {p}) {W} - 1, 0.0)", "0.0") for p in (1, 3, 5, 10)}
    made |= {"volume_ratio": (ratio("volume", f"avg(volume) {prior(20)}", "1.0"), "1.0"), "vol_20": (f"stddev_pop(ret) {over(20)}", "0.02"), "rsi_14": (rsi, "50.0")}
    made |= {f"ma{k}_gap": (f"close / avg(close) {over(k)} - 1", "0.0") for k in (5, 20)}
    made |= {"year_position": (ratio(f"close - min(close) {over(250)}", f"max(close) {over(250)} - min(close) {over(250)}", "0.5"), "0.5"), "outer_share": (ratio("outer_vol", "volume", "0.5"), "0.5"), "turnover": (ratio("volume", f"avg(volume) {ALL}", "1.0"), "1.0")}
    return f"WITH {MONTHLY}, {RETURNS} SELECT symbol, ts, " + ", ".join(f"round(CASE WHEN rn >= 30 THEN {v} ELSE {e} END, 6) AS {k}" for k, (v, e) in made.items()) + " FROM r"


@query("w49_ml_row", _ml_sql())
def w49(spark, d):
    return t.ml_row(m.monthly_bars(spark, d))


@query("w51_sequence_statistics", f"WITH {MONTHLY}, x AS (SELECT *, row_number() {W}::DOUBLE AS k, lag(close) {W} AS back FROM bars), y AS (SELECT symbol, ts, close, avg(close) {over(20)} AS a, stddev_pop(close) {over(20)} AS s, covar_pop(k, close) {over(20)} / nullif(var_pop(k) {over(20)}, 0) AS sl, CASE WHEN count(*) {over(20)} >= 20 THEN {corr_sql('close', 'back', over(20))} ELSE 0.0 END AS lc, list(close) {over(20)} AS v FROM x) SELECT symbol, ts, round(a + 1e-9, 6) AS mean, round(s + 1e-9, 6) AS std, round(coalesce(sl, 0.0) + 1e-9, 6) AS slope, round(lc + 1e-9, 6) AS lag_corr, round(list_min(list_transform(v, lambda q, i: q / list_max(v[1:i]) - 1)) + 1e-9, 6) AS worst_fall FROM y")
def w51(spark, d):
    return t.sequence_statistics(m.monthly_bars(spark, d))


@query("w45_breakout", f"WITH {MONTHLY} SELECT symbol, ts, CASE WHEN close > max(close) {prior(20)} * 1.005 THEN 'resistance' WHEN close < min(close) {prior(20)} * 0.995 THEN 'support' ELSE 'none' END AS breakout FROM bars")
def w45(spark, d):
    return t.breakout(m.monthly_bars(spark, d))


@query("w52_regime", f"WITH {MONTHLY}, {RETURNS}, x AS (SELECT symbol, ts, avg(close) {over(5)} AS a, avg(close) {over(20)} AS b, avg(close) {over(60)} AS c, stddev_pop(ret) {over(20)} AS v FROM r) SELECT symbol, ts, CASE WHEN v > 0.5 THEN 'volatile' WHEN a > b AND b > c THEN 'bull' WHEN a < b AND b < c THEN 'bear' ELSE 'sideways' END AS regime, round(v, 6) AS vol_20 FROM x")
def w52(spark, d):
    return t.regime(m.monthly_bars(spark, d))


@query("p22_absolute_momentum", f"WITH {MONTHLY}, x AS (SELECT symbol, ts, " + ", ".join(f"close / avg(close) {over(k)} - 1 AS g{k}" for k in (50, 100, 200)) + " FROM bars), y AS (SELECT *, 0.2::DOUBLE * g50 + 0.3::DOUBLE * g100 + 0.5::DOUBLE * g200 AS s FROM x) SELECT symbol, ts, round(s, 6) AS score, ((g50 > 0)::INTEGER + (g100 > 0)::INTEGER + (g200 > 0)::INTEGER)::INTEGER AS above, CASE WHEN s > 0.05 THEN 'strong_up' WHEN s > 0 THEN 'up' WHEN s > -0.05 THEN 'down' ELSE 'strong_down' END AS state FROM y")
def p22(spark, d):
    return t.absolute_momentum(m.monthly_bars(spark, d))


@query("p33_volatility_target", f"WITH {MONTHLY}, {RETURNS}, x AS (SELECT symbol, ts, coalesce(stddev_pop(logret) {over(20)} * sqrt(252), 0.0) AS v FROM r), y AS (SELECT *, greatest(0.5, least(2.0, coalesce(0.15 / nullif(v, 0), 1.0)))::DOUBLE AS q FROM x) SELECT symbol, ts, round(v, 6) AS vol, round(q, 6) AS ratio, round(greatest(0.05, least(0.5, q * 0.25)), 6) AS weight, round(v * 1.645 / sqrt(252), 6) AS var_95 FROM y")
def p33(spark, d):
    return t.volatility_target(m.monthly_bars(spark, d))
