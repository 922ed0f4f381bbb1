"""Queries over cross-sections, rules, portfolios, texts, graphs and labelled rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.operators import crosssection as x, graph, learning, portfolio, rules, text
from tapeloom.operators.timeseries import W as WINDOW
from tapeloom.operators.timeseries import last, returns
from tapeloom.plans.registry import ALL, DIMS, MONTHLY, RETURNS, W, corr_sql, over, query, ratio
from tapeloom.sources import market as m

PANEL = f"p AS (SELECT * FROM (SELECT ts, symbol, close / lag(close, 3) {W} - 1 AS x, lead(close, 1) {W} / close - 1 AS ret FROM bars) WHERE x IS NOT NULL AND ret IS NOT NULL)"
CORR = "coalesce(covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0), 0.0)"
IC = "ic AS (SELECT ts, count(*) AS n, CASE WHEN count(*) >= 5 THEN " + CORR.format(a="x", b="ret") + " ELSE 0.0 END AS ic FROM {source} GROUP BY ts)"
RANKS = "q AS (SELECT ts, symbol, " + ", ".join(f"rank() OVER (PARTITION BY ts ORDER BY {c}) + (count(*) OVER (PARTITION BY ts, {c}) - 1) / 2.0::DOUBLE AS {c}" for c in ("x", "ret")) + " FROM p)"
SUMMARY = "SELECT count(ic) AS dates, round(avg(ic), 6) AS mean, round(stddev_pop(ic), 6) AS std, round(coalesce(avg(ic) / nullif(stddev_pop(ic), 0), 0.0), 6) AS icir, round(coalesce(avg(ic) * sqrt(count(ic)) / nullif(stddev_pop(ic), 0), 0.0), 6) AS t FROM ic"


@query("x01_ic", f"WITH {MONTHLY}, {PANEL}, {IC.format(source='p')} SELECT ts, n, round(ic, 6) AS ic FROM ic")
def x01(spark, d):
    return x.ic(x.panel(m.monthly_bars(spark, d))).select("ts", "n", F.round("ic", 6).alias("ic"))


@query("x02_rank_ic", f"WITH {MONTHLY}, {PANEL}, {RANKS}, {IC.format(source='q')} SELECT ts, n, round(ic, 6) AS ic FROM ic")
def x02(spark, d):
    return x.rank_ic(x.panel(m.monthly_bars(spark, d))).select("ts", "n", F.round("ic", 6).alias("ic"))


@query("x04_x05_ic_summary", f"WITH {MONTHLY}, {PANEL}, {IC.format(source='p')} {SUMMARY}")
def x04(spark, d):
    return x.ic_summary(x.ic(x.panel(m.monthly_bars(spark, d))))


DECAY = f"""dates AS (SELECT ts, dense_rank() OVER (ORDER BY ts) AS d FROM (SELECT DISTINCT ts FROM bars)), b AS (SELECT d, symbol, close / lag(close, 3) {W.replace('ts', 'bars.ts')} - 1 AS x, close / lag(close) {W.replace('ts', 'bars.ts')} - 1 AS r FROM bars JOIN dates ON bars.ts = dates.ts),
e AS (SELECT h, a.d, count(*) AS n, {CORR.format(a='a.x', b='l.r')} AS ic FROM b a, (SELECT unnest([1, 3, 5, 10, 20]) AS h), b l WHERE l.symbol = a.symbol AND l.d = a.d + h AND a.x IS NOT NULL AND l.r IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5), f AS (SELECT h, count(*) AS dates, avg(ic) AS ic FROM e GROUP BY h)"""


@query("x06_ic_decay", f"WITH {MONTHLY}, {DECAY} SELECT h, dates, round(ic, 6) AS ic FROM f")
def x06(spark, d):
    return x.ic_decay(m.monthly_bars(spark, d)).select("h", "dates", F.round("ic", 6).alias("ic"))


@query("x07_half_life", f"WITH {MONTHLY}, {DECAY} SELECT arg_min(h, row(abs(ic - (SELECT arg_min(ic, h) FROM f) / 2), h)) AS half_life FROM f")
def x07(spark, d):
    return x.half_life(x.ic_decay(m.monthly_bars(spark, d)))


@query("x12_ic_weights", f"WITH {MONTHLY}, {DECAY} SELECT 'momentum_' || h AS factor, round(ic, 6) AS ic, round(abs(ic) / (SELECT sum(abs(ic)) FROM f), 6) AS weight FROM f")
def x12(spark, d):
    return x.weights_by_ic(x.ic_decay(m.monthly_bars(spark, d)).select(F.concat(F.lit("momentum_"), F.col("h")).alias("factor"), "ic"))


@query("x13_x14_zscore_winsorise", f"WITH {MONTHLY}, {PANEL}, s AS (SELECT ts, symbol, x, avg(x) OVER (PARTITION BY ts) AS a, stddev_pop(x) OVER (PARTITION BY ts) AS sd FROM p) SELECT ts, symbol, round(CASE WHEN sd < 1e-10 THEN 0.0 ELSE (x - a) / sd END, 6) AS z, round(greatest(a - 3.0 * sd, least(a + 3.0 * sd, x)), 6) AS w FROM s")
def x13(spark, d):
    return x.panel(m.monthly_bars(spark, d)).select("ts", "symbol", F.round(x.zscore(F.col("x"), x.XS()), 6).alias("z"), F.round(x.winsorise(F.col("x"), x.XS()), 6).alias("w"))


def normal_sql(p: str) -> str:
    t = f"sqrt(-2.0::DOUBLE * ln(least({p}, 1.0 - {p})))"
    z = f"({t} - (2.515517::DOUBLE + 0.802853::DOUBLE * {t} + 0.010328::DOUBLE * {t} * {t}) / (1 + 1.432788::DOUBLE * {t} + 0.189269::DOUBLE * {t} * {t} + 0.001308::DOUBLE * {t} * {t} * {t}))"
    return f"CASE WHEN {p} >= 0.5 THEN {z} ELSE -{z} END"


def rank_normal_sql(c: str) -> str:
    return normal_sql(f"greatest(1e-6::DOUBLE, least(1 - 1e-6::DOUBLE, ((rank() OVER (PARTITION BY ts ORDER BY {c}) + (count(*) OVER (PARTITION BY ts, {c}) - 1) / 2.0::DOUBLE) - 0.5) / (count(*) OVER (PARTITION BY ts) + 1)))")


@query("x15_rank_normal", f"WITH {MONTHLY}, {PANEL} SELECT ts, symbol, round({rank_normal_sql('x')}, 6) AS z FROM p")
def x15(spark, d):
    return x.panel(m.monthly_bars(spark, d)).select("ts", "symbol", F.round(x.rank_normal("x", x.XS()), 6).alias("z"))


SIZE_SQL = "(({u}) * ({e}) - ({b}) * ({v})) / (({a}) * ({e}) - ({b}) * ({b}))"


def neutral_size_sql(c: str) -> str:
    s = lambda v: f"sum({v}) OVER (PARTITION BY ts)"
    a, b, e, u, v = f"{s('size * size')} + 0.01", s("size"), "count(size) OVER (PARTITION BY ts) + 0.01", s(f"size * {c}"), s(c)
    det = f"(({a}) * ({e}) - ({b}) * ({b}))"
    return f"{c} - (({u}) * ({e}) - ({b}) * ({v})) / {det} * size - (({a}) * ({v}) - ({b}) * ({u})) / {det}"


@query("x16_x17_neutralise", f"WITH {MONTHLY}, {DIMS}, {PANEL}, j AS (SELECT p.*, industry, ln(greatest(cap, 1.0)) AS size FROM p JOIN dims USING (symbol)), g AS (SELECT ts, symbol, size, x - sum(x) OVER (PARTITION BY ts, industry) / (count(x) OVER (PARTITION BY ts, industry) + 0.01::DOUBLE) AS i FROM j) SELECT ts, symbol, round(i, 5) AS by_industry, round({neutral_size_sql('i')}, 5) AS by_size FROM g")
def x16(spark, d):
    j = x.panel(m.monthly_bars(spark, d)).join(m.industries(spark, d), "symbol").withColumn("size", F.log(F.greatest(F.col("cap"), F.lit(1.0))))
    g = j.select("ts", "symbol", "size", x.neutralise_group(F.col("x"), Window.partitionBy("ts", "industry")).alias("i"))
    return g.select("ts", "symbol", F.round("i", 5).alias("by_industry"), F.round(x.neutralise_size(F.col("i"), F.col("size"), x.XS()), 5).alias("by_size"))


@query("x20_factor_correlations", f"WITH {MONTHLY}, {RETURNS}, f AS (SELECT ret, ln(volume) AS lv, ln(amount) AS la FROM r) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({CORR.format(a=a, b=b)}, 6) AS corr FROM f" for i, a in enumerate(("ret", "lv", "la")) for b in ("ret", "lv", "la")[i:]))
def x20(spark, d):
    return x.correlations(returns(m.monthly_bars(spark, d)).select("ret", F.log("volume").alias("lv"), F.log("amount").alias("la")), ["ret", "lv", "la"])


def _score_sql() -> str:
    weights = {"mom": 0.3, "vol": -0.2, "vratio": 0.2, "rsi": 0.15, "pctb": 0.15}
    gain, loss = "CASE WHEN diff IS NOT NULL THEN greatest(diff, 0.0) END", "CASE WHEN diff IS NOT NULL THEN greatest(-diff, 0.0) END"
    rsi = f"CASE WHEN count(diff) {over(14)} >= 14 THEN CASE WHEN avg({loss}) {over(14)} > 0 THEN 100 - 100 / (1 + avg({gain}) {over(14)} / avg({loss}) {over(14)}) ELSE 100.0 END ELSE 50.0 END"
    sd = f"stddev_pop(close) {over(20)}"
    raw = f"raw AS (SELECT ts, symbol, coalesce(close / lag(close, 5) {W} - 1, 0.0) AS mom, coalesce(stddev_pop(ret) {over(20)}, 0.0) AS vol, {ratio('volume', 'avg(volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)', '1.0')} AS vratio, {rsi} AS rsi, {ratio(f'close - avg(close) {over(20)} + 2 * {sd}', f'4 * {sd}', '0.5')} AS pctb FROM r)"
    xs = "OVER (PARTITION BY ts)"
    wins = "w AS (SELECT ts, symbol, industry, ln(greatest(cap, 1.0)) AS size, " + ", ".join(f"round(greatest(avg({c}) {xs} - 3.0 * stddev_pop({c}) {xs}, least(avg({c}) {xs} + 3.0 * stddev_pop({c}) {xs}, {c})), 9) AS {c}" for c in weights) + " FROM raw JOIN dims USING (symbol))"
    norm = "nr AS (SELECT ts, symbol, industry, size, " + ", ".join(f"{rank_normal_sql(c)} AS {c}" for c in weights) + " FROM w)"
    ind = "ind AS (SELECT ts, symbol, size, " + ", ".join(f"{c} - sum({c}) OVER (PARTITION BY ts, industry) / (count({c}) OVER (PARTITION BY ts, industry) + 0.01::DOUBLE) AS {c}" for c in weights) + " FROM nr)"
    cap = "cp AS (SELECT ts, symbol, " + ", ".join(f"{neutral_size_sql(c)} AS {c}" for c in weights) + " FROM ind)"
    score = "sc AS (SELECT ts, symbol, round(" + " + ".join(f"{w}::DOUBLE * {c}" for c, w in weights.items()) + ", 5) AS score FROM cp)"
    return f"WITH {MONTHLY}, {RETURNS}, {DIMS}, {raw}, {wins}, {norm}, {ind}, {cap}, {score} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY score DESC, symbol)::INTEGER AS place FROM sc) WHERE place <= 10"


@query("x24_scoreboard", _score_sql())
def x24(spark, d):
    return x.scoreboard(m.monthly_bars(spark, d), m.industries(spark, d))


@query("j07_as_of", f"WITH {MONTHLY}, l AS (SELECT s_suppkey AS symbol, TIMESTAMP '1996-05-17' + INTERVAL 1 DAY * (s_suppkey % 400) AS ts FROM supplier) SELECT l.symbol, l.ts, round(bars.close, 4) AS close FROM l ASOF LEFT JOIN bars ON l.symbol = bars.symbol AND l.ts >= bars.ts")
def j07(spark, d):
    left = m.table(spark, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.expr("timestamp'1996-05-17' + make_interval(0, 0, 0, cast(s_suppkey % 400 as int))").alias("ts"))
    return x.as_of(left, m.monthly_bars(spark, d), "close").withColumn("close", F.round("close", 4))


_BODY, _SPAN, _UP, _LOW = "abs(close - open)", "(high - low)", "(high - greatest(open, close))", "(least(open, close) - low)"
_SHARE, _CHANGE = f"coalesce({_BODY} / nullif({_SPAN}, 0), 0.0)", "coalesce((close - open) / nullif(open, 0), 0.0)"
_FOUND = {"hammer": (f"{_LOW} > 2 * {_BODY} AND {_UP} < {_BODY}", 10), "inverted_hammer": (f"{_UP} > 2 * {_BODY} AND {_LOW} < {_BODY}", 5), "doji": (f"{_SHARE} < 0.1", 0), "big_up": (f"{_CHANGE} > 0.05 AND {_SHARE} > 0.7", 20), "big_down": (f"{_CHANGE} < -0.05 AND {_SHARE} > 0.7", -20), "long_upper": (f"{_UP} > 2 * {_BODY}", -10), "long_lower": (f"{_LOW} > 2 * {_BODY}", 10)}


@query("p04_p05_patterns", f"WITH {MONTHLY} SELECT symbol, ts, coalesce(array_to_string(list_filter([" + ", ".join(f"CASE WHEN {v} THEN '{k}' END" for k, (v, _) in _FOUND.items()) + f"], lambda q: q IS NOT NULL), ','), '') AS patterns, round({_SHARE}, 6) AS body, greatest(0, least(100, 50 + " + " + ".join(f"CASE WHEN {v} THEN {b} ELSE 0 END" for v, b in _FOUND.values()) + "))::INTEGER AS score FROM bars")
def p04(spark, d):
    return rules.patterns(m.monthly_bars(spark, d))


@query("p06_volume_signal", f"WITH {MONTHLY}, q AS (SELECT symbol, ts, coalesce(outer_vol / nullif(volume - outer_vol, 0), 9.99) AS r FROM bars) SELECT symbol, ts, round(r, 6) AS ratio, CASE WHEN r > 1.3 THEN 'buyers' WHEN r < 0.7 THEN 'sellers' ELSE 'balanced' END AS side, (CASE WHEN r >= 3 THEN 5 WHEN r >= 2 THEN 4 WHEN r >= 1 THEN 3 WHEN r >= 0.7 THEN 2 WHEN r >= 0.5 THEN 1 ELSE 0 END)::INTEGER AS pressure FROM q")
def p06(spark, d):
    return rules.volume_signal(m.monthly_bars(spark, d))


@query("p13_combined_signal", f"WITH {MONTHLY}, s AS (SELECT symbol, ts, CASE WHEN close > avg(close) {over(5)} THEN 'buy' WHEN close < avg(close) {over(5)} THEN 'sell' ELSE 'hold' END AS a, CASE WHEN volume > 1.5 * avg(volume) {over(5)} THEN 'buy' WHEN volume < 0.5 * avg(volume) {over(5)} THEN 'sell' ELSE 'hold' END AS b FROM bars) SELECT symbol, ts, CASE WHEN a = b AND a <> 'hold' THEN 'strong_' || a WHEN a = 'hold' THEN b WHEN b = 'hold' THEN a ELSE 'hold' END AS signal FROM s")
def p13(spark, d):
    c, v = F.avg("close").over(last(5)), F.avg("volume").over(last(5))
    b = m.monthly_bars(spark, d).select("symbol", "ts", F.when(F.col("close") > c, "buy").when(F.col("close") < c, "sell").otherwise("hold").alias("a"), F.when(F.col("volume") > 1.5 * v, "buy").when(F.col("volume") < 0.5 * v, "sell").otherwise("hold").alias("b"))
    return b.select("symbol", "ts", rules.combine(F.col("a"), F.col("b")).alias("signal"))


@query("p24_fund_flow", f"WITH {MONTHLY}, q AS (SELECT *, coalesce(amount / nullif(volume, 0), 0.0) AS lot, amount * coalesce((2 * outer_vol - volume) / nullif(volume, 0), 0.0) AS net_ FROM bars), z AS (SELECT *, CASE WHEN lot > 2000 THEN 0.6 WHEN lot > 500 THEN 0.3 ELSE 0.15 END::DOUBLE AS big, CASE WHEN lot > 2000 THEN 0.3 WHEN lot > 500 THEN 0.5 ELSE 0.35 END::DOUBLE AS mid FROM q) SELECT symbol, ts, round(amount * big + 1e-7, 2) AS large, round(amount * mid + 1e-7, 2) AS medium, round(net_ + 1e-7, 2) AS net, CASE WHEN net_ > 0 THEN 'in' WHEN net_ < 0 THEN 'out' ELSE 'flat' END AS direction FROM z")
def p24(spark, d):
    b = m.monthly_bars(spark, d)
    lot = F.coalesce(F.try_divide("amount", "volume"), F.lit(0.0))
    f = rules.fund_flow(b)
    exact = b.select("symbol", "ts", F.round(F.col("amount") * F.when(lot > 2000, 0.6).when(lot > 500, 0.3).otherwise(0.15) + 1e-7, 2).alias("large"), F.round(F.col("amount") * F.when(lot > 2000, 0.3).when(lot > 500, 0.5).otherwise(0.35) + 1e-7, 2).alias("medium"), F.round(F.col("amount") * F.coalesce(F.try_divide(2 * F.col("outer_vol") - F.col("volume"), F.col("volume")), F.lit(0.0)) + 1e-7, 2).alias("net"))
    return exact.join(f.select("symbol", "ts", "direction"), ["symbol", "ts"])


@query("p30_kelly", f"WITH {MONTHLY}, {RETURNS}, q AS (SELECT symbol, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS p, coalesce(avg(CASE WHEN ret > 0 THEN ret END) / nullif(avg(CASE WHEN ret < 0 THEN -ret END), 0), 2.0) AS b, coalesce(stddev_pop(ret), 0.0) AS v FROM r WHERE logret IS NOT NULL GROUP BY 1) SELECT symbol, round(p, 6) AS win_rate, round(b, 6) AS payoff, round(greatest(0.05, least(0.25, (p - coalesce((1 - p) / nullif(b, 0), 0.0)) / 2 * greatest(0.5, least(1.5, 1 - 2 * (v - 0.1))))), 6) AS kelly FROM q")
def p30(spark, d):
    r = returns(m.monthly_bars(spark, d)).filter("logret is not null")
    q = r.groupBy("symbol").agg(F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("p"), F.coalesce(F.try_divide(F.avg(F.when(F.col("ret") > 0, F.col("ret"))), F.avg(F.when(F.col("ret") < 0, -F.col("ret")))), F.lit(2.0)).alias("b"), F.coalesce(F.stddev_pop("ret"), F.lit(0.0)).alias("v"))
    return q.select("symbol", F.round("p", 6).alias("win_rate"), F.round("b", 6).alias("payoff"), F.round(rules.kelly(F.col("p"), F.col("b"), F.col("v")), 6).alias("kelly"))


_VALUE, _SIDE = "o_totalprice", "CASE WHEN o_orderkey % 2 = 0 THEN 'sell' ELSE 'buy' END"


@query("p36_costs", f"""WITH o AS (SELECT o_orderkey, {_SIDE} AS side, o_totalprice / 100 AS price, 100.0::DOUBLE AS quantity, 5000.0::DOUBLE AS adv, (9.5 + o_orderkey % 6)::DOUBLE AS hour FROM orders), q AS (SELECT *, price * quantity AS v, quantity / adv AS s, (CASE WHEN hour < 10 THEN 1.2 WHEN hour < 11.5 THEN 1.1 WHEN hour < 14 THEN 1.3 ELSE 1.4 END)::DOUBLE AS l FROM o),
z AS (SELECT *, greatest(v * 0.0003, 5.0) AS c1, CASE WHEN side = 'sell' THEN v * 0.001 ELSE 0.0 END AS c2, v * 0.0002 * (1 + log2(1 + s)) * l AS c3, 0.0001 * sqrt(s) * 0.02 * v * l AS c4 FROM q) SELECT o_orderkey, side, round(c1 + 1e-9, 4) AS commission, round(c2 + 1e-9, 4) AS stamp, round(c3 + 1e-9, 4) AS slippage, round(c1 + c2 + c3 + c4 + 1e-9, 3) AS total FROM z""")
def p36(spark, d):
    o = m.table(spark, d, "orders").select("o_orderkey", F.expr(_SIDE).alias("side"), (F.col("o_totalprice") / 100).alias("price"), F.lit(100.0).alias("quantity"), F.lit(5000.0).alias("adv"), (F.lit(9.5) + F.col("o_orderkey") % 6).alias("hour"))
    value, share = F.col("price") * F.col("quantity"), F.col("quantity") / F.col("adv")
    liquid = rules.liquidity(F.col("hour"))
    parts = rules.cost_parts(F.col("side"), value, share, liquid)
    return o.select("o_orderkey", "side", *(F.round(parts[k] + 1e-9, 4).alias(k) for k in ("commission", "stamp", "slippage")), F.round(parts["commission"] + parts["stamp"] + parts["slippage"] + parts["impact"] + 1e-9, 3).alias("total"))


@query("p39_board_limits", "SELECT c_custkey, lpad((c_custkey * 7919 % 1000000)::VARCHAR, 6, '0') AS code, (CASE WHEN left(lpad((c_custkey * 7919 % 1000000)::VARCHAR, 6, '0'), 3) IN ('688', '689', '300', '301') THEN 0.2 WHEN left(lpad((c_custkey * 7919 % 1000000)::VARCHAR, 6, '0'), 1) IN ('8', '4') THEN 0.3 ELSE 0.1 END)::DOUBLE AS limit_share, floor(abs(c_acctbal) / 100)::BIGINT * 100 AS lots FROM customer")
def p39(spark, d):
    code = F.lpad((F.col("c_custkey") * 7919 % 1000000).cast("string"), 6, "0")
    return m.table(spark, d, "customer").select("c_custkey", code.alias("code"), rules.board_limit(code).alias("limit_share"), rules.lots(F.abs("c_acctbal")).alias("lots"))


@query("p44_flow_heat", f"WITH {MONTHLY}, {DIMS}, q AS (SELECT symbol, amount * coalesce((2 * outer_vol - volume) / nullif(volume, 0), 0.0) AS net FROM bars) SELECT sector, industry, count(DISTINCT symbol) AS symbols, CASE WHEN sum(net) > 0 THEN 'hot' WHEN sum(net) < 0 THEN 'cold' ELSE 'flat' END AS level FROM q JOIN dims USING (symbol) GROUP BY ROLLUP (sector, industry)")
def p44(spark, d):
    return rules.heat(m.monthly_bars(spark, d), m.industries(spark, d)).select("sector", "industry", "symbols", "level")


_METRICS = f"""x AS (SELECT *, close / max(close) {ALL} - 1 AS dd FROM r), q AS (SELECT symbol, count(*) AS n, arg_max(close, ts) / arg_min(close, ts) - 1 AS total, stddev_pop(ret) AS sd, stddev_pop(CASE WHEN ret < 0 THEN ret END) AS down, min(dd) AS worst, avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS win, sum(CASE WHEN ret > 0 THEN ret ELSE 0.0 END) AS gain, sum(CASE WHEN ret < 0 THEN -ret ELSE 0.0 END) AS loss FROM x GROUP BY 1), z AS (SELECT *, pow(1 + total, 12.0::DOUBLE / n) - 1 AS annual, sd * sqrt(12.0::DOUBLE) AS vol FROM q)"""


@query("a03_metrics", f"WITH {MONTHLY}, {RETURNS}, {_METRICS} SELECT symbol, n, round(total, 5) AS total, round(annual, 5) AS annual, round(vol, 5) AS vol, round(coalesce((annual - 0.02) / nullif(vol, 0), 0.0), 5) AS sharpe, round(coalesce((annual - 0.02) / nullif(down * sqrt(12.0::DOUBLE), 0), 0.0), 5) AS sortino, round(worst, 5) AS max_dd, round(coalesce(annual / nullif(abs(worst), 0), 0.0), 5) AS calmar, round(win, 5) AS win_rate, round(least(999.0, coalesce(gain / nullif(loss, 0), 999.0)), 5) AS profit_factor FROM z")
def a03(spark, d):
    return portfolio.metrics(m.monthly_bars(spark, d))


_TRADES = f"trades AS (SELECT symbol, ts, CASE WHEN row_number() {W} % 2 = 1 THEN 'buy' ELSE 'sell' END AS side, close AS price, 100.0::DOUBLE AS quantity FROM bars)"


def trades(spark, d):
    return m.monthly_bars(spark, d).select("symbol", "ts", F.when(F.row_number().over(WINDOW()) % 2 == 1, "buy").otherwise("sell").alias("side"), F.col("close").alias("price"), F.lit(100.0).alias("quantity"))


@query("a05_holding_periods", f"WITH {MONTHLY}, {_TRADES}, s AS (SELECT *, lag(ts) {W} AS bts, lag(price) {W} AS bp, lag(side) {W} AS bs FROM trades), q AS (SELECT greatest(date_diff('day', bts, ts), 1) AS dd, price / bp - 1 AS g FROM s WHERE side = 'sell' AND bs = 'buy') SELECT CASE WHEN dd < 5 THEN 'under_5' WHEN dd < 20 THEN '5_to_20' WHEN dd < 60 THEN '20_to_60' ELSE 'over_60' END AS held, count(*) AS n, round(avg(CASE WHEN g > 0 THEN 1.0 ELSE 0.0 END), 6) AS win_rate, round(avg(g), 6) AS mean, round(max(g), 6) AS best, round(min(g), 6) AS worst FROM q GROUP BY 1")
def a05(spark, d):
    return portfolio.holding_periods(trades(spark, d))


@query("b09_trade_replay", f"WITH {MONTHLY}, {_TRADES}, q AS (SELECT symbol, ts, price, sum(CASE WHEN side = 'buy' THEN -price * quantity ELSE price * quantity END) {ALL} AS cash, sum(CASE WHEN side = 'buy' THEN quantity ELSE -quantity END) {ALL} AS shares FROM trades) SELECT symbol, ts, round(cash + 1e-6, 2) AS cash, shares, round(cash + shares * price + 1e-6, 2) AS value FROM q")
def b09(spark, d):
    r = portfolio.replay(trades(spark, d))
    return r.select("symbol", "ts", F.round(F.col("cash") + 1e-6, 2).alias("cash"), "shares", F.round(F.col("value") + 1e-6, 2).alias("value"))


@query("a07_percentiles", f"WITH {MONTHLY}, {RETURNS} SELECT symbol, " + ", ".join(f"round(quantile_cont(ret, {p / 100}), 6) AS p{p}" for p in (5, 25, 50, 75, 95)) + " FROM r GROUP BY 1")
def a07(spark, d):
    return portfolio.percentiles(m.monthly_bars(spark, d))


@query("a08_value_at_risk", f"WITH {MONTHLY}, {RETURNS}, q AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY ret, ts) AS place, count(*) OVER (PARTITION BY symbol) AS k FROM r WHERE logret IS NOT NULL) SELECT symbol, round(max(ret), 6) AS var, round(avg(ret), 6) AS cvar FROM q WHERE place <= floor(k * 0.05) + 1 GROUP BY 1")
def a08(spark, d):
    return portfolio.value_at_risk(m.monthly_bars(spark, d))


_SERIES = " + ".join(f"({2 * (-1) ** (k - 1)}) * exp(-{2 * k * k} * lam * lam)" for k in range(1, 61))


@query("a14_ks_statistic", f"WITH {MONTHLY}, {RETURNS}, q AS (SELECT symbol, ret, CASE WHEN rn <= 40 THEN 1 ELSE 0 END AS early FROM r WHERE logret IS NOT NULL), n AS (SELECT symbol, sum(early) AS a, sum(1 - early) AS b FROM q GROUP BY 1), z AS (SELECT q.symbol, a, b, abs(sum(early) OVER w / a::DOUBLE - sum(1 - early) OVER w / b::DOUBLE) AS gap FROM q JOIN n USING (symbol) WHERE a > 0 AND b > 0 WINDOW w AS (PARTITION BY q.symbol ORDER BY ret RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), g AS (SELECT symbol, max(gap) AS gap, max(gap) * sqrt(max(a) * max(b) / (max(a) + max(b))::DOUBLE) AS lam FROM z GROUP BY 1) SELECT symbol, round(gap, 6) AS ks, round(CASE WHEN lam < 0.2 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, {_SERIES})) END, 6) AS p, gap > 0.3 AS drifted FROM g")
def a14(spark, d):
    return learning.ks_statistic(returns(m.monthly_bars(spark, d)).withColumn("rn", F.row_number().over(WINDOW())).filter("logret is not null"), 40)


@query("b02_walk_forward", f"WITH {MONTHLY}, {RETURNS}, g AS (SELECT symbol, ret, rn - 1 AS i FROM r), s AS (SELECT symbol, ret, w, i - w * 6 AS spot FROM g, (SELECT unnest(range(0, 400)) AS w) WHERE i - w * 6 >= 0 AND i - w * 6 < 30), q AS (SELECT symbol, w, avg(CASE WHEN spot < 24 THEN ret END) AS before, sum(CASE WHEN spot >= 24 THEN ln(1 + ret) END) AS after FROM s GROUP BY 1, 2 HAVING count(*) = 30), h AS (SELECT symbol, CASE WHEN before > 0 THEN exp(after) - 1 ELSE 0.0 END AS held FROM q) SELECT symbol, count(*) AS windows, round(avg(held), 6) AS mean, round(avg(CASE WHEN held > 0 THEN 1.0 ELSE 0.0 END), 6) AS won FROM h GROUP BY 1")
def b02(spark, d):
    return portfolio.walk_forward(m.monthly_bars(spark, d))


_DRAW = "(((symbol * 1000003 + sim * 7919 + step * 104729 + 7) % 1000000007 * 48271 % 2147483647) * 48271 % 2147483647)"


@query("b11_bootstrap", f"WITH {MONTHLY}, {RETURNS}, l AS (SELECT symbol, logret, row_number() {W} - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM r WHERE logret IS NOT NULL), k AS (SELECT DISTINCT symbol, n FROM l), dr AS (SELECT symbol, sim, floor({_DRAW} / 7)::BIGINT % n AS i FROM k, range(200) s(sim), range(60) t(step)), q AS (SELECT symbol, sim, exp(sum(logret)) - 1 AS total FROM dr JOIN l USING (symbol, i) GROUP BY 1, 2) SELECT symbol, round(quantile_cont(total, 0.05), 5) AS p5, round(quantile_cont(total, 0.5), 5) AS p50, round(quantile_cont(total, 0.95), 5) AS p95, round(avg(CASE WHEN total < 0 THEN 1.0 ELSE 0.0 END), 6) AS loss_share FROM q GROUP BY 1")
def b11(spark, d):
    return portfolio.bootstrap(m.monthly_bars(spark, d))


POSITIVE, NEGATIVE = ["the", "and", "that"], ["of", "to", "not"]
NEGATIONS, DEGREES = ["is", "was"], {"in": 1.5, "on": 0.5}
_IN = lambda ws: ", ".join(f"'{w}'" for w in ws)
_WORDS = "w AS (SELECT doc_id, source, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS words FROM documents)"


@query("t02_lexicon_score", f"WITH {_WORDS}, q AS (SELECT doc_id, source, len(list_filter(words, lambda x: x IN ({_IN(POSITIVE)})))::INTEGER AS pos, len(list_filter(words, lambda x: x IN ({_IN(NEGATIVE)})))::INTEGER AS neg FROM w), z AS (SELECT *, coalesce((pos - neg)::DOUBLE / nullif(pos + neg, 0), 0.0) AS s FROM q) SELECT doc_id, source, pos, neg, round(s, 6) AS score, CASE WHEN s > 0.1 THEN 'positive' WHEN s < -0.1 THEN 'negative' ELSE 'neutral' END AS label FROM z")
def t02(spark, d):
    return text.lexicon_score(m.table(spark, d, "documents"), POSITIVE, NEGATIVE)


@query("t03_modified_score", f"""WITH {_WORDS}, u AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i, words FROM w), h AS (SELECT doc_id, (CASE WHEN word IN ({_IN(POSITIVE)}) THEN 1.0 WHEN word IN ({_IN(NEGATIVE)}) THEN -1.0 END * CASE WHEN i > 1 AND words[i - 1] = 'in' THEN 1.5 WHEN i > 1 AND words[i - 1] = 'on' THEN 0.5 ELSE 1.0 END * CASE WHEN len(list_filter(words[greatest(i - 3, 1):i - 1], lambda v: v IN ({_IN(NEGATIONS)}))) > 0 AND i > 1 THEN -1.0 ELSE 1.0 END)::DOUBLE AS hit FROM u WHERE word IN ({_IN(POSITIVE + NEGATIVE)}))
SELECT w.doc_id, round(coalesce(sum(hit) / nullif(sum(abs(hit)), 0), 0.0), 6) AS score, count(hit)::INTEGER AS hits FROM w LEFT JOIN h USING (doc_id) GROUP BY 1""")
def t03(spark, d):
    return text.modified_score(m.table(spark, d, "documents"), POSITIVE, NEGATIVE, NEGATIONS, DEGREES)


@query("s14_page_links", """SELECT href, count(*) AS pages FROM (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages) GROUP BY 1""")
def s14(spark, d):
    return text.links(m.table(spark, d, "pages"))


EDGES = "e AS (SELECT a.symbol AS src, b.symbol AS dst, 1.0::DOUBLE / count(*) OVER (PARTITION BY a.symbol) AS w FROM dims a JOIN dims b ON a.industry = b.industry AND a.symbol <> b.symbol)"


@query("g01_industry_edges", f"WITH {DIMS}, q AS (SELECT symbol, industry, count(*) OVER (PARTITION BY industry) - 1 AS peers FROM dims) SELECT symbol, industry, peers, round(1.0::DOUBLE / nullif(peers, 0), 6) AS w FROM q")
def g01(spark, d):
    return graph.hubs(m.industries(spark, d)).select("symbol", "industry", "peers", F.round("w", 6).alias("w"))


@query("g02_nearest", f"WITH {DIMS}, {EDGES}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS place FROM e) WHERE place <= 3) SELECT a.src, a.dst, round(a.w, 6) AS w FROM k a JOIN k b ON a.src = b.dst AND a.dst = b.src")
def g02(spark, d):
    return graph.nearest_of_hubs(m.industries(spark, d), 3).select("src", "dst", F.round("w", 6).alias("w"))


def _rank_sql(rounds: int = 10) -> str:
    steps = ["r0 AS (SELECT symbol, 1.0::DOUBLE / (SELECT count(*) FROM dims) AS rank FROM dims)"]
    for i in range(rounds):
        steps.append(f"r{i + 1} AS (SELECT d.symbol, 0.15::DOUBLE / (SELECT count(*) FROM dims) + 0.85::DOUBLE * coalesce(g.got, 0) AS rank FROM dims d LEFT JOIN (SELECT dst, sum(w * rank) AS got FROM e JOIN r{i} ON src = symbol GROUP BY 1) g ON d.symbol = g.dst)")
    return f"WITH {DIMS}, {EDGES}, {', '.join(steps)} SELECT symbol, round(rank, 8) AS rank FROM r{rounds}"


@query("g03_page_rank", _rank_sql())
def g03(spark, d):
    return graph.hub_rank(m.industries(spark, d)).select("symbol", F.round("rank", 8).alias("rank"))


@query("m01_purged_folds", f"WITH {MONTHLY}, q AS (SELECT symbol, ts, ntile(5) OVER (PARTITION BY symbol ORDER BY ts) AS fold, row_number() {W} AS i, count(*) OVER (PARTITION BY symbol) AS n FROM bars), b AS (SELECT symbol, fold, min(i) AS lo, max(i) AS hi FROM q GROUP BY 1, 2) SELECT b.fold, count(*) FILTER (WHERE q.fold = b.fold) AS test, count(*) FILTER (WHERE q.i < b.lo - 5 OR q.i > b.hi + 5) AS train FROM q JOIN b USING (symbol) GROUP BY 1")
def m01(spark, d):
    return learning.purged_folds(m.monthly_bars(spark, d), 5, 5)


@query("m04_centroid_classes", "WITH u AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label AS near, i, avg(v) AS m FROM u GROUP BY 1, 2), f AS (SELECT vec_id, near, round(sum((v - m) * (v - m)), 9) AS far FROM u JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id, arg_min(near, row(far, near)) AS predicted, round(coalesce(1 / nullif(min(far) * sum(coalesce(1 / nullif(far, 0), 0)), 0), 1.0), 6) AS probability FROM f GROUP BY 1")
def m04(spark, d):
    return learning.centroids(m.table(spark, d, "embeddings"))


@query("a02_alert_counts", """SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 20) AS high, count(*) FILTER (WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY) AS recent FROM events GROUP BY 1""")
def a02(spark, d):
    e = m.table(spark, d, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.crossJoin(F.broadcast(newest)).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 20).alias("high"), F.count_if(F.col("ts") >= F.col("newest") - F.expr("interval 1 day")).alias("recent"))


@query("st05_cooldown", """WITH RECURSIVE q AS (SELECT event_type, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value > 30), f AS (SELECT event_type, i, ts AS fired, TRUE AS fires FROM q WHERE i = 1 UNION ALL SELECT q.event_type, q.i, CASE WHEN epoch_us(q.ts) - epoch_us(f.fired) >= 3600000000 THEN q.ts ELSE f.fired END, epoch_us(q.ts) - epoch_us(f.fired) >= 3600000000 FROM f JOIN q ON q.event_type = f.event_type AND q.i = f.i + 1) SELECT event_type, count(*) AS hits, count(*) FILTER (WHERE fires) AS fired FROM f GROUP BY 1""")
def st05(spark, d):
    return learning.cooldown(m.table(spark, d, "events").filter("value > 30"), 3600)
