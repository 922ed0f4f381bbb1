"""Queries of factor models over a snapshot's bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.functions.safe import deviation_agg, div
from tapeloom.operators import crosssection as x
from tapeloom.operators import factors, timeseries
from tapeloom.operators.timeseries import W as BY_SYMBOL
from tapeloom.plans.ladders import SNAP, snap
from tapeloom.plans.panels import CORR, neutral_size_sql, rank_normal_sql
from tapeloom.plans.registry import DIMS, MONTHLY, RETURNS, W, corr_sql, over, query
from tapeloom.sources import market as m

A, B, C = factors.FACTORS
NEXT = f"nx AS (SELECT * FROM (SELECT *, lead(close) {W} / close - 1 AS ret_next FROM snap) WHERE ret_next IS NOT NULL AND " + " AND ".join(f"{c} IS NOT NULL" for c in factors.MORE) + ")"
LONG = "lf AS (" + " UNION ALL ".join(f"SELECT '{c}' AS factor, symbol, ts, {c} AS x, ret_next AS ret FROM nx" for c in factors.MORE) + ")"
ICS = "ics AS (SELECT factor, ts, count(*) AS n, " + CORR.format(a="x", b="ret") + " AS ic, stddev_pop(ret) AS ret_sd FROM lf GROUP BY 1, 2 HAVING count(*) >= 5)"
RANKED = "rk AS (SELECT factor, ic, icir, row_number() OVER (ORDER BY abs(icir) DESC, factor) AS place FROM (SELECT factor, avg(ic) AS ic, coalesce(avg(ic) / nullif(stddev_pop(ic), 0), 0.0) AS icir FROM ics GROUP BY 1))"


def following(spark: SparkSession, d: str) -> DataFrame:
    return factors.with_forward(snap(spark, d), *factors.MORE)


FUND = """items AS (SELECT l_suppkey AS symbol, year(l_shipdate) AS y, l_extendedprice * (1 - l_discount) AS revenue, l_extendedprice * (1 - l_discount) * (1 - l_tax) AS profit, CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0 END AS returned, l_extendedprice AS amount_ FROM lineitem),
ly AS (SELECT max(y) - 1 AS ly FROM items),
fin AS (SELECT symbol, sum(profit) / 1e5 AS earnings, sum(returned) / sum(amount_) * 100 AS debt, coalesce((sum(CASE WHEN y = ly THEN revenue END) / nullif(sum(CASE WHEN y = ly - 1 THEN revenue END), 0) - 1) * 100, 0.0) AS growth FROM items, ly GROUP BY 1),
val AS (SELECT symbol, industry, cap, cap / nullif(earnings, 0) * 10 AS pe, cap / nullif(earnings, 0) AS pb, earnings / nullif(abs(cap), 0) * 100 AS roe, growth, debt FROM dims JOIN fin USING (symbol))"""


def financials(spark: SparkSession, d: str) -> DataFrame:
    """A supplier's earnings, debt and growth from its items, and what follows from them and its cap."""
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    items = m.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("symbol"), F.year("l_shipdate").alias("y"), price.alias("revenue"), (price * (1 - F.col("l_tax"))).alias("profit"), F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0).alias("returned"), F.col("l_extendedprice").alias("amount_"))
    years = items.groupBy("symbol", "y").agg(*(F.sum(c).alias(c) for c in ("revenue", "profit", "returned", "amount_")))
    latest = years.agg((F.max("y") - 1).alias("ly"))
    of = lambda y: F.sum(F.when(F.col("y") == y, F.col("revenue")))
    fin = years.crossJoin(F.broadcast(latest)).groupBy("symbol").agg((F.sum("profit") / 1e5).alias("earnings"), (F.sum("returned") / F.sum("amount_") * 100).alias("debt"), F.coalesce((F.try_divide(of(F.col("ly")), of(F.col("ly") - 1)) - 1) * 100, F.lit(0.0)).alias("growth"))
    cap, earned = F.col("cap"), F.col("earnings")
    return m.industries(spark, d).join(fin, "symbol").select("symbol", "industry", "cap", (F.try_divide(cap, earned) * 10).alias("pe"), F.try_divide(cap, earned).alias("pb"), (F.try_divide(earned, F.abs(cap)) * 100).alias("roe"), "growth", "debt")


_RICH = f"{SNAP}, {DIMS}, {FUND}, rich AS (SELECT *, coalesce(close / lag(close, 60) {W} - 1, 0.0) AS mom60, coalesce((diff - lag(diff, 5) {W}) / 5 / 1e5, 0.0) AS hist_slope FROM snap JOIN val USING (symbol))"


def rich(spark: SparkSession, d: str) -> DataFrame:
    rows = snap(spark, d).join(financials(spark, d), "symbol")
    return rows.withColumns({"mom60": F.coalesce(F.try_divide(F.col("close"), F.lag("close", 60).over(BY_SYMBOL())) - 1, F.lit(0.0)), "hist_slope": F.coalesce((F.col("diff") - F.lag("diff", 5).over(BY_SYMBOL())) / 5 / 1e5, F.lit(0.0))})


def register(name: str, with_sql: str, source: str, rows, rule, *keys: str) -> None:
    query(name, f"WITH {with_sql} " + rule.sql(source, *keys))(lambda spark, d: rule.apply(rows(spark, d), *keys))


register("x24_x25_multi_factor", _RICH, "rich", rich, factors.MULTI_FACTOR, "symbol", "ts")
register("x27_styles", _RICH, "rich", rich, factors.STYLES, "symbol", "ts")

_Z = "zs AS (SELECT *, " + ", ".join(f"CASE WHEN stddev_pop({c}) OVER (PARTITION BY ts) < 1e-10 THEN 0.0 ELSE coalesce(({c} - avg({c}) OVER (PARTITION BY ts)) / nullif(stddev_pop({c}) OVER (PARTITION BY ts), 0), 0.0) END AS z_{c}" for c in factors.V1_WEIGHTS) + " FROM snap)"
register("x26_multi_factor_v1", f"{SNAP}, {_Z}", "zs", lambda s, d: factors.zscores(snap(s, d)), factors.V1, "symbol", "ts")


@query("x09_factor_ranking", f"WITH {SNAP}, {NEXT}, {LONG}, {ICS}, {RANKED} SELECT factor, round(ic, 6) AS ic, round(icir, 5) AS icir, place::INTEGER AS place FROM rk")
def x09(spark, d):
    return factors.ranked(factors.ics(factors.long_form(following(spark, d)))).select("factor", F.round("ic", 6).alias("ic"), F.round("icir", 5).alias("icir"), "place")


@query("x29_top_factors", f"WITH {SNAP}, {NEXT}, {LONG}, {ICS}, {RANKED} SELECT factor, place::INTEGER AS place, abs(ic) >= 0.02 AS above FROM rk WHERE place <= 3")
def x29(spark, d):
    return factors.ranked(factors.ics(factors.long_form(following(spark, d)))).filter("place <= 3").select("factor", "place", (F.abs("ic") >= 0.02).alias("above"))


@query("x30_factor_evaluation", f"WITH {SNAP}, {NEXT}, {LONG}, {ICS} SELECT factor, count(*) AS dates, round(avg(ic), 6) AS ic, round(avg(coalesce(ic / nullif(ret_sd, 0), 0.0)), 5) AS ic_by_ret, round(abs(avg(ic)), 6) AS efficacy FROM ics GROUP BY 1")
def x30(spark, d):
    one = factors.ics(factors.long_form(following(spark, d)))
    return one.groupBy("factor").agg(F.count("*").alias("dates"), F.round(F.avg("ic"), 6).alias("ic"), F.round(F.avg(F.coalesce(F.try_divide("ic", "ret_sd"), F.lit(0.0))), 5).alias("ic_by_ret"), F.round(F.abs(F.avg("ic")), 6).alias("efficacy"))


_ALONG = lambda c: f"coalesce(covar_pop({c}, ret_next) / nullif(stddev_pop({c}), 0), 0.0)"
_MOMENTS = f"mo AS (SELECT ts, count(*) AS n, {CORR.format(a=A, b=B)} AS r12, {CORR.format(a=A, b=C)} AS r13, {CORR.format(a=B, b=C)} AS r23, {_ALONG(A)} AS y1, {_ALONG(B)} AS y2, {_ALONG(C)} AS y3, var_pop(ret_next) AS vy FROM nx GROUP BY 1)"


@query("x08_fama_macbeth", f"WITH {SNAP}, {NEXT}, {_MOMENTS}, rg AS ({factors.REGRESSION.sql('mo')}) " + " UNION ALL ".join(f"SELECT '{name}' AS factor, count(*) AS dates, round(avg(b{k}), 6) AS slope, round(avg(t{k}), 5) AS t FROM rg" for k, name in enumerate(factors.FACTORS, 1)))
def x08(spark, d):
    return factors.mean_slopes(factors.REGRESSION.apply(factors.regression_moments(following(spark, d))))


_PAIRS = "pc AS (SELECT " + ", ".join(f"{CORR.format(a=factors.MORE[i], b=factors.MORE[j])} AS c{i}{j}" for j in range(5) for i in range(j)) + " FROM nx)"
register("x11_uncorrelated_factors", f"{SNAP}, {NEXT}, {_PAIRS}", "pc", lambda s, d: factors.pair_correlations(following(s, d)), factors.GREEDY)

_GRAM = lambda source, keys="": f"gm AS (SELECT {keys + ', ' if keys else ''}count(*) AS n, " + ", ".join(f"sum({p} * {q}) AS {s}" for s, p, q in (("s11", A, A), ("s12", A, B), ("s13", A, C), ("s22", B, B), ("s23", B, C), ("s33", C, C))) + f" FROM {source}{' GROUP BY ' + keys if keys else ''})"
register("x21_c34_gram_schmidt", f"{SNAP}, {NEXT}, {_GRAM('nx')}", "gm", lambda s, d: factors.gram(following(s, d)), factors.GRAM_SCHMIDT)
register("x22_inflation", f"{SNAP}, {NEXT}, {_GRAM('nx')}", "gm", lambda s, d: factors.gram(following(s, d)), factors.INFLATION)
register("x18_orthogonal", f"{SNAP}, {NEXT}, {_GRAM('nx', 'ts')}, og AS (SELECT * FROM nx JOIN gm USING (ts))", "og", lambda s, d: factors.orthogonal(following(s, d)), factors.ORTHOGONAL, "symbol", "ts")


@query("x23_orthogonal_weights", f"WITH {SNAP}, {NEXT}, {_GRAM('nx', 'ts')}, og AS (SELECT * FROM nx JOIN gm USING (ts)), q AS ({factors.ORTHOGONAL.sql('og', 'symbol', 'ts')}), w AS (SELECT " + ", ".join(f"abs(avg(q{k}) / nullif(stddev_pop(q{k}), 0)) AS w{k}" for k in (1, 2, 3)) + " FROM q) SELECT " + ", ".join(f"round(w{k} / (w1 + w2 + w3), 4) AS w{k}" for k in (1, 2, 3)) + " FROM w")
def x23(spark, d):
    q = factors.ORTHOGONAL.apply(factors.orthogonal(following(spark, d)), "symbol", "ts")
    w = q.agg(*(F.abs(F.try_divide(F.avg(f"q{k}"), F.stddev_pop(f"q{k}"))).alias(f"w{k}") for k in (1, 2, 3)))
    total = F.col("w1") + F.col("w2") + F.col("w3")
    return w.select(*(F.round(F.col(f"w{k}") / total, 4).alias(f"w{k}") for k in (1, 2, 3)))


_WIN = lambda c: f"round(greatest(avg({c}) OVER (PARTITION BY ts) - 3.0 * stddev_pop({c}) OVER (PARTITION BY ts), least(avg({c}) OVER (PARTITION BY ts) + 3.0 * stddev_pop({c}) OVER (PARTITION BY ts), {c})), 9)"
_F3 = factors.FACTORS
_PIPE = f"""{SNAP}, {NEXT}, {DIMS}, w1 AS (SELECT ts, symbol, industry, ln(greatest(cap, 1.0)) AS size, {", ".join(f"{_WIN(c)} AS {c}" for c in _F3)} FROM nx JOIN dims USING (symbol)),
w2 AS (SELECT ts, symbol, industry, size, {", ".join(f"{rank_normal_sql(c)} AS {c}" for c in _F3)} FROM w1),
w3 AS (SELECT ts, symbol, size, {", ".join(f"{c} - sum({c}) OVER (PARTITION BY ts, industry) / (count({c}) OVER (PARTITION BY ts, industry) + 0.01::DOUBLE) AS {c}" for c in _F3)} FROM w2),
w4 AS (SELECT ts, symbol, {", ".join(f"{neutral_size_sql(c)} AS {c}" for c in _F3)} FROM w3), {_GRAM('w4', 'ts')}, og AS (SELECT * FROM w4 JOIN gm USING (ts) WHERE n >= 5)"""


def normalised(spark: SparkSession, d: str) -> DataFrame:
    """Winsorised, brought to normal ranks, and neutral to industry and size."""
    j = following(spark, d).join(m.industries(spark, d), "symbol").withColumn("size", F.log(F.greatest(F.col("cap"), F.lit(1.0))))
    return x.neutral_normal(j.select("ts", "symbol", "industry", "size", *_F3), _F3)


register("x19_normalised_factors", _PIPE, "og", lambda s, d: factors.orthogonal(normalised(s, d)).filter("n >= 5"), factors.ORTHOGONAL, "symbol", "ts")


@query("x28_fused_vector", f"WITH {SNAP}, {NEXT}, q AS (SELECT symbol, ts, " + ", ".join(f"coalesce(({c} - min({c}) OVER (PARTITION BY ts)) / nullif(max({c}) OVER (PARTITION BY ts) - min({c}) OVER (PARTITION BY ts), 0), 0.5) AS v_{c}" for c in _F3) + " FROM nx), l AS (SELECT *, sqrt(" + " + ".join(f"v_{c} * v_{c}" for c in _F3) + ") AS norm FROM q) SELECT symbol, ts, " + ", ".join(f"round(coalesce(v_{c} / nullif(norm, 0), 0.0), 6) AS v_{c}" for c in _F3) + " FROM l")
def x28(spark, d):
    return factors.fused(following(spark, d))


_CALLS = "cl AS (" + " UNION ALL ".join(f"SELECT '{k}' AS model, sign({v}) AS call, least(1.0, {s}) AS sure, ret_next FROM nx" for k, v, s in (("momentum", "mom5", "abs(mom5)"), ("reversal", "-change", "abs(change) / 100"), ("strength", "rsi14 - 50", "abs(rsi14 - 50) / 50"))) + ")"


@query("x32_a15_model_ranking", f"WITH {SNAP}, {NEXT}, {_CALLS}, h AS (SELECT *, CASE WHEN call = sign(ret_next) THEN 1.0 ELSE 0.0 END AS hit FROM cl) SELECT model, count(*) AS n, round(avg(hit), 6) AS accuracy, round(avg(CASE WHEN call <> 0 THEN hit END), 6) AS hit_rate, round(avg(sure), 6) AS sure, round({CORR.format(a='call', b='ret_next')}, 6) AS ic FROM h GROUP BY 1")
def x32(spark, d):
    return factors.model_ranking(factors.calls(following(spark, d)))


#: Names of all windowed factors: inputs, operations and periods, and correlations of pairs.
PERIODS, INPUTS, OPERATIONS = (2, 3, 5, 10, 15, 20, 25, 30, 45, 60), ("open", "high", "low", "close", "volume", "amount"), ("delta", "max", "min", "mean", "sum", "std")


@query("w07_enumerated_factors", f"WITH {MONTHLY}, q AS (SELECT symbol, ts, " + ", ".join(f"{c} - lag({c}, {p}) {W} AS {c}_delta_{p}, max({c}) {over(p)} AS {c}_max_{p}, min({c}) {over(p)} AS {c}_min_{p}, avg({c}) {over(p)} AS {c}_mean_{p}" for c in INPUTS[:5] for p in PERIODS[2:5]) + f", CASE WHEN count(*) {over(10)} >= 10 THEN {corr_sql('close', 'volume', over(10))} ELSE 0.0 END AS close_volume_corr_10 FROM bars) SELECT symbol, ts, " + ", ".join(f"round({c}_{o}_{p} + 1e-9, 4) AS {c}_{o}_{p}" for c in INPUTS[:5] for p in PERIODS[2:5] for o in ("delta", "max", "min", "mean")) + ", round(close_volume_corr_10 + 1e-9, 4) AS close_volume_corr_10 FROM q")
def w07(spark, d):
    names = [f"{c}_{o}_{p}" for c in INPUTS[:5] for p in PERIODS[2:5] for o in ("delta", "max", "min", "mean")] + ["close_volume_corr_10"]
    return timeseries.enumerated(m.monthly_bars(spark, d), names).select("symbol", "ts", *(F.round(F.col(n) + 1e-9, 4).alias(n) for n in names))


@query("c01_factor_batch", f"WITH {MONTHLY}, {RETURNS}, q AS (SELECT symbol, ts, rn, coalesce(close / lag(close, 5) {W} - 1, 0.0) AS momentum_5, stddev_pop(ret) {over(20)} AS volatility_20, coalesce(avg(abs(ret) / volume) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0.0) AS amihud_5 FROM r), l AS (SELECT symbol, momentum_5, volatility_20, amihud_5 FROM q QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) = 1 AND rn >= 20) " + " UNION ALL ".join(f"SELECT symbol, '{c}' AS factor, round({c} + 1e-9, 6) AS value FROM l" for c in ("momentum_5", "volatility_20", "amihud_5")))
def c01(spark, d):
    """Each symbol's latest factors, one row for each factor; symbols of fewer than 20 bars are left out."""
    names = ["momentum_5", "volatility_20", "amihud_5"]
    b = timeseries.returns(m.monthly_bars(spark, d))
    b = b.select("symbol", "ts", F.row_number().over(BY_SYMBOL()).alias("rn"), timeseries.momentum(5).alias("momentum_5"), F.stddev_pop("ret").over(timeseries.last(20)).alias("volatility_20"), timeseries.amihud(5).alias("amihud_5"))
    latest = b.groupBy("symbol").agg(F.max_by(F.struct("rn", *names), "ts").alias("l")).filter("l.rn >= 20").select("symbol", "l.*")
    return latest.unpivot(["symbol"], names, "factor", "value").withColumn("value", F.round(F.col("value") + 1e-9, 6))


_SCORED = f"sc AS (SELECT factor, avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END) * 40 + abs(coalesce(avg(ic) / nullif(stddev_pop(ic), 0), 0.0)) * 20 + least(abs(avg(ic)) * 1000, 40) AS score FROM ics GROUP BY 1), wt AS (SELECT factor, score, score / sum(score) OVER () AS w FROM sc)"


def scored(spark: SparkSession, d: str) -> DataFrame:
    """A factor's score from how often and how much it is right, and its share of all; a row for each factor."""
    one = factors.ics(factors.long_form(following(spark, d))).groupBy("factor").agg((F.avg(F.when(F.col("ic") > 0, 1.0).otherwise(0.0)) * 40 + F.abs(div(F.avg("ic"), deviation_agg(F.col("ic")), 0.0)) * 20 + F.least(F.abs(F.avg("ic")) * 1000, F.lit(40.0))).alias("score"))
    return one.withColumn("w", F.col("score") / F.sum("score").over(Window.partitionBy()))


@query("p41_c11_factor_weights", f"WITH {SNAP}, {NEXT}, {LONG}, {ICS}, {_SCORED} SELECT factor, round(score, 4) AS score, round(w, 6) AS weight FROM wt")
def p41(spark, d):
    return scored(spark, d).select("factor", F.round("score", 4).alias("score"), F.round("w", 6).alias("weight"))


@query("p41_weight_entropy", f"WITH {SNAP}, {NEXT}, {LONG}, {ICS}, {_SCORED}, q AS (SELECT -sum(w * ln(w)) AS entropy, count(*) AS n FROM wt) SELECT round(entropy, 6) AS entropy, round(1 - entropy / ln(n), 6) AS confidence FROM q")
def p41b(spark, d):
    q = scored(spark, d).agg((-F.sum(F.col("w") * F.log("w"))).alias("entropy"), F.count("*").alias("n"))
    return q.select(F.round("entropy", 6).alias("entropy"), F.round(1 - F.col("entropy") / F.log("n"), 6).alias("confidence"))


@query("c09_model_weights", f"WITH {SNAP}, {NEXT}, {_CALLS}, h AS (SELECT model, greatest(0.0, 2 * avg(CASE WHEN call = sign(ret_next) THEN 1.0 ELSE 0.0 END) - 1) + 0.1 AS raw FROM cl GROUP BY 1) SELECT model, round(raw / sum(raw) OVER (), 6) AS weight FROM h")
def c09(spark, d):
    h = factors.calls(following(spark, d)).groupBy("model").agg((F.greatest(F.lit(0.0), 2 * F.avg(F.when(F.col("call") == F.signum("ret_next"), 1.0).otherwise(0.0)) - 1) + 0.1).alias("raw"))
    return h.select("model", F.round(F.col("raw") / F.sum("raw").over(Window.partitionBy()), 6).alias("weight"))
