"""Factor models: scores of single factors, styles, orthogonal factors, regressions by date and the tests of a factor.

Regressions and projections over few factors are closed forms of their moments: one aggregation by date, or one over
all rows, and columns on its result. Nothing is gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.safe import corr_agg, deviation_agg, div
from tapeloom.operators.steps import rules
from tapeloom.operators.timeseries import W

#: The factors that regressions and projections take, in their order.
FACTORS = ("mom5", "ret_sd", "vol_ratio")
MORE = (*FACTORS, "mom20", "rsi14")


def _scale(value: str) -> str:
    return f"least(10.0, greatest(0.0, {value}))"


_RATIO = "coalesce(outer_vol / nullif(inner_vol, 0), 1.0)"
# fixed values: weights of the factors
WEIGHTS = {
    "momentum_1d": 0.08, "momentum_5d": 0.08, "momentum_20d": 0.07, "momentum_60d": 0.06, "short_term_reversal": 0.05, "pe_value": 0.07, "pb_value": 0.05, "market_cap_value": 0.04, "realized_vol": 0.05, "downside_vol": 0.04, "volume_ratio": 0.07,
    "volume_momentum": 0.05, "outer_inner_ratio": 0.06, "turnover_level": 0.04, "roe_quality": 0.06, "revenue_growth_quality": 0.05, "rsi_technical": 0.05, "macd_slope": 0.05, "bollinger_position": 0.04, "trend_strength": 0.05, "price_sentiment": 0.03,
}
#: Over a snapshot with pe, pb, cap, roe, growth, mom60 and hist_slope. Momenta are in hundredths, the others scores of 0 to 10.
SCORES = {
    "momentum_1d": "change", "momentum_5d": "mom5 * 100", "momentum_20d": "mom20 * 100", "momentum_60d": "mom60 * 100", "short_term_reversal": "-change",
    "pe_value": f"CASE WHEN pe <= 0 THEN 5.0 ELSE {_scale('10 - pe / 30')} END", "pb_value": f"CASE WHEN pb <= 0 THEN 5.0 ELSE {_scale('10 - pb / 3')} END",
    "market_cap_value": "CASE WHEN cap <= 0 THEN 5.0 WHEN cap > 100 AND cap < 500 THEN 8.0 WHEN cap >= 500 THEN 6.0 WHEN cap > 50 THEN 7.0 ELSE 5.0 END",
    "realized_vol": f"CASE WHEN rn >= 21 THEN {_scale('10 - vol * 100 / 5')} ELSE {_scale('10 - turnover / 50')} END", "downside_vol": f"CASE WHEN rn >= 21 THEN {_scale('10 - down * 100 * sqrt(12.0) / 3')} ELSE 5.0 END",
    "volume_ratio": f"CASE WHEN {_RATIO} > 1.3 THEN 8.0 WHEN {_RATIO} > 1.0 THEN 6.0 WHEN {_RATIO} > 0.7 THEN 4.0 ELSE 2.0 END", "volume_momentum": "CASE WHEN turnover > 300 THEN 8.0 WHEN turnover > 200 THEN 6.0 WHEN turnover > 100 THEN 5.0 ELSE 3.0 END",
    "outer_inner_ratio": f"least(10.0, {_RATIO} * 5)", "turnover_level": "CASE WHEN turnover > 100 AND turnover < 300 THEN 8.0 WHEN turnover >= 300 THEN 5.0 ELSE 4.0 END",
    "roe_quality": "CASE WHEN roe > 20 THEN 9.0 WHEN roe > 15 THEN 7.0 WHEN roe > 10 THEN 5.0 ELSE 3.0 END", "revenue_growth_quality": "CASE WHEN growth > 30 THEN 9.0 WHEN growth > 20 THEN 7.0 WHEN growth > 10 THEN 5.0 ELSE 3.0 END",
    "rsi_technical": "CASE WHEN rsi14 < 20 THEN 10.0 WHEN rsi14 < 30 THEN 8.0 WHEN rsi14 < 40 THEN 6.0 WHEN rsi14 < 60 THEN 5.0 WHEN rsi14 < 70 THEN 3.0 WHEN rsi14 < 80 THEN 2.0 ELSE 0.0 END", "macd_slope": f"CASE WHEN rn >= 35 THEN {_scale('5 + hist_slope * 100')} ELSE 5.0 END",
    "bollinger_position": f"CASE WHEN rn >= 21 AND sd > 0 THEN {_scale('((close - ma20) / nullif(2 * sd, 0) + 1) * 5')} ELSE 5.0 END", "trend_strength": "CASE WHEN rn < 21 THEN 5.0 WHEN ma5 / ma20 > 0.98 AND ma5 / ma20 < 1.05 THEN 8.0 WHEN ma5 / ma20 >= 1.05 THEN 6.0 ELSE 4.0 END",
    "price_sentiment": "CASE WHEN change > 5 THEN 8.0 WHEN change > 0 THEN 6.0 WHEN change > -5 THEN 4.0 ELSE 2.0 END",
}
_MULTI = {f"f_{k}": v for k, v in SCORES.items()}
MULTI_FACTOR = rules(
    _MULTI,
    {"score": " + ".join(f"{w} * f_{k}" for k, w in WEIGHTS.items())},
    {"rating": "CASE WHEN score >= 8 THEN 'strong' WHEN score >= 6.5 THEN 'good' WHEN score >= 5 THEN 'neutral' WHEN score >= 3.5 THEN 'watch' ELSE 'sell' END"},
    out=" ".join(f"{k}:4" for k in _MULTI) + " score:4 rating",
)
#: The ten styles; the market's deviation stands at 0.05 a bar.
STYLES = rules(
    {"beta": "least(3.0, greatest(0.3, vol / sqrt(12.0) / 0.05))", "size": "ln(greatest(cap, 0.0) + 1)", "value": "CASE WHEN pe > 0 THEN 1 / pe ELSE 0.0 END", "growth_style": "growth", "liquidity": "ln(amount + 1)", "momentum": "CASE WHEN rn >= 20 THEN mom20 * 100 ELSE change * 10 END", "volatility": "CASE WHEN rn >= 21 THEN vol * 100 ELSE 20.0 END", "leverage": "debt", "earnings_yield": "CASE WHEN pe > 0 THEN 1 / pe ELSE 0.0 END", "restructuring": "CASE WHEN growth > 50 THEN 1.0 ELSE 0.0 END"},
    out="beta:5 size:5 value:6 growth_style:4 liquidity:5 momentum:4 volatility:4 leverage:4 earnings_yield:6 restructuring:1",
)

_V1 = ("mom5", "vol", "vol_ratio", "rsi14", "turnover")
V1_WEIGHTS = {"mom5": 0.3, "vol": 0.15, "vol_ratio": 0.2, "rsi14": 0.2, "turnover": 0.15}
V1 = rules(
    {"score": " + ".join(f"{w} * z_{c}" for c, w in V1_WEIGHTS.items()), "top": "greatest(" + ", ".join(f"z_{c}" for c in _V1) + ")", "bottom": "least(" + ", ".join(f"z_{c}" for c in _V1) + ")", "z_mean": "(" + " + ".join(f"z_{c}" for c in _V1) + ") / 5"},
    {"dominant": "CASE top " + " ".join(f"WHEN z_{c} THEN '{c}'" for c in _V1) + " END", "weakest": "CASE bottom " + " ".join(f"WHEN z_{c} THEN '{c}'" for c in _V1) + " END", "rating": "CASE WHEN score > 0.5 THEN 'good' WHEN score > -0.5 THEN 'neutral' ELSE 'poor' END", "exposure": "z_mom5 - z_mean"},
    out="score:5 dominant weakest rating exposure:5",
)


def zscores(rows: DataFrame, columns: tuple[str, ...] = _V1) -> DataFrame:
    """Each column against its date's mean and deviation: moments are summed map-side and joined back."""
    by = rows.groupBy("ts").agg(*(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))))
    out = rows.join(by, "ts")
    return out.withColumns({f"z_{c}": F.when(F.col(f"s_{c}") < 1e-10, 0.0).otherwise(F.coalesce(div(F.col(c) - F.col(f"m_{c}"), F.col(f"s_{c}")), F.lit(0.0))) for c in columns})


def with_forward(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows that have all columns and a return of the bar to come, ret_next."""
    out = rows.withColumn("ret_next", F.lead("close").over(W()) / F.col("close") - 1)
    return out.filter(" AND ".join(f"{c} IS NOT NULL" for c in ("ret_next", *columns)))


def long_form(rows: DataFrame, columns: tuple[str, ...] = MORE) -> DataFrame:
    """factor, ts, symbol, x, ret."""
    return rows.unpivot(["symbol", "ts", "ret_next"], list(columns), "factor", "x").withColumnRenamed("ret_next", "ret")


def ics(long: DataFrame, least: int = 5) -> DataFrame:
    """The information coefficient of each factor and date."""
    return long.groupBy("factor", "ts").agg(F.count("*").alias("n"), corr_agg(F.col("x"), F.col("ret")).alias("ic"), F.stddev_pop("ret").alias("ret_sd")).filter(F.col("n") >= least)


def ranked(by_date: DataFrame) -> DataFrame:
    """Factors by the absolute information ratio; a row for each factor."""
    one = by_date.groupBy("factor").agg(F.avg("ic").alias("ic"), deviation_agg(F.col("ic")).alias("sd"))
    one = one.withColumn("icir", div(F.col("ic"), F.col("sd"), 0.0))
    return one.select("factor", "ic", "icir", F.row_number().over(Window.orderBy(F.desc(F.abs("icir")), "factor")).alias("place"))


def regression_moments(rows: DataFrame) -> DataFrame:
    """By date: how factors go with each other and with the return, after standardising."""
    a, b, c = FACTORS
    y = F.col("ret_next")
    pair = lambda x, z: corr_agg(F.col(x), F.col(z))
    along = lambda x: F.coalesce(F.try_divide(F.covar_pop(F.col(x), y), deviation_agg(F.col(x))), F.lit(0.0))
    return rows.groupBy("ts").agg(F.count("*").alias("n"), pair(a, b).alias("r12"), pair(a, c).alias("r13"), pair(b, c).alias("r23"), along(a).alias("y1"), along(b).alias("y2"), along(c).alias("y3"), F.var_pop(y).alias("vy"))


#: The inverse of the correlations by cofactors, slopes, the mean squared error and t of each slope.
REGRESSION = rules(
    {"det": "1 + 2 * r12 * r13 * r23 - r12 * r12 - r13 * r13 - r23 * r23"},
    {"d": "nullif(det, 0)"},
    {"i11": "(1 - r23 * r23) / d", "i22": "(1 - r13 * r13) / d", "i33": "(1 - r12 * r12) / d", "i12": "(r13 * r23 - r12) / d", "i13": "(r12 * r23 - r13) / d", "i23": "(r12 * r13 - r23) / d"},
    {"b1": "i11 * y1 + i12 * y2 + i13 * y3", "b2": "i12 * y1 + i22 * y2 + i23 * y3", "b3": "i13 * y1 + i23 * y2 + i33 * y3"},
    {"mse": "greatest(0.0, vy - b1 * y1 - b2 * y2 - b3 * y3) * n / (n - 4)"},
    {f"t{k}": f"coalesce(b{k} / nullif(sqrt(mse * i{k}{k} / n), 0), 0.0)" for k in (1, 2, 3)},
    out="ts n b1 b2 b3 t1 t2 t3",
    where="n >= 6 AND det > 1e-6",
)


def mean_slopes(by_date: DataFrame) -> DataFrame:
    """Over dates, each factor's mean slope and mean t."""
    pairs = F.array(*(F.struct(F.lit(name).alias("factor"), F.col(f"b{k}").alias("b"), F.col(f"t{k}").alias("t")) for k, name in enumerate(FACTORS, 1)))
    return by_date.select(F.explode(pairs).alias("p")).groupBy("p.factor").agg(F.count("*").alias("dates"), F.round(F.avg("p.b"), 6).alias("slope"), F.round(F.avg("p.t"), 5).alias("t"))


def gram(rows: DataFrame, *keys: str) -> DataFrame:
    """Sums of squares and products of the factors, and their moments, over all rows or by key."""
    a, b, c = FACTORS
    made = [F.sum(F.col(x) * F.col(y)).alias(n) for n, x, y in (("s11", a, a), ("s12", a, b), ("s13", a, c), ("s22", b, b), ("s23", b, c), ("s33", c, c))]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *made)


_PROJECT = {"a": "coalesce(s12 / nullif(s11, 0), 0.0)", "b": "coalesce(s13 / nullif(s11, 0), 0.0)"}
_SECOND = {"o22": "s22 - a * s12", "o23": "s23 - a * s13"}
_THIRD = {"c": "CASE WHEN o22 > 1e-9 THEN o23 / o22 ELSE 0.0 END"}
#: Loadings of each factor on those before it, what is left of it, and how far products fall.
GRAM_SCHMIDT = rules(
    _PROJECT, _SECOND, _THIRD, {"o33": "s33 - b * s13 - c * o23"},
    {"kept_2": "o22 / nullif(s22, 0)", "kept_3": "o33 / nullif(s33, 0)", "reduction": "greatest(0.0, least(1.0, 1 - (power(o23 - c * o22, 2)) / nullif(power(s12, 2) + power(s13, 2) + power(s23, 2), 0)))"},
    out="n a:6 b:6 c:6 kept_2:6 kept_3:6 reduction:6",
)
INFLATION = rules(
    {"det": "s11 * (s22 * s33 - s23 * s23) - s12 * (s12 * s33 - s13 * s23) + s13 * (s12 * s23 - s13 * s22)"},
    {"vif_1": "s11 * (s22 * s33 - s23 * s23) / nullif(det, 0)", "vif_2": "s22 * (s11 * s33 - s13 * s13) / nullif(det, 0)", "vif_3": "s33 * (s11 * s22 - s12 * s12) / nullif(det, 0)"},
    {"kept": "concat_ws(',', " + ", ".join(f"CASE WHEN vif_{k} <= 10 THEN '{name}' END" for k, name in enumerate(FACTORS, 1)) + ")"},
    out="vif_1:5 vif_2:5 vif_3:5 kept",
)
ORTHOGONAL = rules(_PROJECT, _SECOND, _THIRD, {"q1": FACTORS[0], "q2": f"{FACTORS[1]} - a * {FACTORS[0]}"}, {"q3": f"{FACTORS[2]} - b * {FACTORS[0]} - c * q2"}, out="q1:5 q2:5 q3:5")


def orthogonal(rows: DataFrame) -> DataFrame:
    """Each date's factors, each without its projection on those before it."""
    return rows.join(F.broadcast(gram(rows, "ts")), "ts")  # a row for each date


#: Over one row with the correlations of five factors, in their order: those kept that go with no kept one before above 0.7.
_KEEP = [{f"k{j}": " AND ".join(["true", *(f"NOT (k{i} AND abs(c{i}{j}) > 0.7)" for i in range(j))])} for j in range(len(MORE))]
GREEDY = rules(*_KEEP, {"kept": "concat_ws(',', " + ", ".join(f"CASE WHEN k{j} THEN '{name}' END" for j, name in enumerate(MORE)) + ")"})


def pair_correlations(rows: DataFrame) -> DataFrame:
    return rows.agg(*(corr_agg(F.col(MORE[i]), F.col(MORE[j])).alias(f"c{i}{j}") for j in range(len(MORE)) for i in range(j)))


def fused(rows: DataFrame) -> DataFrame:
    """Factors scaled to 0..1 within their date, side by side, and brought to length 1."""
    by = rows.groupBy("ts").agg(*(f(c).alias(f"{n}_{c}") for c in FACTORS for n, f in (("lo", F.min), ("hi", F.max))))
    out = rows.join(by, "ts")
    out = out.withColumns({f"v_{c}": F.coalesce(div(F.col(c) - F.col(f"lo_{c}"), F.col(f"hi_{c}") - F.col(f"lo_{c}")), F.lit(0.5)) for c in FACTORS})
    norm = F.sqrt(sum(F.col(f"v_{c}") * F.col(f"v_{c}") for c in FACTORS))
    return out.select("symbol", "ts", *(F.round(F.coalesce(div(F.col(f"v_{c}"), norm), F.lit(0.0)), 6).alias(f"v_{c}") for c in FACTORS))


def calls(rows: DataFrame) -> DataFrame:
    """What three simple models say of the next return, and how sure they are: model, call, sure, ret_next."""
    said = {"momentum": ("mom5", F.abs("mom5")), "reversal": ("-change", F.abs(F.col("change")) / 100), "strength": ("rsi14 - 50", F.abs(F.col("rsi14") - 50) / 50)}
    parts = F.array(*(F.struct(F.lit(k).alias("model"), F.signum(F.expr(v)).alias("call"), F.least(F.lit(1.0), sure).alias("sure")) for k, (v, sure) in said.items()))
    return rows.select("symbol", "ts", "ret_next", F.explode(parts).alias("p")).select("symbol", "ts", "ret_next", "p.*")


def model_ranking(rows: DataFrame) -> DataFrame:
    right = F.when(F.col("call") == F.signum("ret_next"), 1.0).otherwise(0.0)
    return rows.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("accuracy"), F.round(F.avg(F.when(F.col("call") != 0, right)), 6).alias("hit_rate"), F.round(F.avg("sure"), 6).alias("sure"), F.round(corr_agg(F.col("call"), F.col("ret_next")), 6).alias("ic"))


