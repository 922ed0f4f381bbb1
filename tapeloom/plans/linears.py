"""Queries over all 21 factors, in the order of their weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import factors, fusion, linear
from tapeloom.operators.timeseries import W as BY_SYMBOL
from tapeloom.operators.timeseries import ml_row
from tapeloom.plans.factors import _RICH, rich
from tapeloom.plans.registry import W, query
from tapeloom.plans.series import _ml_sql
from tapeloom.sources import market as m

ORDER = [f"f_{c}" for c, _ in sorted(factors.WEIGHTS.items(), key=lambda x: -x[1])]
K = len(ORDER)
LEAST = linear.LEAST


def scores(spark: SparkSession, d: str) -> DataFrame:
    """symbol, ts, the 21 scores, and the return of the bar to come."""
    made = factors.MULTI_FACTOR.apply(rich(spark, d), "symbol", "ts", "close")
    return made.select("symbol", "ts", *ORDER, (F.lead("close").over(BY_SYMBOL()) / F.col("close") - 1).alias("ret_next"))


_SCORES = f"{_RICH}, mf0 AS ({factors.MULTI_FACTOR.sql('rich', 'symbol', 'ts', 'close')}), mf AS (SELECT symbol, ts, {', '.join(ORDER)}, lead(close) {W} / close - 1 AS ret_next FROM mf0)"


def standard_sql(source: str, key: str = "ts", keep: str = "symbol, ts, ret_next") -> str:
    z = ", ".join(f"CASE WHEN sd_{c} < 1e-10 THEN 0.0 ELSE coalesce(({c} - mean_{c}) / nullif(sd_{c}, 0), 0.0) END AS z{i}" for i, c in enumerate(ORDER, 1))
    stats = ", ".join(f"avg({c}) AS mean_{c}, stddev_pop({c}) AS sd_{c}" for c in ORDER)
    return f"SELECT {keep}, n, {z} FROM {source} JOIN (SELECT {key} AS k, count(*) AS n, {stats} FROM {source} GROUP BY 1) ON k = {key}"


def gram_sql(source: str, key: str = "ts", y: str | None = None) -> str:

    def product(i: int, j: int) -> str:
        lo, hi = min(i, j), max(i, j)
        return f"avg(z{lo} * z{hi})" if hi <= K else f"covar_pop(z{lo}, {y})" if lo <= K else f"var_pop({y})"

    size = K + bool(y)
    rows = ", ".join("[" + ", ".join(product(i, j) for j in range(1, size + 1)) + "]" for i in range(1, size + 1))
    return f"SELECT {key}, count(*) AS n, [{rows}] AS s FROM {source} GROUP BY {key}"


def steps_sql(name: str, source: str, body: str, size: int, key: str = "ts") -> str:
    """A table of matrices after each of K pivots; `body`: the value in row r and column c after pivot p."""
    return f"""{name}_steps AS (SELECT {key}, n, 0 AS p, s FROM {source} UNION ALL SELECT {key}, n, p + 1, list_transform(range(1, {size + 1}), lambda r: list_transform(range(1, {size + 1}), lambda c: {body})) FROM {name}_steps WHERE p < {K}),
{name} AS (SELECT {key}, n, s FROM {name}_steps WHERE p = {K})"""


_P = "s[p + 1][p + 1]"
ELIMINATE = f"CASE WHEN r <= p + 1 OR NOT {_P} > {LEAST} THEN s[r][c] ELSE s[r][c] - s[r][p + 1] * s[p + 1][c] / {_P} END"
SWEEP = f"CASE WHEN NOT {_P} > {LEAST} THEN s[r][c] WHEN r = p + 1 AND c = p + 1 THEN -1 / {_P} WHEN r = p + 1 OR c = p + 1 THEN s[r][c] / {_P} ELSE s[r][c] - s[r][p + 1] * s[p + 1][c] / {_P} END"


def _projected(source: str) -> str:
    """The orthogonal factors, each in a query around those before it."""
    for j in range(1, K + 1):
        source = f"(SELECT *, z{j}" + "".join(f" - CASE WHEN s[{i}][{i}] > {LEAST} THEN s[{i}][{j}] / s[{i}][{i}] ELSE 0.0 END * q{i}" for i in range(1, j)) + f" AS q{j} FROM {source})"
    return source


_HEAD = f"WITH RECURSIVE {_SCORES}, zs AS ({standard_sql('mf')})"
_ORTHOGONAL = f"{_HEAD}, gm AS ({gram_sql('zs')}), {steps_sql('el', 'gm', ELIMINATE, K)}, q AS (SELECT * FROM {_projected('(SELECT zs.*, el.s FROM zs JOIN el USING (ts))')})"
_NAMES = "[" + ", ".join(f"'{c}'" for c in ORDER) + "]"


@query("x18_orthogonal_all", f"{_ORTHOGONAL} SELECT symbol, ts, " + ", ".join(f"round(q{j}, 4) AS q{j}" for j in range(1, K + 1)) + " FROM q")
def x18(spark, d):
    return linear.orthogonal_factors(scores(spark, d), ORDER).select("symbol", "ts", *(F.round(F.col("q")[j], 4).alias(f"q{j + 1}") for j in range(K)))


@query("x21_left_of_factors", f"{_HEAD}, gm AS ({gram_sql('zs')}), {steps_sql('el', 'gm', ELIMINATE, K)}, e AS (SELECT el.ts, el.n, unnest(range(1, {K + 1})) AS i, el.s AS u, gm.s AS s FROM el JOIN gm USING (ts)) SELECT ts, n, {_NAMES}[i] AS factor, round(CASE WHEN s[i][i] > {LEAST} THEN u[i][i] / s[i][i] ELSE 0.0 END, 5) AS left_share FROM e")
def x21(spark, d):
    return linear.left_of_factors(scores(spark, d), ORDER).select("ts", "n", "factor", F.round("left", 5).alias("left_share"))


@query("x22_inflation_all", f"{_HEAD}, gm AS ({gram_sql('zs')}), {steps_sql('sw', 'gm', SWEEP, K)}, e AS (SELECT sw.ts, sw.n, unnest(range(1, {K + 1})) AS i, sw.s AS w, gm.s AS s FROM sw JOIN gm USING (ts) WHERE sw.n >= {K + 2}), v AS (SELECT ts, {_NAMES}[i] AS factor, CASE WHEN -w[i][i] > 0.5 THEN s[i][i] * -w[i][i] END AS vif FROM e) SELECT factor, count(*) AS dates, round(avg(vif), 3) AS vif, coalesce(avg(vif) <= 10, false) AS kept FROM v GROUP BY 1")
def x22(spark, d):
    one = linear.inflation(scores(spark, d), ORDER).filter(F.col("n") >= K + 2).groupBy("factor").agg(F.count("*").alias("dates"), F.avg("vif").alias("vif"))
    return one.select("factor", "dates", F.round("vif", 3).alias("vif"), F.coalesce(F.col("vif") <= 10, F.lit(False)).alias("kept"))


_EACH = f"l AS (SELECT unnest(range(1, {K + 1})) AS i, unnest([" + ", ".join(f"q{j}" for j in range(1, K + 1)) + "]) AS q FROM q)"


@query("x23_orthogonal_weights_all", f"{_ORTHOGONAL}, {_EACH}, w AS (SELECT i, CASE WHEN stddev_pop(q) > 1e-6 THEN avg(abs(q)) / stddev_pop(q) ELSE 0.0 END AS w FROM l GROUP BY 1) SELECT {_NAMES}[i] AS factor, round(w / sum(w) OVER (), 5) AS weight FROM w")
def x23(spark, d):
    """A factor's share by the mean size of its orthogonal part against its deviation; the means themselves are 0 on each date."""
    q = linear.orthogonal_factors(scores(spark, d), ORDER).select(F.posexplode("q").alias("i", "q"))
    w = q.groupBy("i").agg(F.when(F.stddev_pop("q") > 1e-6, F.avg(F.abs("q")) / F.stddev_pop("q")).otherwise(0.0).alias("w"))
    total = w.agg(F.sum("w").alias("total"))
    names = F.array(*(F.lit(c) for c in ORDER))
    return w.join(F.broadcast(total)).select(names[F.col("i")].alias("factor"), F.round(F.col("w") / F.col("total"), 5).alias("weight"))


_FORWARD = f"WITH RECURSIVE {_SCORES}, fw AS (SELECT * FROM mf WHERE ret_next IS NOT NULL), zs AS ({standard_sql('fw')})"


@query("x08_fama_macbeth_all", f"{_FORWARD}, gm AS ({gram_sql('zs', y='ret_next')}), {steps_sql('sw', 'gm', SWEEP, K + 1)}, u AS (SELECT *, n - len(list_filter(range(1, {K + 1}), lambda i: s[i][i] < -0.5)) - 1 AS free FROM sw), e AS (SELECT ts, n, free, s AS w, unnest(range(1, {K + 1})) AS i FROM u WHERE free > 0), t AS (SELECT ts, {_NAMES}[i] AS factor, w[i][{K + 1}] AS slope, coalesce(w[i][{K + 1}] / nullif(sqrt(greatest(0.0, w[{K + 1}][{K + 1}]) * n / free * -w[i][i] / n), 0), 0.0) AS t FROM e WHERE w[i][i] < -0.5) SELECT factor, count(*) AS dates, round(avg(slope), 5) AS slope, round(avg(t), 3) AS t FROM t GROUP BY 1")
def x08(spark, d):
    one = linear.regressions(scores(spark, d).filter("ret_next IS NOT NULL"), ORDER, "ret_next")
    return one.groupBy("factor").agg(F.count("*").alias("dates"), F.round(F.avg("slope"), 5).alias("slope"), F.round(F.avg("t"), 3).alias("t"))




def _kept(source: str) -> str:
    for j in range(1, K + 1):
        source = "(SELECT *, NOT (" + " OR ".join(["false", *(f"(k{i} AND abs(s[{i}][{j}]) > 0.7)" for i in range(1, j))]) + f") AS k{j} FROM {source})"
    return source


@query("x11_uncorrelated_all", f"WITH {_SCORES}, m1 AS (SELECT *, 0 AS whole FROM mf), zs AS ({standard_sql('m1', 'whole', 'whole')}), gm AS ({gram_sql('zs', 'whole')}), kp AS (SELECT * FROM {_kept('gm')}), l AS (SELECT unnest(range(1, {K + 1})) AS i, [" + ", ".join(f"k{j}" for j in range(1, K + 1)) + f"] AS kept FROM kp) SELECT {_NAMES}[i] AS factor, kept[i] AS kept FROM l")
def x11(spark, d):
    return linear.uncorrelated(scores(spark, d), ORDER)


def fused_rows(spark: SparkSession, d: str, width: int) -> DataFrame:
    """The 21 scores and the learning row of each bar as one vector, v0 and so on."""
    made = factors.MULTI_FACTOR.apply(rich(spark, d), "symbol", "ts", "close").select("symbol", "ts", *ORDER)
    row = ml_row(m.monthly_bars(spark, d))
    names = [c for c in row.columns if c not in ("symbol", "ts")]
    both = made.join(row, ["symbol", "ts"])
    v = fusion.fused([(fusion.spread([F.col(c) for c in ORDER]), K), (F.array(*(F.col(c).cast("double") for c in names)), len(names))], width)
    return both.select("symbol", "ts", v.alias("v")).select("symbol", "ts", *(F.round(F.get("v", F.lit(i)) + 1e-9, 6).alias(f"v{i}") for i in range(width)))


_ML = "mom_1 mom_3 mom_5 mom_10 volume_ratio vol_20 rsi_14 ma5_gap ma20_gap year_position outer_share turnover".split()


def _fused_sql(width: int) -> str:
    n = K + len(_ML)
    value = lambda i: f"u[{i + 1}]" if i < n else "0.0::DOUBLE"
    if n >= width:
        value = lambda i: f"list_inner_product(u, [{', '.join(f'{x!r}::DOUBLE' for x in fusion.projection(n, width)[:, i].tolist())}])"
    return f"""{_SCORES}, ml AS ({_ml_sql()}), fl AS (SELECT mf0.symbol, mf0.ts, [{', '.join(f'coalesce({c}, 0.0)::DOUBLE' for c in ORDER)}] AS f, [{', '.join(f'coalesce(ml.{c}, 0.0)::DOUBLE' for c in _ML)}] AS l FROM mf0 JOIN ml ON ml.symbol = mf0.symbol AND ml.ts = mf0.ts),
fw AS (SELECT symbol, ts, list_concat(list_transform(f, lambda x: CASE WHEN list_max(f) > list_min(f) THEN (x - list_min(f)) / (list_max(f) - list_min(f)) ELSE 0.0 END), l) AS w FROM fl), fu AS (SELECT symbol, ts, list_transform(w, lambda x: CASE WHEN list_inner_product(w, w) > 1e-20 THEN x / sqrt(list_inner_product(w, w)) ELSE x END) AS u FROM fw)
SELECT symbol, ts, {', '.join(f'round({value(i)} + 1e-9, 6) AS v{i}' for i in range(width))} FROM fu"""


@query("c35_fused_factors", f"WITH {_fused_sql(64)}")
def c35(spark, d):
    """33 features filled up to 64."""
    return fused_rows(spark, d, 64)


@query("x28_projected_vector", f"WITH {_fused_sql(16)}")
def x28_projected(spark, d):
    """33 features projected to 16."""
    return fused_rows(spark, d, 16)
