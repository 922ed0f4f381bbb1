"""Queries of mixture regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import mixture
from tapeloom.plans.ladders import SNAP, snap
from tapeloom.plans.registry import query

#: A bar's return, volatility, change of volume, place in the year's range, strength and trend.
FEATURES = {
    "ret": "ret", "unrest": "least(1D, turnover / 500)", "volume_change": "least(2D, greatest(-2D, vol_ratio - 1))",
    "place": "coalesce((close - year_low) / nullif(year_high - year_low, 0), 0.5D)", "strength": "rsi14 / 100", "trend": "CASE WHEN rn >= 20 THEN coalesce(ma5 / nullif(ma20, 0) - 1, 0D) ELSE 0D END",
}
NAMES = ("bear", "sideways", "bull")
FIXED = 5


def features(spark, d):
    return snap(spark, d).selectExpr("symbol", "ts", *(f"{v} AS {k}" for k, v in FEATURES.items()))


@query("m07_mixture_regimes")
def m07(spark, d):
    """Each bar's regime and probabilities, from a mixture of all bars over six features. Iterations until it settles are beyond SQL; a test has a plain loop."""
    rows = features(spark, d)
    out = mixture.regimes(rows, list(FEATURES), mixture.fit(rows, list(FEATURES)))
    label = F.element_at(F.array(*(F.lit(n) for n in NAMES)), F.col("regime") + 1)
    return out.select("symbol", "ts", label.alias("regime"), *(F.round(F.col("probabilities")[i], 4).alias(f"p_{n}") for i, n in enumerate(NAMES)))


def _round(k: int) -> str:
    """Responsibilities under parameters k, and parameters k + 1."""
    return f"""
    e{k} AS (SELECT symbol, ts, z, list_transform([1, 2, 3], lambda j: w[j] * exp(-(z - m[j]) * (z - m[j]) / (2 * v[j])) / sqrt(v[j])) AS f FROM s CROSS JOIN p{k}),
    q{k} AS (SELECT symbol, ts, z, [f[1] / list_sum(f), f[2] / list_sum(f), f[3] / list_sum(f)] AS r FROM e{k}),
    p{k + 1} AS (SELECT {", ".join("[" + ", ".join(x.format(j=j) for j in (1, 2, 3)) + f"] AS {n}" for n, x in (("w", "avg(r[{j}])"), ("m", "sum(r[{j}] * z) / sum(r[{j}])"), ("v", "sum(r[{j}] * z * z) / sum(r[{j}]) - power(sum(r[{j}] * z) / sum(r[{j}]), 2) + 1e-6")))} FROM q{k})"""


@query(
    "m07_mixture_of_returns",
    f"""WITH {SNAP}, s AS (SELECT symbol, ts, (ret - avg(ret) OVER ()) / stddev_pop(ret) OVER () AS z FROM snap), p0 AS (SELECT [1 / 3::DOUBLE, 1 / 3::DOUBLE, 1 / 3::DOUBLE] AS w, [-1.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE] AS m, [1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE] AS v),
    {",".join(_round(k) for k in range(FIXED + 1))}
    SELECT symbol, ts, round(r[1], 5) AS p_low, round(r[2], 5) AS p_middle, round(r[3], 5) AS p_high FROM q{FIXED}""",
)
def m07_returns(spark, d):
    """Probabilities of each bar's return under three components, after a fixed number of rounds."""
    rows = features(spark, d).select("symbol", "ts", "ret")
    out = mixture.regimes(rows, ["ret"], mixture.fit(rows, ["ret"], rounds=FIXED, gain=float("-inf")))
    return out.select("symbol", "ts", *(F.round(F.col("probabilities")[i], 5).alias(f"p_{n}") for i, n in enumerate(("low", "middle", "high"))))
