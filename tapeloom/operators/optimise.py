"""Portfolios of sectors: moments by aggregation over all symbols, and solves of matrices as wide as the sector dimension.

A sector's return on a date is the mean of its symbols'. The matrices are as large as the dimension, a handful, and are
all that comes to the driver. Risk shares of single symbols need no matrix: a symbol's share is its covariance with the
portfolio.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.safe import div
from tapeloom.operators.timeseries import returns

#: The most sectors whose matrix the driver solves.
MOST = 200


def sector_returns(bars: DataFrame, dims: DataFrame) -> DataFrame:
    return returns(bars).join(dims.select("symbol", "sector"), "symbol").groupBy("ts", "sector").agg(F.avg("ret").alias("ret"), F.avg("cap" if "cap" in bars.columns else "volume").alias("size"))


def moments(sectors: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Names, means, covariances and mean sizes; summed in Spark, sectors squared rows on the driver."""
    means = {r.sector: r for r in sectors.groupBy("sector").agg(F.avg("ret").alias("mean"), F.avg("size").alias("size")).limit(MOST + 1).collect()}
    if len(means) > MOST:
        raise ValueError("more sectors than the driver solves for")
    names = sorted(means)
    pairs = sectors.alias("a").join(sectors.alias("b"), "ts").groupBy(F.col("a.sector").alias("x"), F.col("b.sector").alias("y")).agg(F.covar_pop("a.ret", "b.ret").alias("cov")).collect()
    cov = np.zeros((len(names), len(names)))
    for r in pairs:
        cov[names.index(r.x), names.index(r.y)] = r["cov"]
    return names, np.array([means[n]["mean"] for n in names]), cov, np.array([means[n]["size"] for n in names])


def minimum_variance(cov: np.ndarray) -> np.ndarray:
    w = np.linalg.solve(cov + 1e-10 * np.eye(len(cov)), np.ones(len(cov)))
    return w / w.sum()


def maximum_sharpe(mean: np.ndarray, cov: np.ndarray, free: float = 0.0, cap: float = 0.2) -> np.ndarray:
    raw = np.linalg.solve(cov + 1e-10 * np.eye(len(cov)), mean - free)
    w = np.clip(raw / abs(raw.sum()), -cap, cap) if raw.sum() else np.full(len(mean), 1 / len(mean))
    return w / w.sum() if w.sum() else np.full(len(mean), 1 / len(mean))


def risk_parity(cov: np.ndarray, rounds: int = 1000, close: float = 1e-12) -> np.ndarray:
    """Weights whose shares of the variance are equal, by damped multiplicative steps."""
    n = len(cov)
    w = np.full(n, 1 / n)
    for _ in range(rounds):
        share = w * (cov @ w)
        share = share / share.sum()
        if ((share - 1 / n) ** 2).sum() < close:
            break
        w = w * np.sqrt(1 / n / np.maximum(share, 1e-12))
        w = w / w.sum()
    return w


def view_weights(assets: DataFrame, views: DataFrame, tau: float = 0.05, aversion: float = 2.0) -> DataFrame:
    """assets (name, size, variance), views (name, ret, confidence) -> name, weight: the market's weights, tilted by what the views say of single assets.

    Weights that are optimal for a posterior mean m with second moments C + m m' point along C^-1 m, and C^-1 m is the sum of the prior's
    evidence, aversion / tau times the market's weights, and of each view's, its return over its doubt. So the whole posterior is one addition
    an asset, whatever the covariance between assets, and nothing is inverted: a view's doubt is (1 / confidence - 1) tau times its asset's variance.

    Defined results: sizes that are null or negative count 0; without any size, or if no evidence is positive, all weigh the market's or the same.
    Several views of an asset add up; those of unknown assets have no effect. Confidence is at least 0.01, doubt at least 1e-10.
    """
    named = assets.select("name", F.greatest(F.coalesce("size", F.lit(0.0)), F.lit(0.0)).alias("size"), "variance")
    doubt = F.greatest((1 / F.greatest("confidence", F.lit(0.01)) - 1) * tau * F.col("variance"), F.lit(1e-10))
    said = views.join(named.select("name", "variance"), "name").groupBy("name").agg(F.sum(F.col("ret") / doubt).alias("said"))
    total = named.agg(F.sum("size").alias("sizes"), F.count("*").alias("n"))
    # one row of two sums goes to every asset
    q = named.join(said, "name", "left").crossJoin(F.broadcast(total)).select("name", "n", F.coalesce(div(F.col("size"), F.col("sizes")), 1 / F.col("n")).alias("market"), F.coalesce("said", F.lit(0.0)).alias("said"))
    q = q.withColumn("pull", F.greatest(F.col("market") * (aversion / tau) + F.col("said"), F.lit(0.0)))
    pulls = q.agg(F.sum("pull").alias("pulls"))
    return q.crossJoin(F.broadcast(pulls)).select("name", F.coalesce(div(F.col("pull"), F.col("pulls")), F.col("market")).alias("weight"))


#: The variance that all assets share where none is estimated: a deviation of 0.3.
VARIANCE = 0.09


def view_table(sectors: DataFrame, ret: float = 0.1, confidence: float = 0.6, variance: float | None = VARIANCE) -> DataFrame:
    """Sectors by size, with one view: the sector of the highest mean return makes `ret`. Without a given variance each sector has its own."""
    own = F.lit(variance) if variance is not None else F.var_pop("ret")
    assets = sectors.groupBy(F.col("sector").alias("name")).agg(F.avg("size").alias("size"), F.avg("ret").alias("mean"), own.alias("variance"))
    best = assets.agg(F.max_by("name", F.struct("mean", "name")).alias("name")).select("name", F.lit(ret).alias("ret"), F.lit(confidence).alias("confidence"))
    return view_weights(assets, best).select(F.col("name").alias("sector"), "weight")


def constrained(weights: np.ndarray, cap: float = 0.25) -> np.ndarray:
    """Weights of at most cap, what is cut shared among the others by their weight, until none is above."""
    w = np.maximum(weights, 0) / np.maximum(weights, 0).sum()
    cap = max(cap, 1 / len(w))
    for _ in range(len(w)):
        over = w > cap + 1e-12
        if not over.any():
            break
        free = ~over & (w < cap)
        spare = (w[over] - cap).sum()
        w[over] = cap
        w[free] += spare * w[free] / w[free].sum() if w[free].sum() else spare / max(1, free.sum())
    return w


def weights_table(sectors: DataFrame, how: str) -> DataFrame:
    names, mean, cov, size = moments(sectors)
    if not names:
        return sectors.sparkSession.createDataFrame([], "sector string, weight double")
    w = {"minimum": lambda: minimum_variance(cov), "sharpe": lambda: maximum_sharpe(mean, cov), "parity": lambda: risk_parity(cov), "constrained": lambda: constrained(minimum_variance(cov))}[how]()
    return sectors.sparkSession.createDataFrame([(n, round(float(x), 6)) for n, x in zip(names, w, strict=True)], "sector string, weight double")


def portfolio_returns(rows: DataFrame) -> DataFrame:
    """symbol, ts, ret -> the return by date of equal weights."""
    return rows.groupBy("ts").agg(F.avg("ret").alias("p"), F.count("*").alias("n"))


def decomposition(rows: DataFrame) -> DataFrame:
    """The variance of equal weights over all symbols, what of it is their own, and the marginal and component shares of each symbol.

    A symbol's marginal risk is its covariance with the portfolio over the portfolio's deviation: one join by date, no pairs.
    """
    by = portfolio_returns(rows)
    j = rows.join(by, "ts")
    one = j.groupBy("symbol").agg(F.count("*").alias("bars"), F.covar_pop("ret", "p").alias("cov"), F.var_pop("ret").alias("own"))
    total = by.agg(F.var_pop("p").alias("variance"))
    n = rows.select("symbol").distinct().agg(F.count("*").alias("symbols"))
    return one.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(n)).select("symbol", "bars", "own", "cov", "variance", "symbols", div(F.col("cov"), F.sqrt("variance"), 0.0).alias("marginal"), div(F.col("cov"), F.col("variance") * F.col("symbols"), 0.0).alias("component"))
