"""Metrics, risk, pairing of trades, bootstrap and walk-forward."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.safe import div
from tapeloom.operators.timeseries import W, returns


def metrics(bars: DataFrame, periods: int = 12) -> DataFrame:
    """Total and annual return, volatility, Sharpe, Sortino, worst fall, Calmar, win rate and profit factor by symbol."""
    r = returns(bars).withColumn("dd", F.col("close") / F.max("close").over(W().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    one = r.groupBy("symbol").agg(
        F.count("*").alias("n"), (F.max_by("close", "ts") / F.min_by("close", "ts") - 1).alias("total"), F.stddev_pop("ret").alias("sd"), F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret"))).alias("down"), F.min("dd").alias("worst"),
        F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("win"), F.sum(F.when(F.col("ret") > 0, F.col("ret")).otherwise(0.0)).alias("gain"), F.sum(F.when(F.col("ret") < 0, -F.col("ret")).otherwise(0.0)).alias("loss"),
    )
    annual, vol = F.pow(1 + F.col("total"), F.lit(periods) / F.col("n")) - 1, F.col("sd") * F.sqrt(F.lit(float(periods)))
    made = {"total": F.col("total"), "annual": annual, "vol": vol, "sharpe": div(annual - 0.02, vol, 0.0), "sortino": div(annual - 0.02, F.col("down") * F.sqrt(F.lit(float(periods))), 0.0), "max_dd": F.col("worst"), "calmar": div(annual, F.abs("worst"), 0.0), "win_rate": F.col("win"), "profit_factor": F.least(F.lit(999.0), div(F.col("gain"), F.col("loss"), 999.0))}
    return one.select("symbol", "n", *(F.round(v, 5).alias(k) for k, v in made.items()))


def value_at_risk(bars: DataFrame, share: float = 0.05) -> DataFrame:
    """The historical value at risk and the mean of the returns at or below it."""
    r = returns(bars).filter(F.col("logret").isNotNull())
    order = Window.partitionBy("symbol").orderBy("ret", "ts")
    r = r.withColumn("place", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    cut = F.floor(F.col("n") * share).cast("int") + 1
    return r.filter(F.col("place") <= cut).groupBy("symbol").agg(F.round(F.max("ret"), 6).alias("var"), F.round(F.avg("ret"), 6).alias("cvar"))


def percentiles(bars: DataFrame) -> DataFrame:
    return returns(bars).groupBy("symbol").agg(*(F.round(F.percentile("ret", F.lit(p / 100)), 6).alias(f"p{p}") for p in (5, 25, 50, 75, 95)))


def holding_periods(trades: DataFrame) -> DataFrame:
    """Buys paired with the next sale of a symbol; count, win rate and mean by length of holding."""
    sale = trades.withColumns({"buy_ts": F.lag("ts").over(W()), "buy_price": F.lag("price").over(W()), "before": F.lag("side").over(W())}).filter("side = 'sell' and before = 'buy'")
    days = F.greatest(F.datediff("ts", "buy_ts"), F.lit(1))
    gain = F.col("price") / F.col("buy_price") - 1
    return sale.select(F.when(days < 5, "under_5").when(days < 20, "5_to_20").when(days < 60, "20_to_60").otherwise("over_60").alias("held"), gain.alias("gain")).groupBy("held").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("gain") > 0, 1.0).otherwise(0.0)), 6).alias("win_rate"), F.round(F.avg("gain"), 6).alias("mean"), F.round(F.max("gain"), 6).alias("best"), F.round(F.min("gain"), 6).alias("worst"))


def replay(trades: DataFrame) -> DataFrame:
    """Cash, shares and value after each trade (side, price, quantity): running sums, no loop."""
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    so_far = W().rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumns({"cash": F.sum(-sign * F.col("price") * F.col("quantity")).over(so_far), "shares": F.sum(sign * F.col("quantity")).over(so_far)})
    return t.select("symbol", "ts", "cash", "shares", (F.col("cash") + F.col("shares") * F.col("price")).alias("value"))


#: Draws come from two rounds of a linear generator on the symbol's, the run's and the step's number: the same on any cluster, and in any SQL.
PRIME, FACTOR = 2_147_483_647, 48_271


def bootstrap(bars: DataFrame, simulations: int = 200, steps: int = 60) -> DataFrame:
    """Percentiles of compounded returns drawn with replacement. A symbol's returns are one array, and all draws are made within its row."""
    r = returns(bars).filter(F.col("logret").isNotNull())
    series = r.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "logret"))), lambda x: x.logret).alias("r"))

    def total(sim):
        draw = lambda step: (F.pmod((F.col("symbol") * 1_000_003 + sim * 7_919 + step * 104_729 + 7), F.lit(1_000_000_007)) * FACTOR % PRIME) * FACTOR % PRIME
        return F.exp(F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(steps - 1).cast("long")), F.lit(0.0), lambda acc, step: acc + F.get("r", ((draw(step) / 7).cast("long") % F.size("r")).cast("int")))) - 1

    runs = series.select("symbol", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(simulations - 1).cast("long")), total)).alias("total"))
    return runs.groupBy("symbol").agg(F.round(F.percentile("total", F.lit(0.05)), 5).alias("p5"), F.round(F.percentile("total", F.lit(0.5)), 5).alias("p50"), F.round(F.percentile("total", F.lit(0.95)), 5).alias("p95"), F.round(F.avg(F.when(F.col("total") < 0, 1.0).otherwise(0.0)), 6).alias("loss_share"))


def walk_forward(bars: DataFrame, train: int = 24, test: int = 6, step: int = 6) -> DataFrame:
    """Rolling windows over each symbol's bars; the mean return of the training part decides whether the test part is held."""
    r = returns(bars).withColumn("i", F.row_number().over(W()) - 1)
    spots = r.withColumn("win", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("i") - train - test + step) / step).cast("int")), F.floor(F.col("i") / step).cast("int")))).withColumn("at", F.col("i") - F.col("win") * step)
    spots = spots.filter((F.col("at") >= 0) & (F.col("at") < train + test))
    one = spots.groupBy("symbol", "win").agg(F.count("*").alias("n"), F.avg(F.when(F.col("at") < train, F.col("ret"))).alias("before"), F.sum(F.when(F.col("at") >= train, F.log1p("ret"))).alias("after")).filter(F.col("n") == train + test)
    held = F.when(F.col("before") > 0, F.exp("after") - 1).otherwise(0.0)
    return one.groupBy("symbol").agg(F.count("*").alias("windows"), F.round(F.avg(held), 6).alias("mean"), F.round(F.avg(F.when(held > 0, 1.0).otherwise(0.0)), 6).alias("won"))
