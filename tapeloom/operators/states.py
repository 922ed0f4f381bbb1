"""State ladders, sizing, fallbacks and summaries that rest on the windows and folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.safe import clip, div
from tapeloom.operators.fold import fold, zero
from tapeloom.operators.timeseries import W, last, returns


def fallback(first: DataFrame, second: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The first source's value where it has one, else the second's."""
    a, b = first.select(*keys, F.col(value).alias("a")), second.select(*keys, F.col(value).alias("b"))
    return a.join(b, keys, "full_outer").select(*keys, F.coalesce("a", "b").alias(value), F.when(F.col("a").isNotNull(), "first").otherwise("second").alias("origin"))


def market_state(bars: DataFrame) -> DataFrame:
    """Volatility, trend and position of a bar, each on its ladder."""
    vol = F.stddev_pop("ret").over(last(20))
    trend = div(F.avg("close").over(last(5)), F.avg("close").over(last(20)), 1.0) - 1
    low, high = F.min("close").over(last(60)), F.max("close").over(last(60))
    place = div(F.col("close") - low, high - low, 0.5)
    return returns(bars).select(
        "symbol", "ts", F.when(vol > 0.8, "high").when(vol > 0.4, "medium").otherwise("low").alias("volatility"), F.when(trend > 0.05, "up").when(trend < -0.05, "down").otherwise("flat").alias("trend"),
        F.when(place > 0.8, "top").when(place < 0.2, "bottom").otherwise("middle").alias("place"),
    )


def entries(bars: DataFrame) -> DataFrame:
    """A row for each entry rule that a bar meets, with its weight."""
    ma, low = F.avg("close").over(last(20)), F.min("close").over(last(20))
    rule = lambda met, name, weight: F.when(met, F.struct(F.lit(name).alias("rule"), F.lit(weight).alias("weight")))
    met = F.array_compact(F.array(rule(F.col("close") > ma * 1.05, "above_mean", 0.3), rule(F.col("close") <= low * 1.02, "near_low", 0.4), rule(F.col("ret") < -0.05, "oversold", 0.2), rule(F.col("volume") > 2 * F.avg("volume").over(last(20)), "volume_surge", 0.1)))
    return returns(bars).select("symbol", "ts", met.alias("met")).select("symbol", "ts", F.explode("met").alias("r")).select("symbol", "ts", "r.rule", "r.weight")


def valuation(bars: DataFrame, dims: DataFrame) -> DataFrame:
    """A symbol's last close against the mean of its industry, on a ladder."""
    now = bars.groupBy("symbol").agg(F.max_by("close", "ts").alias("close")).join(dims, "symbol")
    mean = now.groupBy("industry").agg(F.avg("close").alias("mean"))
    ratio = div(F.col("close"), F.col("mean"), 1.0)
    return now.join(mean, "industry").select("symbol", "industry", F.round(ratio, 6).alias("ratio"), F.when(ratio < 0.7, "cheap").when(ratio > 1.3, "dear").otherwise("fair").alias("level"))


def mode_of_last(states: DataFrame, k: int = 5, least: int = 3) -> DataFrame:
    """The state that at least `least` of the last k rows share; else the row's own."""
    window = F.collect_list("state").over(last(k))
    names = F.array_sort(F.array_distinct("window"))
    common = F.filter(names, lambda n: F.size(F.filter("window", lambda v: v == n)) >= least)
    return states.withColumn("window", window).select("symbol", "ts", "state", F.coalesce(F.get(common, F.lit(0)), F.col("state")).alias("smoothed"))


def decaying(ics: DataFrame) -> DataFrame:
    """Whether the later half of a factor's ics holds under half of the absolute mean of the earlier half."""
    h = ics.withColumn("half", F.ntile(2).over(Window.partitionBy("factor").orderBy("ts")))
    one = h.groupBy("factor").agg(F.avg(F.when(F.col("half") == 1, F.col("ic"))).alias("early"), F.avg(F.when(F.col("half") == 2, F.col("ic"))).alias("late"))
    return one.select("factor", F.round("early", 6).alias("early"), F.round("late", 6).alias("late"), (F.abs("late") < 0.5 * F.abs("early")).alias("decaying"))


def rolling_ic(bars_ic: DataFrame, k: int = 12) -> DataFrame:
    """Mean and information ratio of the last k dates' ics; a date is one row."""
    w = Window.orderBy("ts").rowsBetween(1 - k, 0)
    mean, sd = F.avg("ic").over(w), F.stddev_pop("ic").over(w)
    return bars_ic.select("ts", F.round(mean, 6).alias("mean"), F.round(div(mean, sd, 0.0), 6).alias("icir"))


def extremes(panel: DataFrame, k: int = 3) -> DataFrame:
    """The k largest and the k smallest of each date."""
    down, up = Window.partitionBy("ts").orderBy(F.desc("x"), "symbol"), Window.partitionBy("ts").orderBy("x", "symbol")
    p = panel.withColumns({"top": F.row_number().over(down), "bottom": F.row_number().over(up)}).filter((F.col("top") <= k) | (F.col("bottom") <= k))
    return p.select("ts", "symbol", F.when(F.col("top") <= k, "top").otherwise("bottom").alias("side"))


def environment(bars: DataFrame, cost: float = 0.001, step: float = 0.2) -> DataFrame:
    """A position that moves by at most `step` toward the sign of the last return, its reward after cost, and its value."""

    def move(s, x):
        want = F.when(x.back > 0, 1.0).when(x.back < 0, 0.0).otherwise(s.weight)
        weight = s.weight + F.greatest(F.lit(-step), F.least(F.lit(step), want - s.weight))
        reward = s.weight * x.ret - cost * F.abs(weight - s.weight)
        return {"weight": weight, "reward": reward, "value": s.value * (1 + reward)}

    b = returns(bars).withColumn("back", F.coalesce(F.lag("ret").over(W()), F.lit(0.0)))
    return fold(b, ["ret", "back"], {"weight": zero(), "reward": zero(), "value": F.lit(1.0)}, move)


def adaptive_kelly(bars: DataFrame) -> DataFrame:
    """Half Kelly shrunk by volatility, by the worst fall and by how few returns there are."""
    r = returns(bars).withColumn("dd", F.col("close") / F.max("close").over(W().rowsBetween(Window.unboundedPreceding, 0)) - 1).filter("logret is not null")
    one = r.groupBy("symbol").agg(F.count("*").alias("n"), F.avg(F.when(F.col("ret") > 0, 1.0).otherwise(0.0)).alias("p"), F.coalesce(div(F.avg(F.when(F.col("ret") > 0, F.col("ret"))), F.avg(F.when(F.col("ret") < 0, -F.col("ret")))), F.lit(2.0)).alias("b"), F.stddev_pop("ret").alias("v"), F.abs(F.min("dd")).alias("d"))
    raw = (F.col("p") - div(1 - F.col("p"), F.col("b"), 0.0)) / 2 / (1 + F.col("v")) / (1 + 2 * F.col("d")) * F.least(F.lit(1.0), F.col("n") / 60)
    return one.select("symbol", F.round(clip(raw, 0.05, 0.5), 6).alias("kelly"), F.when(F.col("n") >= 60, "high").when(F.col("n") >= 30, "medium").otherwise("low").alias("confidence"))
