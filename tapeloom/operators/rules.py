"""Scalar rules: patterns, signals, sizing and costs. All are projections; none moves a row."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.safe import clip, div


def patterns(bars: DataFrame) -> DataFrame:
    """Candlestick patterns, and a score of 50 with their bonuses."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, span = F.abs(c - o), h - lo
    upper, lower = h - F.greatest(o, c), F.least(o, c) - lo
    share, change = div(body, span, 0.0), div(c - o, o, 0.0)
    found = {"hammer": (lower > 2 * body) & (upper < body), "inverted_hammer": (upper > 2 * body) & (lower < body), "doji": share < 0.1, "big_up": (change > 0.05) & (share > 0.7), "big_down": (change < -0.05) & (share > 0.7), "long_upper": upper > 2 * body, "long_lower": lower > 2 * body}
    bonus = {"hammer": 10, "inverted_hammer": 5, "doji": 0, "big_up": 20, "big_down": -20, "long_upper": -10, "long_lower": 10}
    score = F.lit(50) + sum(F.when(v, bonus[k]).otherwise(0) for k, v in found.items())
    return bars.select("symbol", "ts", F.array_join(F.array_compact(F.array(*(F.when(v, k) for k, v in found.items()))), ",").alias("patterns"), F.round(share, 6).alias("body"), F.greatest(F.lit(0), F.least(F.lit(100), score)).alias("score"))


def volume_signal(bars: DataFrame) -> DataFrame:
    """Outer against inner volume and its pressure, by bands."""
    ratio = div(F.col("outer_vol"), F.col("volume") - F.col("outer_vol"), 9.99)
    return bars.select("symbol", "ts", F.round(ratio, 6).alias("ratio"), F.when(ratio > 1.3, "buyers").when(ratio < 0.7, "sellers").otherwise("balanced").alias("side"), F.when(ratio >= 3, 5).when(ratio >= 2, 4).when(ratio >= 1, 3).when(ratio >= 0.7, 2).when(ratio >= 0.5, 1).otherwise(0).alias("pressure"))


def combine(a: Column, b: Column) -> Column:
    """Two signals in one: those that agree are strong, a hold yields, a conflict holds."""
    return F.when((a == b) & (a != "hold"), F.concat(F.lit("strong_"), a)).when(a == "hold", b).when(b == "hold", a).otherwise("hold")


def kelly(p: Column, b: Column, vol: Column, low: float = 0.05, high: float = 0.25) -> Column:
    """Half of p - (1 - p) / b, scaled down by volatility over a tenth, clamped."""
    return clip((p - div(1 - p, b, 0.0)) / 2 * clip(1 - 2 * (vol - 0.1), 0.5, 1.5), low, high)


def liquidity(hour: Column) -> Column:
    """Factor of a session's hour on slippage and impact."""
    return F.when(hour < 10, 1.2).when(hour < 11.5, 1.1).when(hour < 14, 1.3).otherwise(1.4)


def cost_parts(side: Column, value: Column, share: Column, liquid: Column, vol: float = 0.02) -> dict[str, Column]:
    """Commission, stamp tax, slippage and impact of an order of that value, at that share of a day's volume."""
    return {
        "commission": F.greatest(value * 0.0003, F.lit(5.0)),
        "stamp": F.when(side == "sell", value * 0.001).otherwise(0.0),
        "slippage": value * 0.0002 * (1 + F.log2(1 + share)) * liquid,
        "impact": 0.0001 * F.sqrt(share) * vol * value * liquid,
    }


def board_limit(code: Column) -> Column:
    """The daily limit of a listing by its code's longest known prefix."""
    # fixed values: boards with a limit of 20 % and of 30 %; all others have 10 %
    return F.when(code.startswith("688") | code.startswith("689") | code.startswith("300") | code.startswith("301"), 0.2).when(code.startswith("8") | code.startswith("4"), 0.3).otherwise(0.1)


def at_limit(price: Column, previous: Column, limit: Column) -> Column:
    return F.when(price >= F.round(previous * (1 + limit), 2) - 0.01, "up").when(price <= F.round(previous * (1 - limit), 2) + 0.01, "down").otherwise("free")


def lots(quantity: Column) -> Column:
    return F.floor(quantity / 100) * 100


def stop_levels(bars: DataFrame) -> DataFrame:
    """Stop, take-profit and trailing distance of a bar with atr; without one, two in a hundred of the price stand for it."""
    a = F.coalesce(F.col("atr"), F.col("close") * 0.02)
    level = div(a, F.col("close"), 0.0)
    m = F.when(level > 0.5, 3.0).when(level > 0.2, 2.5).otherwise(2.0)
    return bars.select("symbol", "ts", (F.col("close") - a * m).alias("stop"), (F.col("close") + a * m * 1.5).alias("target"), m.alias("multiplier"))


def fund_flow(bars: DataFrame) -> DataFrame:
    """Estimated flow by size of trade, and net flow with its band."""
    lot = div(F.col("amount"), F.col("volume"), 0.0)
    big, mid = F.when(lot > 2000, 0.6).when(lot > 500, 0.3).otherwise(0.15), F.when(lot > 2000, 0.3).when(lot > 500, 0.5).otherwise(0.35)
    net = F.col("amount") * div(2 * F.col("outer_vol") - F.col("volume"), F.col("volume"), 0.0)
    return bars.select("symbol", "ts", F.round(F.col("amount") * big, 2).alias("large"), F.round(F.col("amount") * mid, 2).alias("medium"), F.round(F.col("amount") * (1 - big - mid), 2).alias("small"), F.round(net, 2).alias("net"), F.when(net > 0, "in").when(net < 0, "out").otherwise("flat").alias("direction"))


def heat(bars: DataFrame, dims: DataFrame) -> DataFrame:
    """Net flow by sector and industry with subtotals; an extension beyond parity is the rollup."""
    flow = fund_flow(bars).join(dims, "symbol").rollup("sector", "industry").agg(F.round(F.sum("net"), 0).alias("net"), F.countDistinct("symbol").alias("symbols"))
    return flow.select("sector", "industry", "net", "symbols", F.when(F.col("net") > 0, "hot").when(F.col("net") < 0, "cold").otherwise("flat").alias("level"))


def board(code: Column) -> Column:
    """The board of a listing by the prefix of its code."""
    # fixed values: prefixes of boards
    growth, innovation, small, north = ("300", "301"), ("688", "689"), ("002", "003"), ("8", "4")
    starts = lambda known: reduce(or_, (code.startswith(k) for k in known))
    return F.when(starts(innovation), "innovation").when(starts(growth), "growth").when(starts(small), "small").when(starts(north), "north").otherwise("main")


def board_heat(bars: DataFrame, code: Column) -> DataFrame:
    """Net flow of each board in percent of its amount, on a ladder; summed map-side, a row for each board."""
    net = F.col("amount") * div(2 * F.col("outer_vol") - F.col("volume"), F.col("volume"), 0.0)
    flow = bars.select(board(code).alias("board"), "amount", net.alias("net")).groupBy("board").agg(F.count("*").alias("bars"), div(100 * F.sum("net"), F.sum("amount"), 0.0).alias("flow"))
    level = F.when(F.col("flow") > 30, "strong_inflow").when(F.col("flow") > 10, "moderate_inflow").when(F.col("flow") > -10, "neutral").when(F.col("flow") > -30, "moderate_outflow").otherwise("strong_outflow")
    return flow.select("board", "bars", F.round("flow", 5).alias("flow"), level.alias("level"))
