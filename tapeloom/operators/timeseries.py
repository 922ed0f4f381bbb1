"""Ordered-window operators over bars (symbol, ts, open, high, low, close, volume, amount, outer).

All windows of a call share one partitioning and one sort by (symbol, ts). A symbol's bars are one row per
period, so a partition is bounded by the calendar, not by the ticks beneath.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.safe import clip, corr, div

def W():
    """A symbol's bars in order. Window specifications need a session, so they are made when used."""
    return Window.partitionBy("symbol").orderBy("ts")


def last(k: int):
    """The current row and the k - 1 before it."""
    return W().rowsBetween(1 - k, 0)


def before(k: int):
    """The k rows before the current one."""
    return W().rowsBetween(-k, -1)


def SO_FAR():
    return W().rowsBetween(Window.unboundedPreceding, 0)


def full(k: int, value: Column, default, frame=None) -> Column:
    """value where the frame of k rows is full, else the default."""
    return F.when(F.count(F.lit(1)).over(last(k) if frame is None else frame) >= k, value).otherwise(F.lit(default))


def lag(c: str, k: int = 1) -> Column:
    return F.lag(c, k).over(W())


def returns(bars: DataFrame) -> DataFrame:
    """ret: simple return, 0 on a symbol's first bar; logret: log return, null there; diff: change of close."""
    previous = lag("close")
    return bars.withColumns({"ret": F.coalesce(F.col("close") / previous - 1, F.lit(0.0)), "logret": F.when((F.col("close") > 0) & (previous > 0), F.log(F.col("close") / previous)), "diff": F.col("close") - previous})


def rolling(bars: DataFrame, k: int, p: int = 1) -> DataFrame:
    """ts_delta, ts_max, ts_min, ts_mean, ts_sum and ts_std (sample) of close."""
    c = F.col("close")
    return bars.withColumns({"delta": c - lag("close", p), "hi": F.max(c).over(last(k)), "lo": F.min(c).over(last(k)), "mean": F.avg(c).over(last(k)), "total": F.sum(c).over(last(k)), "std": F.stddev_samp(c).over(last(k))})


def ts_rank(x: str, k: int) -> Column:
    """Share of the full window at or below the current value; 0.5 before it is full."""
    window = F.collect_list(x).over(last(k))
    return full(k, F.size(F.filter(window, lambda v: v <= F.col(x))) / k, 0.5)


def ts_corr(x: str, y: str, k: int) -> Column:
    return full(k, corr(F.col(x), F.col(y), last(k)), 0.0)


def ts_arg(x: str, k: int, largest: bool) -> Column:
    """Zero-based place of the first extreme in the full window; k // 2 before it is full."""
    best = (F.max if largest else F.min)(x).over(last(k))
    return full(k, F.array_position(F.collect_list(x).over(last(k)), best).cast("int") - 1, k // 2)


def momentum(p: int) -> Column:
    return F.coalesce(div(F.col("close"), lag("close", p)) - 1, F.lit(0.0))


def volume_ratio(p: int) -> Column:
    return div(F.col("volume"), F.avg("volume").over(before(p)), 1.0)


def position(x: str, p: int) -> Column:
    """Where x is between the least and largest of the p rows before; 0.5 where those are equal."""
    low, high = F.min(x).over(before(p)), F.max(x).over(before(p))
    return div(F.col(x) - low, high - low, 0.5)


def amihud(p: int) -> Column:
    return F.coalesce(F.avg(div(F.abs(F.col("ret")), F.col("volume"))).over(before(p)), F.lit(0.0))


def skewness(x: str, k: int) -> Column:
    """Bias-corrected, of a full window of k."""
    return full(k, F.coalesce(F.skewness(x).over(last(k)), F.lit(0.0)) * math.sqrt(k * (k - 1)) / (k - 2), 0.0)


def kurtosis(x: str, k: int) -> Column:
    return full(k, ((k - 1) / ((k - 2) * (k - 3))) * ((k + 1) * F.coalesce(F.kurtosis(x).over(last(k)), F.lit(0.0)) + 6), 0.0)


def autocorrelation(k: int) -> Column:
    """Of the returns before the current one: k of them against the k before those."""
    frame = before(k)
    return F.when(F.count(F.col("ret_back")).over(frame) >= k, corr(F.col("ret"), F.col("ret_back"), frame)).otherwise(0.0)


def alpha_factors(bars: DataFrame) -> DataFrame:
    """The price and volume factors over their periods, one select over one sort."""
    b = returns(bars).withColumn("ret_back", F.lag("ret", 10).over(W()))
    out: dict[str, Column] = {}
    for p in (2, 5, 10, 20, 30, 60):
        out[f"momentum_{p}"] = momentum(p)
        out[f"volatility_{p}"] = F.stddev_pop("ret").over(last(p))
    for p in (1, 3, 5):
        out[f"reversal_{p}"] = -momentum(p)
    for p in (5, 10, 20):
        out |= {f"volume_ratio_{p}": volume_ratio(p), f"amihud_{p}": amihud(p), f"price_position_{p}": position("close", p), f"volume_position_{p}": position("volume", p)}
        out[f"volume_price_corr_{p}"] = full(p, corr(F.col("close"), F.col("volume"), before(p)), 0.0, before(p))
    for p in (5, 10):
        out[f"volume_momentum_{p}"] = F.coalesce(div(F.col("volume"), lag("volume", p)) - 1, F.lit(0.0))
    for a, c in ((5, 10), (5, 20), (10, 20)):
        out[f"ma_ratio_{a}_{c}"] = div(F.avg("close").over(before(a)), F.avg("close").over(before(c)), 1.0)
    up, down = F.stddev_pop(F.when(F.col("ret") > 0, F.col("ret"))).over(SO_FAR()), F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret"))).over(SO_FAR())
    out |= {"upside_vol": F.coalesce(up, F.lit(0.0)), "downside_vol": F.coalesce(down, F.lit(0.0)), "vol_ratio": div(up, down, 1.0)}
    out |= {"skew_20": skewness("ret", 20), "kurt_20": kurtosis("ret", 20), "autocorr_10": autocorrelation(10)}
    return b.select("symbol", "ts", *(F.round(v, 6).alias(k) for k, v in out.items()))


def rsi(gain: Column, loss: Column) -> Column:
    """100 - 100 / (1 + gain / loss); 100 where nothing was lost."""
    return F.when(loss > 0, 100 - 100 / (1 + gain / loss)).otherwise(100.0)


def rsi_cutler(p: int) -> Column:
    """Mean gain over mean loss of the last p changes, all of them in both denominators; 50 before there are p."""
    gain, loss = F.greatest(F.col("diff"), F.lit(0.0)), F.greatest(-F.col("diff"), F.lit(0.0))
    return F.when(F.count("diff").over(last(p)) >= p, rsi(F.avg(gain).over(last(p)), F.avg(loss).over(last(p)))).otherwise(50.0)


def rsi_winners(p: int) -> Column:
    """Mean of the positive changes over the mean of the negative ones; without a loss the loss is 0.001."""
    gain, loss = F.avg(F.when(F.col("diff") > 0, F.col("diff"))).over(last(p)), F.avg(F.when(F.col("diff") < 0, -F.col("diff"))).over(last(p))
    return F.when(F.count("diff").over(last(p)) >= p, rsi(F.coalesce(gain, F.lit(0.0)), F.coalesce(loss, F.lit(0.001)))).otherwise(50.0)


def rsi_recent_gains(p: int) -> Column:
    """The sum of the last p changes' gains over the sum of their losses, each by p."""
    gain, loss = F.sum(F.greatest(F.col("diff"), F.lit(0.0))).over(last(p)) / p, F.sum(F.greatest(-F.col("diff"), F.lit(0.0))).over(last(p)) / p
    return F.coalesce(rsi(gain, loss), F.lit(50.0))


def bollinger(bars: DataFrame, k: int = 20, width: float = 2.0) -> DataFrame:
    mean, sd = F.avg("close").over(last(k)), F.stddev_pop("close").over(last(k))
    upper, lower = mean + width * sd, mean - width * sd
    band = div(upper - lower, mean, 0.0)
    return bars.withColumns({"middle": mean, "upper": upper, "lower": lower, "bandwidth": band, "percent_b": div(F.col("close") - lower, upper - lower, 0.5), "squeeze": F.when(band < 0.05, "narrow").when(band > 0.15, "wide").otherwise("normal")})


def true_range(bars: DataFrame) -> DataFrame:
    c = lag("close")
    return bars.withColumn("tr", F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - c), F.lit(0.0)), F.coalesce(F.abs(F.col("low") - c), F.lit(0.0))))


def divergence(k: int = 20) -> Column:
    """Price makes a new extreme over the last k bars against the k before, the indicator `ind` does not."""
    now, then = W().rowsBetween(1 - k, 0), W().rowsBetween(1 - 2 * k, -k)
    there = F.count("ind").over(then) >= k
    top = (F.max("close").over(now) > F.max("close").over(then)) & (F.max("ind").over(now) < F.max("ind").over(then))
    bottom = (F.min("close").over(now) < F.min("close").over(then)) & (F.min("ind").over(now) > F.min("ind").over(then))
    return F.when(there & top, "bearish").when(there & bottom, "bullish").otherwise("none")


def realised(bars: DataFrame) -> DataFrame:
    """Annualised volatility over 5, 20 and 60 log returns, and the downside share of that over 20."""
    r = returns(bars)
    down = F.stddev_pop(F.when(F.col("logret") < 0, F.col("logret"))).over(last(20))
    return r.select("symbol", "ts", *(F.round(F.stddev_pop("logret").over(last(k)) * math.sqrt(252) * 100, 6).alias(f"vol_{k}") for k in (5, 20, 60)), F.round(div(down, F.stddev_pop("logret").over(last(20)), 0.0), 6).alias("downside_ratio"))


def volume_indicators(bars: DataFrame) -> DataFrame:
    r = returns(bars)
    obv = F.sum(F.signum(F.coalesce(F.col("diff"), F.lit(0.0))) * F.col("volume")).over(SO_FAR())
    change = F.coalesce(div(F.col("volume"), lag("volume")) - 1, F.lit(0.0))
    r = r.withColumn("obv", obv).withColumn("vchange", change)
    return r.select(
        "symbol", "ts", F.round("obv", 6).alias("obv"), F.round(F.sum(F.col("volume") * F.col("ret")).over(last(21)), 6).alias("vpt_21"), F.round(div(F.col("volume"), F.avg("volume").over(before(60)), 1.0) - 1, 6).alias("vmom_60"),
        F.round(full(21, corr(F.col("ret"), F.col("vchange"), last(21)), 0.0), 6).alias("vp_change_corr_21"), F.round(div(F.col("high") - F.col("low"), F.col("high") + F.col("low"), 0.0), 6).alias("range_proxy"),
    )


def drawdown(bars: DataFrame) -> DataFrame:
    """Drawdown from the running peak, the worst so far, and how long the present one has lasted."""
    peak = F.max("close").over(SO_FAR())
    d = bars.withColumn("dd", F.col("close") / peak - 1)
    d = d.withColumn("island", F.sum(F.when(F.col("dd") >= 0, 1).otherwise(0)).over(SO_FAR()))
    run = Window.partitionBy("symbol", "island").orderBy("ts")
    return d.select("symbol", "ts", F.round("dd", 6).alias("dd"), F.round(F.min("dd").over(SO_FAR()), 6).alias("max_dd"), F.when(F.col("dd") < 0, F.row_number().over(run) - 1).otherwise(0).alias("dd_bars"))


def labels(bars: DataFrame, horizon: int = 5, cost: float = 0.0015, band: float = 0.02) -> DataFrame:
    """Forward return after cost, and its class; null where the horizon is not reached."""
    forward = F.lead("close", horizon).over(W()) / F.col("close") - 1 - cost
    return bars.select("symbol", "ts", F.round(forward, 6).alias("forward"), F.when(forward > band, 1).when(forward < -band, -1).when(forward.isNotNull(), 0).alias("label"))


def regime(bars: DataFrame) -> DataFrame:
    """Bull, bear, volatile or sideways, by the order of three means and the volatility of the last 20 returns."""
    r = returns(bars)
    a, b, c = (F.avg("close").over(last(k)) for k in (5, 20, 60))
    vol = F.stddev_pop("ret").over(last(20))
    return r.select("symbol", "ts", F.when(vol > 0.5, "volatile").when((a > b) & (b > c), "bull").when((a < b) & (b < c), "bear").otherwise("sideways").alias("regime"), F.round(vol, 6).alias("vol_20"))


def absolute_momentum(bars: DataFrame) -> DataFrame:
    """Close against its means over 50, 100 and 200 bars, weighted, on a ladder, with a bonus above all three."""
    parts = {k: div(F.col("close"), F.avg("close").over(last(k)), 1.0) - 1 for k in (50, 100, 200)}
    score = sum(w * parts[k] for k, w in ((50, 0.2), (100, 0.3), (200, 0.5)))
    above = sum(F.when(parts[k] > 0, 1).otherwise(0) for k in parts)
    return bars.select("symbol", "ts", F.round(score, 6).alias("score"), above.alias("above"), F.when(score > 0.05, "strong_up").when(score > 0, "up").when(score > -0.05, "down").otherwise("strong_down").alias("state"))


def ml_row(bars: DataFrame) -> DataFrame:
    """Twelve features of each bar, defaults before there are 30 of them."""
    r = returns(bars)
    ready = F.count(F.lit(1)).over(SO_FAR()) >= 30
    low, high = F.min("close").over(last(250)), F.max("close").over(last(250))
    made = {
        "mom_1": (momentum(1), 0.0), "mom_3": (momentum(3), 0.0), "mom_5": (momentum(5), 0.0), "mom_10": (momentum(10), 0.0), "volume_ratio": (volume_ratio(20), 1.0), "vol_20": (F.stddev_pop("ret").over(last(20)), 0.02),
        "rsi_14": (rsi_winners(14), 50.0), "ma5_gap": (div(F.col("close"), F.avg("close").over(last(5)), 1.0) - 1, 0.0), "ma20_gap": (div(F.col("close"), F.avg("close").over(last(20)), 1.0) - 1, 0.0),
        "year_position": (div(F.col("close") - low, high - low, 0.5), 0.5), "outer_share": (div(F.col("outer_vol"), F.col("volume"), 0.5), 0.5), "turnover": (div(F.col("volume"), F.avg("volume").over(SO_FAR()), 1.0), 1.0),
    }
    return r.select("symbol", "ts", *(F.round(F.when(ready, v).otherwise(d), 6).alias(k) for k, (v, d) in made.items()))


def sequence_statistics(bars: DataFrame, k: int = 20) -> DataFrame:
    """Mean, deviation, slope and lag correlation of the last k closes, and the worst fall within them."""
    n = F.row_number().over(W()).cast("double")
    b = bars.withColumn("n", n).withColumn("back", lag("close"))
    worst = F.aggregate(F.collect_list("close").over(last(k)), F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("dd")), lambda a, x: F.struct(F.greatest(a.peak, x).alias("peak"), F.least(a.dd, x / F.greatest(a.peak, x) - 1).alias("dd")), lambda a: a.dd)
    slope = div(F.covar_pop("n", "close").over(last(k)), F.var_pop("n").over(last(k)), 0.0)
    return b.select("symbol", "ts", F.round(F.avg("close").over(last(k)) + 1e-9, 6).alias("mean"), F.round(F.stddev_pop("close").over(last(k)) + 1e-9, 6).alias("std"), F.round(slope + 1e-9, 6).alias("slope"), F.round(full(k, corr(F.col("close"), F.col("back"), last(k)), 0.0) + 1e-9, 6).alias("lag_corr"), F.round(worst + 1e-9, 6).alias("worst_fall"))


def breakout(bars: DataFrame, k: int = 20) -> DataFrame:
    high, low = F.max("close").over(before(k)), F.min("close").over(before(k))
    return bars.select("symbol", "ts", F.when(F.col("close") > high * 1.005, "resistance").when(F.col("close") < low * 0.995, "support").otherwise("none").alias("breakout"))


def volatility_target(bars: DataFrame, target: float = 0.15) -> DataFrame:
    """A weight that scales to the target volatility, clamped, and one-day value at risk at 95 %."""
    vol = F.coalesce(F.stddev_pop("logret").over(last(20)) * math.sqrt(252), F.lit(0.0))
    ratio = clip(div(F.lit(target), vol, 1.0), 0.5, 2.0)
    return returns(bars).select("symbol", "ts", F.round(vol, 6).alias("vol"), F.round(ratio, 6).alias("ratio"), F.round(clip(ratio * 0.25, 0.05, 0.5), 6).alias("weight"), F.round(vol * 1.645 / math.sqrt(252), 6).alias("var_95"))


def enumerated(bars: DataFrame, names: list[str]) -> DataFrame:
    """Windowed factors by name: input_operation_period, or input_input_corr_period; one select over one sort."""
    over_window = {"max": F.max, "min": F.min, "mean": F.avg, "sum": F.sum, "std": F.stddev_samp}

    def made(name: str) -> Column:
        *inputs, operation, period = name.split("_")
        k = int(period)
        if operation == "delta":
            return F.col(inputs[0]) - lag(inputs[0], k)
        if operation == "rank":
            return ts_rank(inputs[0], k)
        if operation in ("argmax", "argmin"):
            return ts_arg(inputs[0], k, operation == "argmax")
        if operation == "corr":
            return ts_corr(*inputs, k)
        return over_window[operation](inputs[0]).over(last(k))

    return bars.select("symbol", "ts", *(made(n).alias(n) for n in names))
