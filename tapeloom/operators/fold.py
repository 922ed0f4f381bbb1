"""Recursive scans: state(t) = f(state(t - 1), row(t)) along each symbol's bars.

A symbol's bars are gathered into an array, in order, and folded inside the JVM; the states come back as rows.
A series has a bar per period, so its array is bounded by the calendar. One shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.safe import div
from tapeloom.operators.timeseries import W, true_range


#: Bars that are folded before their states are put aside.
CHUNK = 512


def fold(bars: DataFrame, columns: list[str], start: dict[str, Column], step: Callable[[Column, Column], dict[str, Column]], runs: Column | None = None) -> DataFrame:
    """symbol, ts and the state after each bar. step gets the state and the bar (with `i`, its place from 0).

    runs is an array of settings: a series is gathered once and folded for each of them, which step reads as column `run`, and which the rows carry.
    """
    series = bars.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("ts", *columns))).alias("bars"))
    series = series.withColumn("bars", F.transform("bars", lambda x, i: F.struct(i.alias("i"), *(x[c].alias(c) for c in ["ts", *columns]))))
    state = lambda values: F.struct(*(v.cast("double").alias(k) for k, v in values.items()))
    kind = ",".join(f"{k}:double" for k in start)
    none = F.array().cast(f"array<struct<{kind}>>")
    # one more state, worked out once and put at the end
    add = lambda acc, x: F.get(F.transform(F.array(state(step(acc.s, x))), lambda s: F.struct(s.alias("s"), F.concat(acc.out, F.array(s)).alias("out"))), F.lit(0))
    series = series.withColumn("bars", F.transform(F.sequence(F.lit(0), F.floor((F.size("bars") - 1) / CHUNK).cast("int")), lambda k: F.slice("bars", k * CHUNK + 1, CHUNK)))
    if runs is not None:
        series = series.withColumn("run", F.explode(runs))
    kept = ["symbol"] if runs is None else ["symbol", "run"]
    # by chunks: a chunk's states are copied as it grows, and the chunks are joined at the end
    chunk = lambda acc, part: F.aggregate(part, F.struct(acc.s.alias("s"), none.alias("out")), add, lambda a: F.struct(a.s.alias("s"), F.concat(acc.outs, F.array(a.out)).alias("outs")))
    out = F.aggregate("bars", F.struct(state(start).alias("s"), F.array().cast(f"array<array<struct<{kind}>>>").alias("outs")), chunk, lambda acc: F.flatten(acc.outs))
    series = series.select(*kept, F.flatten("bars").alias("bars"), out.alias("state"))
    return series.select(*kept, F.explode(F.arrays_zip(F.col("bars.ts").alias("ts"), "state")).alias("row")).select(*kept, "row.ts", "row.state.*")


def zero() -> Column:
    return F.lit(0.0)


def ema(span: int, state: Column, x: Column, i: Column) -> Column:
    """Seeded with the first value."""
    return F.when(i == 0, x).otherwise(state + (x - state) * (2.0 / (span + 1)))


def ema_series(bars: DataFrame, span: int) -> DataFrame:
    return fold(bars, ["close"], {"ema": zero()}, lambda s, x: {"ema": ema(span, s.ema, x.close, x.i)})


def macd(bars: DataFrame) -> DataFrame:
    """dif, dea and hist (dif - dea; twice that in another convention) of 12, 26 and 9."""

    def step(s: Column, x: Column) -> dict[str, Column]:
        fast, slow = ema(12, s.fast, x.close, x.i), ema(26, s.slow, x.close, x.i)
        return {"fast": fast, "slow": slow, "dea": ema(9, s.dea, fast - slow, x.i)}

    out = fold(bars, ["close"], {"fast": zero(), "slow": zero(), "dea": zero()}, step)
    return out.select("symbol", "ts", (F.col("fast") - F.col("slow")).alias("dif"), "dea", (F.col("fast") - F.col("slow") - F.col("dea")).alias("hist"))


def macd_cross(bars: DataFrame) -> DataFrame:
    """The histogram's change of sign."""
    back = F.lag("hist").over(W())
    return macd(bars).select("symbol", "ts", F.round("hist", 4).alias("hist"), F.when((back <= 0) & (F.col("hist") > 0), "golden").when((back >= 0) & (F.col("hist") < 0), "death").otherwise("none").alias("cross"))


def wilder(p: int, state: Column, x: Column, i: Column, first: int) -> Column:
    """Seeded with the mean of the p values from place `first`; up to there the state is their running sum over p."""
    return F.when(i < first, 0.0).when(i < first + p, state + x / p).otherwise((state * (p - 1) + x) / p)


def rsi_wilder(bars: DataFrame, p: int = 14) -> DataFrame:
    """50 until p changes are seen."""
    b = bars.withColumn("d", F.coalesce(F.col("close") - F.lag("close").over(W()), F.lit(0.0)))
    out = fold(b, ["d"], {"gain": zero(), "loss": zero(), "n": zero()}, lambda s, x: {"gain": wilder(p, s.gain, F.greatest(x.d, F.lit(0.0)), x.i, 1), "loss": wilder(p, s.loss, F.greatest(-x.d, F.lit(0.0)), x.i, 1), "n": x.i})
    value = F.when(F.col("n") < p, 50.0).when(F.col("loss") > 0, 100 - 100 / (1 + F.col("gain") / F.col("loss"))).otherwise(100.0)
    return out.select("symbol", "ts", value.alias("rsi"))


def atr_wilder(bars: DataFrame, p: int = 14) -> DataFrame:
    out = fold(true_range(bars), ["tr"], {"atr": zero(), "n": zero()}, lambda s, x: {"atr": wilder(p, s.atr, x.tr, x.i, 0), "n": x.i})
    return out.select("symbol", "ts", F.when(F.col("n") >= p - 1, F.col("atr")).alias("atr"))


def adx(bars: DataFrame, p: int = 14) -> DataFrame:
    """Directional movement, Wilder-smoothed, and the mean of the last p directional indices."""
    up, down = F.col("high") - F.lag("high").over(W()), F.lag("low").over(W()) - F.col("low")
    b = true_range(bars).withColumns({"plus": F.when((up > down) & (up > 0), up).otherwise(0.0), "minus": F.when((down > up) & (down > 0), down).otherwise(0.0)})
    out = fold(b, ["tr", "plus", "minus"], {"tr": zero(), "plus": zero(), "minus": zero(), "n": zero()}, lambda s, x: {k: wilder(p, s[k], x[k], x.i, 1) for k in ("tr", "plus", "minus")} | {"n": x.i})
    plus, minus = div(F.col("plus") * 100, F.col("tr"), 50.0), div(F.col("minus") * 100, F.col("tr"), 50.0)
    out = out.withColumns({"plus_di": plus, "minus_di": minus, "dx": F.coalesce(div(100 * F.abs(plus - minus), plus + minus), F.lit(0.0))})
    return out.select("symbol", "ts", "plus_di", "minus_di", F.avg(F.when(F.col("n") >= p, F.col("dx"))).over(W().rowsBetween(1 - p, 0)).alias("adx"))


def garch(bars: DataFrame, omega: float = 1e-6, alpha: float = 0.05, beta: float = 0.94) -> DataFrame:
    """Variance filtered with fixed coefficients from the long-run variance on, and its five-step forecast."""
    long_run = omega / (1 - alpha - beta)
    b = bars.withColumn("r", F.coalesce(F.when((F.col("close") > 0) & (F.lag("close").over(W()) > 0), F.log(F.col("close") / F.lag("close").over(W()))), F.lit(0.0)))
    out = fold(b, ["r"], {"v": F.lit(long_run), "r": zero()}, lambda s, x: {"v": F.when(x.i == 0, F.lit(long_run)).otherwise(omega + alpha * s.r * s.r + beta * s.v), "r": x.r})
    return out.select("symbol", "ts", F.col("v").alias("variance"), (long_run + (alpha + beta) ** 5 * (F.col("v") - long_run)).alias("forecast_5"))


def trailing_stop(bars: DataFrame, share: float = 0.1) -> DataFrame:
    """A long position that is bought on the first bar or the one after a stop, with a stop that follows its peak."""
    def step(s: Column, x: Column) -> dict[str, Column]:
        held = s.peak > 0
        peak = F.when(held, F.greatest(s.peak, x.close)).otherwise(x.close)
        hit = held & (x.close < peak * (1 - share))
        return {"peak": F.when(hit, 0.0).otherwise(peak), "entry": F.when(hit, 0.0).when(held, s.entry).otherwise(x.close), "pnl": s.pnl + F.when(hit, x.close / s.entry - 1).otherwise(0.0), "trades": s.trades + F.when(hit, 1.0).otherwise(0.0)}

    return fold(bars, ["close"], {"peak": zero(), "entry": zero(), "pnl": zero(), "trades": zero()}, step)


def advantages(rows: DataFrame, gamma: float = 0.99, lam: float = 0.95) -> DataFrame:
    """Generalised advantages: a fold from a series' end. rows: symbol, ts, reward, value."""
    b = rows.withColumns({"delta": F.col("reward") + gamma * F.coalesce(F.lead("value").over(W()), F.lit(0.0)) - F.col("value"), "back": F.row_number().over(W()) * -1})
    back = b.select("symbol", F.col("back").alias("ts"), "delta", F.col("ts").alias("at"))
    out = fold(back, ["delta", "at"], {"advantage": zero()}, lambda s, x: {"advantage": x.delta + gamma * lam * s.advantage})
    return out.join(back.select("symbol", "ts", "at"), ["symbol", "ts"]).select("symbol", F.col("at").alias("ts"), "advantage")
