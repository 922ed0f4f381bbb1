"""Back-tests: one-asset strategies as folds, parameter grids, walk-forward choice, event orders, and the portfolio that shares its cash.

What a symbol does on its own is a fold along its bars, or windows where no state is carried. Only the portfolio with
one purse couples symbols: it is folded by date over the orders of that date, for each strategy apart.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.safe import div
from tapeloom.operators.fold import fold, zero
from tapeloom.operators.timeseries import W, last, returns

#: Short means that a grid tries, and the long one.
SHORT, LONG = (2, 3, 5), 10


def strategy(bars: DataFrame, buy: float = 45.0, sell: float = 60.0, stop: float = 0.05, take: float = 0.15) -> DataFrame:
    """A position that is entered on strength (rsi below buy, above its mean, hist above 0) and left by a stop, a target or weakness."""

    def step(s: Column, x: Column) -> dict[str, Column]:
        held = s.entry > 0
        gain = F.coalesce(div(x.close, s.entry), F.lit(1.0)) - 1
        leave = held & ((gain < -stop) | (gain > take) | ((x.rsi > sell) & (x.hist < 0)))
        enter = ~held & (x.close > x.mean) & (x.rsi < buy) & (x.hist > 0)
        return {"entry": F.when(leave, 0.0).when(enter, x.close).otherwise(s.entry), "pnl": s.pnl + F.when(leave, gain).otherwise(0.0), "trades": s.trades + F.when(leave, 1.0).otherwise(0.0), "wins": s.wins + F.when(leave & (gain > 0), 1.0).otherwise(0.0)}

    return fold(bars, ["close", "rsi", "hist", "mean"], {"entry": zero(), "pnl": zero(), "trades": zero(), "wins": zero()}, step)


def grid(bars: DataFrame) -> DataFrame:
    """Returns of holding while a short mean is above the long one, for each of the grid's short means: windows, no state."""
    r = returns(bars)
    long = F.avg("close").over(last(LONG))
    r = r.withColumns({f"on_{k}": F.when(F.avg("close").over(last(k)) > long, 1.0).otherwise(0.0) for k in SHORT})
    r = r.select("symbol", "ts", "ret", F.row_number().over(W()).alias("rn"), *(F.coalesce(F.lag(f"on_{k}").over(W()), F.lit(0.0)).alias(f"on_{k}") for k in SHORT))
    runs = F.explode(F.array(*(F.struct(F.lit(k).alias("short"), (F.col(f"on_{k}") * F.col("ret")).alias("gain")) for k in SHORT)))
    return r.select("symbol", "ts", "rn", runs.alias("g")).select("symbol", "ts", "rn", "g.short", "g.gain")


def sensitivity(runs: DataFrame) -> DataFrame:
    """Each parameter's total, mean, deviation and ratio by symbol."""
    one = runs.groupBy("symbol", "short").agg((F.exp(F.sum(F.log1p("gain"))) - 1).alias("total"), F.avg("gain").alias("mean"), F.stddev_pop("gain").alias("sd"))
    return one.withColumn("sharpe", div(F.col("mean"), F.col("sd"), 0.0))


def chosen(runs: DataFrame, train: int = 40) -> DataFrame:
    """The parameter that is best on a symbol's first bars, and what it makes on the others."""
    best = sensitivity(runs.filter(F.col("rn") <= train)).groupBy("symbol").agg(F.max_by("short", F.struct(F.round("sharpe", 9), -F.col("short"))).alias("short"))
    return runs.filter(F.col("rn") > train).join(best, ["symbol", "short"]).groupBy("symbol", "short").agg(F.count("*").alias("bars"), (F.exp(F.sum(F.log1p("gain"))) - 1).alias("after"))


#: Stops, targets and lengths of the mean that the grid combines: fixed values.
STOPS, TAKES, MEANS = (0.03, 0.05, 0.07), (0.06, 0.10, 0.15), (10, 20, 30)
#: By number from 0: stop, target, length of the mean.
Settings = Sequence[tuple[float, float, int]]


def whole_grid() -> Settings:
    """All combinations, the last part changing fastest."""
    return list(itertools.product(STOPS, TAKES, MEANS))


def drawn(n: int = 20, seed: int = 42) -> Settings:
    """n settings drawn evenly from between the grid's least and greatest values, the same for a seed."""
    rng = random.Random(seed)
    return [(round(rng.uniform(STOPS[0], STOPS[-1]), 6), round(rng.uniform(TAKES[0], TAKES[-1]), 6), rng.randint(MEANS[0], MEANS[-1])) for _ in range(n)]


def tried(bars: DataFrame, settings: Settings) -> DataFrame:
    """symbol, run (no, stop, take, mean), ts, gain: what each bar brings a position that is entered at a close above the mean, and left at one past the stop or the target or below the mean.

    A symbol's bars are gathered once and folded for each setting in the JVM. A mean of fewer bars than its length is that of the bars there are.
    """
    lengths = sorted({k for _, _, k in settings})
    b = bars.select("symbol", "ts", "close", F.lag("close").over(W()).alias("prev"), F.array(*(F.avg("close").over(last(k)) for k in lengths)).alias("means"))
    runs = F.array(*(F.struct(F.lit(no).alias("no"), F.lit(s).alias("stop"), F.lit(t).alias("take"), F.lit(k).alias("mean"), F.lit(lengths.index(k)).alias("at")) for no, (s, t, k) in enumerate(settings)))

    def step(s: Column, x: Column) -> dict[str, Column]:
        held, mean = s.entry > 0, F.get(x.means, F.col("run.at"))
        made = F.coalesce(div(x.close, s.entry), F.lit(1.0)) - 1
        leave = held & ((made < -F.col("run.stop")) | (made > F.col("run.take")) | (x.close < mean))
        return {"entry": F.when(leave, 0.0).when(~held & (x.close > mean), x.close).otherwise(s.entry), "gain": F.when(held, F.coalesce(div(x.close, x.prev), F.lit(1.0)) - 1).otherwise(0.0)}

    return fold(b, ["close", "prev", "means"], {"entry": zero(), "gain": zero()}, step, runs).select("symbol", "run", "ts", "gain")


def walked(gains: DataFrame, train: int = 60, test: int = 20) -> DataFrame:
    """symbol, window (from 0), run, of the setting that is best on the window's `train` bars by its ratio (the first of equals), with that ratio, and what it makes on the `test` bars after them.

    Every window of every setting is a difference of running sums, so no bar is read once a window: one sort by symbol and setting.
    """
    w = Window.partitionBy("symbol", "run").orderBy("ts")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    sums = {"logs": F.log1p("gain"), "ones": F.col("gain"), "squares": F.col("gain") * F.col("gain")}
    q = gains.select("symbol", "run", "ts", F.row_number().over(w).alias("rn"), *(F.sum(v).over(so_far).alias(k) for k, v in sums.items()))
    back = lambda c, k: F.coalesce(F.lag(c, k).over(w), F.lit(0.0))
    q = q.select("symbol", "run", "rn", F.expm1(F.col("logs") - back("logs", test)).alias("after"), *(((back(c, test) - back(c, train + test)) / train).alias(c) for c in ("ones", "squares")))
    q = q.filter((F.col("rn") >= train + test) & ((F.col("rn") - train) % test == 0)).withColumn("window", ((F.col("rn") - train) / test - 1).cast("long"))
    best = F.max_by(F.struct("run", "ratio", "after"), F.struct("ratio", (-F.col("run.no")).alias("first"))).alias("b")
    return q.withColumn("ratio", ratio_of(F.col("ones"), F.col("squares"))).groupBy("symbol", "window").agg(best).select("symbol", "window", "b.run", "b.ratio", "b.after")


def ratio_of(mean: Column, square: Column) -> Column:
    """Mean over deviation, to nine digits; 0 where nothing varies."""
    spread = square - mean * mean
    return F.when(spread > 1e-14, F.round(mean / F.sqrt(spread), 9)).otherwise(0.0)


def best_setting(gains: DataFrame) -> DataFrame:
    """symbol, run, ratio, total: the setting that is best over all of a symbol's bars, the first of equals."""
    one = gains.groupBy("symbol", "run").agg(ratio_of(F.avg("gain"), F.avg(F.col("gain") * F.col("gain"))).alias("ratio"), F.expm1(F.sum(F.log1p("gain"))).alias("total"))
    return one.groupBy("symbol").agg(F.max_by(F.struct("run", "ratio", "total"), F.struct("ratio", (-F.col("run.no")).alias("first"))).alias("b")).select("symbol", "b.run", "b.ratio", "b.total")


def order_fills(orders: DataFrame) -> DataFrame:
    """Orders (side, kind, price, level, open, high, low) -> fill price, or null: market at the open with slippage, limits and stops where the bar reaches their level."""
    buy = F.col("side") == "buy"
    slip = F.when(buy, 1.001).otherwise(0.999)
    limit = F.when(buy & (F.col("low") <= F.col("level")), F.least("open", "level")).when(~buy & (F.col("high") >= F.col("level")), F.greatest("open", "level"))
    stop = F.when(buy & (F.col("high") >= F.col("level")), F.greatest("open", "level") * slip).when(~buy & (F.col("low") <= F.col("level")), F.least("open", "level") * slip)
    return orders.withColumn("fill", F.when(F.col("kind") == "market", F.col("open") * slip).when(F.col("kind") == "limit", limit).otherwise(stop))


LOT, SHARE, PURSE = 100, 0.1, 1_000_000.0
PORTFOLIO_SCHEMA = "strategy string, ts timestamp_ntz, cash double, value double, trades long"


def purse(strategy: str, rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (ts, symbol, price, side) in order of ts and symbol -> (strategy, ts, cash, value, trades) of each date.

    A buy takes a tenth of the cash there is, in whole lots, at cost; a sale sells what was not bought the same day.
    """
    cash, held, last_price, trades = PURSE, {}, {}, 0
    day, bought = None, {}

    def close():
        return strategy, day, cash, cash + sum(n * last_price[s] for s, n in held.items()), trades

    for ts, symbol, price, side in rows:
        if ts != day:
            if day is not None:
                yield close()
            day, bought = ts, {}
        last_price[symbol] = price
        if side == "buy":
            shares = int(cash * SHARE / price) // LOT * LOT
            spent = price * shares
            cost = spent + max(spent * 0.0003, 5.0) + spent * 0.001
            if shares and cost <= cash:
                cash -= cost
                held[symbol] = held.get(symbol, 0) + shares
                bought[symbol] = bought.get(symbol, 0) + shares
                trades += 1
        elif side == "sell":
            shares = held.get(symbol, 0) - bought.get(symbol, 0)
            if shares > 0:
                got = price * shares
                cash += got - max(got * 0.0003, 5.0) - got * 0.001 - got * 0.001
                held[symbol] -= shares
                trades += 1
    if day is not None:
        yield close()


def portfolio(orders: DataFrame) -> DataFrame:
    """strategy, ts, symbol, price, side -> the purse of each strategy by date. Strategies run side by side; one is in order by its nature.

    Rows stream through a task in order: only cash, holdings and last prices are kept.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def rows():
            for b in batches:
                yield from b[["strategy", "ts", "symbol", "price", "side"]].itertuples(index=False, name=None)

        pending = rows()
        first = next(pending, None)
        while first is not None:
            name, following = first[0], []

            def own(start=first, name=name, following=following):
                yield start[1:]
                for r in pending:
                    if r[0] != name:
                        following.append(r)
                        return
                    yield r[1:]

            yield pd.DataFrame(list(purse(name, own())), columns=[c.split()[0] for c in PORTFOLIO_SCHEMA.split(", ")])
            first = following[0] if following else None

    return orders.repartition("strategy").sortWithinPartitions("strategy", "ts", "symbol").mapInPandas(run, PORTFOLIO_SCHEMA)


def cut_scan(rows: DataFrame, window: int = 40, side: int = 5, delta: float = 0.002) -> DataFrame:
    """The first cut of each symbol's last window whose sides' means differ by more than their bound: prefix sums, no loop."""
    back = rows.select("symbol", "ts", "x", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts"))).alias("back")).filter(F.col("back") <= window)
    whole, so_far = Window.partitionBy("symbol"), W().rowsBetween(Window.unboundedPreceding, 0)
    q = back.select("symbol", "ts", F.count("*").over(so_far).alias("n0"), F.sum("x").over(so_far).alias("s0"), F.count("*").over(whole).alias("m"), F.sum("x").over(whole).alias("s"))
    n0, n1 = F.col("n0"), F.col("m") - F.col("n0")
    q = q.filter((n0 >= side) & (n1 >= side) & (n0 <= F.floor(F.col("m") / 2)))
    bound = F.sqrt((n0 + n1) / (2.0 * n0 * n1) * F.log(4 * F.log(F.col("m").cast("double")) / delta))
    gap = F.abs(F.col("s0") / n0 - (F.col("s") - F.col("s0")) / n1)
    return q.groupBy("symbol").agg(F.round(F.max(gap), 6).alias("gap"), F.min(F.when(gap > bound, F.col("n0"))).alias("cut"), F.max(F.when(gap > bound, 1).otherwise(0)).alias("drifted"))


def learning_rate(rows: DataFrame, base: float = 0.01) -> DataFrame:
    """A rate that is halved on a drift and recovers by a hundredth a bar, and an online mean and signal weight beside it. rows: drifted, x, won."""

    def step(s: Column, x: Column) -> dict[str, Column]:
        return {
            "rate": F.when(x.drifted > 0, F.greatest(F.lit(base * 0.1), s.rate * 0.5)).otherwise(F.least(F.lit(base), s.rate * 1.01)),
            "mean": F.when(x.i == 0, x.x).otherwise(s.mean * 0.99 + x.x * 0.01),
            "weight": F.greatest(F.lit(0.1), F.least(F.lit(2.0), s.weight * F.when(x.won > 0, 1.05).otherwise(0.95))),
        }

    return fold(rows, ["drifted", "x", "won"], {"rate": F.lit(base), "mean": zero(), "weight": F.lit(1.0)}, step)


def smoothed_weights(rows: DataFrame, alpha: float = 0.3) -> DataFrame:
    """symbol (the key), ts, w -> weights that move by alpha toward the new ones, brought to a sum of 1 by date."""
    out = fold(rows, ["w"], {"smooth": zero()}, lambda s, x: {"smooth": F.when(x.i == 0, x.w).otherwise(alpha * x.w + (1 - alpha) * s.smooth)})
    total = out.groupBy("ts").agg(F.sum("smooth").alias("total"))
    return out.join(total, "ts").select("symbol", "ts", div(F.col("smooth"), F.col("total"), 0.0).alias("weight"))
