"""Composites of several operators: a whole reading of strength, of a holding, of drift, and the event engine with its risk checks.

Defined results: a null close counts as no change; a symbol with fewer bars than a part needs gets that part's stated value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.operators import engines
from tapeloom.operators.fold import ema, fold, wilder, zero
from tapeloom.operators.steps import points, rules
from tapeloom.operators.timeseries import W, last

#: Each value only once a symbol has the bars that it needs, and a stated one before.
GUARDS = rules(
    {
        "strength_15": "CASE WHEN rn >= 15 THEN rsi ELSE 50.0 END", "vol_20": "CASE WHEN rn >= 20 THEN vol ELSE 0.2 END", "momentum_21": "CASE WHEN rn >= 21 THEN mom20 ELSE 0.0 END",
        "mean_30": "CASE WHEN rn >= 30 THEN ret_mean ELSE 0.0 END", "middle_35": "CASE WHEN rn >= 35 THEN ma20 ELSE close END", "middle_60": "CASE WHEN rn >= 60 THEN ma60 ELSE close END",
    },
    out="strength_15:5 vol_20:6 momentum_21:6 mean_30:6 middle_35:5 middle_60:5",
)

#: Over a snapshot with wilder, the smoothed strength, and wilder5, that of five bars before.
STRENGTH = rules(
    {"spot": "coalesce((close - year_low) / nullif(year_high - year_low, 0), 0.5)", "speed": "coalesce(wilder - wilder5, 0.0)", "mean": "(rsi6 + rsi14 + rsi25 + rsi60) / 4"},
    {"trend": "CASE WHEN spot > 0.6 THEN 'up' WHEN spot < 0.4 THEN 'down' ELSE 'neutral' END", "spread": "sqrt((power(rsi6 - mean, 2) + power(rsi14 - mean, 2) + power(rsi25 - mean, 2) + power(rsi60 - mean, 2)) / 4)"},
    {"shift": points(0, ("vol > 0.25", -5), ("vol < 0.1", 5), ("trend = 'up'", 5), ("trend = 'down'", -5))},
    {"oversold": "30 + shift", "overbought": "70 + shift"},
    {"signal": "CASE WHEN wilder >= overbought THEN 'overbought' WHEN wilder >= overbought - 5 THEN 'near_overbought' WHEN wilder <= oversold THEN 'oversold' WHEN wilder <= oversold + 5 THEN 'near_oversold' ELSE 'neutral' END"},
    {
        "force": "CASE WHEN wilder >= overbought + 5 OR wilder <= oversold - 5 THEN 'strong' WHEN signal = 'neutral' THEN 'neutral' ELSE 'moderate' END",
        "advice": "CASE WHEN signal = 'oversold' AND speed > 0 THEN 'buy_the_bounce' WHEN signal = 'oversold' THEN 'watch_to_buy' WHEN signal = 'overbought' AND speed < 0 THEN 'reduce' WHEN signal = 'overbought' THEN 'beware' WHEN speed > 3 THEN 'hold_or_add' WHEN speed < -3 THEN 'trim_and_watch' ELSE 'watch' END",
        "consensus": "CASE WHEN mean > 50 THEN 'bullish' ELSE 'bearish' END", "divergence": "CASE WHEN spread > 10 THEN 'high' WHEN spread > 5 THEN 'low' ELSE 'none' END",
    },
    out="wilder:2 speed:2 trend oversold overbought signal force advice mean:4 spread:4 consensus divergence",
)

#: Over a snapshot with cost and held, pe and the industry's, wilder and wilder5, and the filtered variance.
HOLDING = rules(
    {
        "profit": "close - cost", "profit_share": "coalesce(close / nullif(cost, 0) - 1, 0.0) * 100", "annual": "CASE WHEN rn < 20 THEN 0.2 ELSE sqrt(variance * 12) END", "spot": "coalesce((close - year_low) / nullif(year_high - year_low, 0), 0.5)",
        "pressure": "coalesce(outer_vol / nullif(inner_vol, 0), 1.0)", "wide": "coalesce(sd, 0.0) > close * 0.08", "risk": "coalesce(sd / nullif(close, 0), 0.15)", "pe_ratio": "coalesce(pe / nullif(industry_pe, 0), 1.0)", "speed": "coalesce(wilder - wilder5, 0.0)",
    },
    {
        "momentum_score": "(least(10.0, greatest(0.0, change / 5)) + spot * 10) / 2", "value_score": "CASE WHEN pe > 0 THEN greatest(0.0, 10 - pe / 30) ELSE 5.0 END", "calm_score": "(greatest(0.0, 10 - turnover / 30) + greatest(0.0, 10 - abs(change) / 2)) / 2",
        "volume_score": "CASE WHEN pressure > 1.2 THEN 8.0 WHEN pressure > 1.0 THEN 6.0 ELSE 4.0 END",
        "mood_score": "(CASE WHEN change > 5 THEN 8.0 WHEN change > 0 THEN 6.0 WHEN change > -5 THEN 4.0 ELSE 2.0 END + CASE WHEN turnover > 300 THEN 7.0 WHEN turnover > 150 THEN 6.0 ELSE 5.0 END) / 2",
    },
    {
        "composite": "momentum_score * CASE WHEN wide THEN 0.3 ELSE 0.25 END + value_score * CASE WHEN wide THEN 0.15 ELSE 0.2 END + calm_score * 0.15 + volume_score * 0.2 + mood_score * 0.1 + 0.7",
        "position": "greatest(0.05, least(0.25, (0.55 - 0.45 / 2.0) / 2 * greatest(0.5, least(1.5, 1 - 2 * (risk - 0.1)))))", "target": "close * (0.35 * 1.36 + 0.45 * 1.11 + 0.2 * 0.84)",
        "level": "CASE WHEN pe <= 0 THEN 'loss' WHEN pe_ratio < 0.8 THEN 'cheap' WHEN pe_ratio < 1.2 THEN 'fair' ELSE 'dear' END", "state": "CASE WHEN annual < 0.1 THEN 'low' WHEN annual < 0.2 THEN 'normal' WHEN annual < 0.35 THEN 'high' ELSE 'very_high' END",
        "absolute": "CASE WHEN mom20 > 0 THEN 'up' ELSE 'down' END", "strength": "CASE WHEN wilder >= 70 THEN 'overbought' WHEN wilder <= 30 THEN 'oversold' ELSE 'neutral' END",
    },
    {"upside": "coalesce(target / nullif(close, 0) - 1, 0.0) * 100", "status": "CASE WHEN profit > 0 THEN 'profit' ELSE 'loss' END"},
    out="composite:4 position:6 target:3 upside:4 level state absolute strength speed:2 annual:5 profit:3 profit_share:4 status",
)


def technical_features(bars: DataFrame, p: int = 14, window: int = 20, wide: float = 2.0) -> DataFrame:
    """Averages, their difference and its own average, smoothed strength and bands by the sample deviation, in one scan; from the `window`th bar on."""

    def step(s: Column, x: Column) -> dict[str, Column]:
        fast, slow = ema(12, s.ema12, x.close, x.i), ema(26, s.ema26, x.close, x.i)
        smooth = {k: wilder(p, s[k], F.greatest(v, F.lit(0.0)), x.i, 1) for k, v in (("gain", x.d), ("loss", -x.d))}
        return {"ema12": fast, "ema26": slow, "signal": ema(9, s.signal, fast - slow, x.i), **smooth, "close": x.close, "n": x.i}

    changes = bars.withColumn("d", F.coalesce(F.col("close") - F.lag("close").over(W()), F.lit(0.0)))
    out = fold(changes, ["close", "d"], {k: zero() for k in ("ema12", "ema26", "signal", "gain", "loss", "close", "n")}, step)
    macd, middle, sd = F.col("ema12") - F.col("ema26"), F.avg("close").over(last(window)), F.stddev_samp("close").over(last(window))
    rsi = 100 - 100 / (1 + F.col("gain") / (F.col("loss") + 1e-10))
    made = out.select("symbol", "ts", "n", "ema12", "ema26", macd.alias("macd"), "signal", (macd - F.col("signal")).alias("histogram"), rsi.alias("rsi"), (middle + wide * sd).alias("upper"), middle.alias("middle"), (middle - wide * sd).alias("lower"))
    return made.filter(F.col("n") >= window - 1).drop("n")


#: What a search tries, in the order in which ties are settled.
TRIED = {"kelly": [0.3, 0.5, 0.7], "atr": [1.5, 2.0, 2.5], "rsi": [10.0, 14.0, 20.0], "vol": [0.1, 0.15, 0.2]}
#: The value that each would have by itself, and the points that a distance of one costs.
LIKED = {"kelly": (0.5, 10), "atr": (2.0, 2), "rsi": (14, 0.5), "vol": (0.15, 10)}


def preferences(spark: SparkSession, tried: dict[str, list[float]] | None = None) -> DataFrame:
    """Each combination of a grid with ten points a value less its distance from what is liked; ties by the values' order."""
    tried = tried or TRIED
    grid = spark.range(1)
    for name, values in tried.items():
        grid = grid.select("*", F.explode(F.array(*map(F.lit, values))).alias(name))
    score = sum((10 - F.abs(F.col(k) - liked) * cost for k, (liked, cost) in LIKED.items()), F.lit(0.0))
    scored = grid.select(*tried, F.round(score, 4).alias("score"))
    # a row a combination: the grid is an argument, not data
    return scored.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), *tried)))


def event_equity(orders: DataFrame, shares: int = 10, capital: float = 1e5, worst: float = 0.15, share: float = 0.3) -> DataFrame:
    """symbol, ts, close, side and price, the fill's or null -> cash, quantity, trades and equity after each bar, by one scan.

    An order passes if the loss from the peak is below `worst`, and a buy if it is worth at most `share` of the equity.
    A sale sells what is held, at most `shares`; commission is 0.0003 of a trade, and a sale pays 0.001 more.
    """

    def step(s: Column, x: Column) -> dict[str, Column]:
        now = s.cash + s.quantity * x.close
        passes = x.price.isNotNull() & ((s.peak - now) / s.peak < worst)
        buys, sells = passes & (x.side == "buy") & (shares * x.close <= now * share), passes & (x.side == "sell") & (s.quantity > 0)
        sold = F.least(F.lit(float(shares)), s.quantity)
        cash = F.when(buys, s.cash - shares * x.price * 1.0003).when(sells, s.cash + sold * x.price * 0.9987).otherwise(s.cash)
        quantity = F.when(buys, s.quantity + shares).when(sells, s.quantity - sold).otherwise(s.quantity)
        equity = cash + quantity * x.close
        return {"cash": cash, "quantity": quantity, "peak": F.greatest(s.peak, equity), "trades": s.trades + F.when(buys | sells, 1.0).otherwise(0.0), "equity": equity}

    start = {"cash": F.lit(capital), "quantity": zero(), "peak": F.lit(capital), "trades": zero(), "equity": F.lit(capital)}
    return fold(orders, ["close", "side", "price"], start, step)


def event_prices(orders: DataFrame, shares: int = 10, slip: float = 0.0005) -> DataFrame:
    """open, high, low, volume, side, kind and level -> price: where the order fills in its bar, moved against it by half its share of the volume; null if it doesn't."""
    buys, level = F.col("side") == "buy", F.col("level")
    market = F.least(F.greatest(F.col("open") * F.when(buys, 1 + slip).otherwise(1 - slip), "low"), "high")
    limit = F.when(buys & (F.col("low") <= level), F.least(level, "open")).when(~buys & (F.col("high") >= level), F.greatest(level, "open"))
    stop = F.when(buys & (F.col("high") >= level), F.least(level * 1.01, "high")).when(~buys & (F.col("low") <= level), F.greatest(level * 0.99, "low"))
    impact = F.when(F.col("volume") > 0, shares / F.col("volume") * 0.5).otherwise(0.0)
    fill = F.when(F.col("kind") == "market", market).when(F.col("kind") == "limit", limit).when(F.col("kind") == "stop", stop)
    return orders.withColumn("price", fill * F.when(buys, 1 + impact).otherwise(F.greatest(F.lit(0.0), 1 - impact)))


def walk_forward(orders: DataFrame, train: int = 40, test: int = 12, step: int = 12) -> DataFrame:
    """The portfolio run anew over each window of `test` dates that follows `train` dates: strategy@window in place of strategy.

    Only windows that are whole count. The list of dates has a row a date.
    """
    dates = orders.select("ts").distinct().withColumns({"k": F.row_number().over(Window.orderBy("ts")) - 1, "dates": F.count("*").over(Window.partitionBy())})
    spot = F.col("k") - train
    first, final = F.greatest(F.lit(0), F.ceil((spot - test + 1) / step)), F.floor(spot / step)
    windows = dates.filter(spot >= 0).filter(final >= first)
    windows = windows.select("ts", "dates", F.explode(F.sequence(first, final)).alias("window")).filter(F.col("window") * step < F.col("dates") - train - test)
    runs = orders.join(windows.select("ts", "window"), "ts").withColumn("strategy", F.concat_ws("@", "strategy", "window"))
    return engines.portfolio(runs)
