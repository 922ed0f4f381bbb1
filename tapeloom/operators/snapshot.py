"""A bar with what rule tables look at: its change, turnover, year's range, means, ranges and strength, by one sort."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.safe import div
from tapeloom.operators.timeseries import SO_FAR, W, before, last, momentum, returns, rsi_cutler, rsi_winners, true_range

YEAR = 12


def snapshot(bars: DataFrame) -> DataFrame:
    """turnover: volume over its mean so far, in hundredths; change: in hundredths; vol: annualised deviation of log returns."""
    b = true_range(returns(bars))
    c, v = F.col("close"), F.col("volume")
    made = {
        "rn": F.row_number().over(W()), "prev": F.lag("close").over(W()), "inner_vol": v - F.col("outer_vol"), "change": F.col("ret") * 100, "turnover": v / F.avg(v).over(SO_FAR()) * 100,
        "year_high": F.max(c).over(last(YEAR)), "year_low": F.min(c).over(last(YEAR)), **{f"ma{k}": F.avg(c).over(last(k)) for k in (5, 10, 20, 60)}, "mean_volume": F.avg(v).over(last(20)), "volume5": F.avg(v).over(last(5)),
        "sd": F.stddev_pop(c).over(last(20)), "vol": F.coalesce(F.stddev_pop("logret").over(last(20)), F.lit(0.0)) * math.sqrt(YEAR), "atr": F.avg("tr").over(last(14)), "rsi": rsi_winners(14),
        **{f"rsi{k}": rsi_cutler(k) for k in (6, 14, 25, 60)}, "mom5": momentum(5), "mom20": momentum(20), "hi20": F.max(c).over(before(20)), "lo20": F.min(c).over(before(20)),
        "ret_mean": F.avg("ret").over(last(20)), "down": F.coalesce(F.stddev_pop(F.when(F.col("ret") < 0, F.col("ret"))).over(last(20)), F.lit(0.0)), "ret_sd": F.coalesce(F.stddev_pop("ret").over(last(20)), F.lit(0.0)),
        "vol_ratio": div(v, F.avg(v).over(before(20)), 1.0),
    }
    return b.withColumns(made)
