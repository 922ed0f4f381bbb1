"""Studies over series: augmented copies for training, and the choice of a parameter by its mean information coefficient over folds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.safe import corr_agg
from tapeloom.operators.timeseries import W, labels

#: Two rounds of the minimal standard generator: the same numbers in any engine, whatever the partitions.
FACTOR, PRIME = 48_271, 2_147_483_647


def uniform(i: Column, salt: int) -> Column:
    """A number in (0, 1) for a symbol (an integer), a place and a salt."""
    draw = F.pmod(F.col("symbol") * 1_000_003 + i * 7_919 + salt * 104_729 + 7, F.lit(1_000_000_007)) * FACTOR % PRIME * FACTOR % PRIME
    return (draw + 1) / float(PRIME + 1)


def normal(i: Column, salt: int) -> Column:
    """A standard normal number, of two uniform ones."""
    return F.sqrt(-2.0 * F.log(uniform(i, salt))) * F.cos(2 * math.pi * uniform(i, salt + 1))


def augmented(bars: DataFrame, jitter: float = 0.05, scaling: float = 0.1, warp: float = 0.2) -> DataFrame:
    """Each bar with its augmented values: close with noise, close scaled by a factor of its symbol, (close, volume) turned by an angle of its symbol, and close at a warped place in time.

    The noise comes of hashes, so reruns agree. A symbol of one bar keeps its close in the warp. The warped place is
    looked up by an equi-join, so no series is gathered into a row.
    """
    whole = Window.partitionBy("symbol")
    i, zero = F.col("i"), F.lit(0)
    b = bars.select("symbol", "ts", "close", "volume", (F.row_number().over(W()) - 1).cast("long").alias("i"))
    b = b.withColumn("walk", F.sum(normal(i, 20) * warp).over(W().rowsBetween(Window.unboundedPreceding, 0)))
    low, high, n = F.min("walk").over(whole), F.max("walk").over(whole), F.count("*").over(whole)
    b = b.withColumn("at", F.least(n - 1, F.floor(F.round((F.col("walk") - low) / (high - low + 1e-10) * n, 7))))
    angle = (2 * uniform(zero, 30) - 1) * math.pi
    made = b.select(
        "symbol", "ts", "at", (F.col("close") + normal(i, 10) * jitter).alias("jittered"), (F.col("close") * (1 + normal(zero, 12) * scaling)).alias("scaled"),
        (F.col("close") * F.cos(angle) + F.col("volume") * F.sin(angle)).alias("turned_close"), (F.col("volume") * F.cos(angle) - F.col("close") * F.sin(angle)).alias("turned_volume"),
    )
    there = b.select("symbol", F.col("i").alias("at"), F.col("close").alias("warped"))
    return made.join(there, ["symbol", "at"]).drop("at")


def fold_ic(bars: DataFrame, periods: tuple[int, ...] = (1, 3, 5, 10), folds: int = 5, embargo: int = 2, horizon: int = 5) -> DataFrame:
    """For each period of momentum: the mean over folds in time of the correlation between a fitted line and the label, and the place of the period.

    Folds are equal runs of dates at the end; a fold's line is fitted on all dates before it but the last `embargo`, which is shorter than a
    fold. Folds with under 20 rows before, under 5 within, or without variation are left out; a period without a fold has 0. One aggregation
    gives each run's moments, and what comes before a fold is a running sum of them: no row is read once a fold.
    """
    dates = bars.select("ts").distinct().withColumn("d", F.row_number().over(Window.orderBy("ts")) - 1)  # a row for each date
    n = bars.select("ts").distinct().agg(F.count("*").alias("dates"))
    size = F.floor(F.col("dates") / (folds + 1))
    first = F.col("dates") - folds * size
    run = F.when(F.col("d") < first, 0).otherwise(F.floor((F.col("d") - first) / size) + 1)
    runs = dates.crossJoin(F.broadcast(n)).filter(size > 0).select("ts", run.alias("run"), (F.col("d") >= first + run * size - embargo).alias("late"))
    marked = labels(bars, horizon).select("symbol", "ts", F.col("label").cast("double").alias("y"))
    moved = bars.select("symbol", "ts", F.array(*(F.struct(F.lit(p).alias("period"), (F.col("close") / F.lag("close", p).over(W()) - 1).alias("x")) for p in periods)).alias("made"))
    rows = moved.join(marked, ["symbol", "ts"]).join(runs, "ts").select("run", "late", "y", F.explode("made").alias("m")).select("run", "late", "y", "m.*").filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    x, y = F.col("x"), F.col("y")
    moments = {"n": F.lit(1.0), "sx": x, "sy": y, "sxy": x * y}
    per_run = rows.groupBy("period", "run").agg(
        corr_agg(x, y).alias("corr"), *(F.sum(v).alias(k) for k, v in moments.items()), *(F.coalesce(F.sum(F.when(F.col("late"), v)), F.lit(0.0)).alias(f"late_{k}") for k, v in moments.items())
    )
    order = Window.partitionBy("period").orderBy("run")
    earlier = per_run.select("period", "run", "corr", F.col("n").alias("within"), *((F.sum(k).over(order.rowsBetween(Window.unboundedPreceding, -1)) - F.lag(f"late_{k}").over(order)).alias(k) for k in moments))
    slope = F.signum(F.round(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), 6))
    good = (F.col("run") > 0) & (F.col("n") >= 20) & (F.col("within") >= 5) & (slope != 0) & (F.col("corr") != 0)
    out = earlier.groupBy("period").agg(F.count_if(good).alias("folds"), F.round(F.coalesce(F.avg(F.when(good, slope * F.col("corr"))), F.lit(0.0)), 6).alias("ic"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ic"), "period")))
