"""Folds, centroids, drift and cool-downs over labelled or timed rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.drift import ks_p_value
from tapeloom.operators.timeseries import W


def purged_folds(bars: DataFrame, folds: int, embargo: int) -> DataFrame:
    """Rows of each fold's test and of its train: those farther than the embargo from the test's bounds, on either side."""
    q = bars.select("symbol", F.ntile(folds).over(W()).alias("own"), F.row_number().over(W()).alias("i"))
    bounds = q.groupBy("symbol", F.col("own").alias("fold")).agg(F.min("i").alias("lo"), F.max("i").alias("hi"))
    j = q.join(bounds, "symbol")
    return j.groupBy(F.col("fold").cast("long").alias("fold")).agg(F.count_if(F.col("own") == F.col("fold")).alias("test"), F.count_if((F.col("i") < F.col("lo") - embargo) | (F.col("i") > F.col("hi") + embargo)).alias("train"))


def centroids(vectors: DataFrame) -> DataFrame:
    """The label whose mean vector is nearest to each vector, and how sure that is by inverse squared distance.

    The means are one row for each label; they are small, and are broadcast.
    """
    long = vectors.select("vec_id", "label", F.posexplode("embedding").alias("i", "v"))
    mean = long.groupBy("label", "i").agg(F.avg("v").alias("m")).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s.m).alias("mean"))
    if mean.count() > 10_000:
        raise ValueError("too many labels to broadcast their means")
    # one row with all means goes to every vector, and the least is found within the vector's row
    table = mean.agg(F.array_sort(F.collect_list(F.struct("label", "mean"))).alias("means"))
    far = lambda m: F.round(F.aggregate(F.zip_with("embedding", m["mean"], lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x), 9)
    d = vectors.select("vec_id", "embedding").crossJoin(F.broadcast(table)).select("vec_id", F.transform("means", lambda m: F.struct(far(m).alias("far"), m["label"].alias("near"))).alias("fars"))
    best = d.select("vec_id", F.array_min("fars").alias("best"), F.aggregate("fars", F.lit(0.0), lambda s, x: s + F.coalesce(F.try_divide(F.lit(1.0), x.far), F.lit(0.0))).alias("weight"))
    return best.select("vec_id", F.col("best.near").alias("predicted"), F.round(F.coalesce(F.try_divide(F.lit(1.0), F.col("best.far") * F.col("weight")), F.lit(1.0)), 6).alias("probability"))


def ks_statistic(rows: DataFrame, early: int) -> DataFrame:
    """The greatest gap between the distributions of a symbol's first returns and of its others, its chance if they were one, and drift: above 0.3."""
    q = rows.select("symbol", "ret", F.when(F.col("rn") <= early, 1).otherwise(0).alias("e"))
    w, whole = Window.partitionBy("symbol").orderBy("ret").rangeBetween(Window.unboundedPreceding, 0), Window.partitionBy("symbol")
    q = q.select("symbol", F.sum("e").over(w).alias("up"), F.sum(1 - F.col("e")).over(w).alias("other"), F.sum("e").over(whole).alias("a"), F.sum(1 - F.col("e")).over(whole).alias("b")).filter("a > 0 AND b > 0")
    out = q.groupBy("symbol").agg(F.max(F.abs(F.col("up") / F.col("a") - F.col("other") / F.col("b"))).alias("gap"), F.max("a").alias("a"), F.max("b").alias("b"))
    return out.select("symbol", F.round("gap", 6).alias("ks"), F.round(ks_p_value(F.col("gap"), F.col("a"), F.col("b")), 6).alias("p"), (F.col("gap") > 0.3).alias("drifted"))


#: Instants of a block, about, and blocks that are composed at once.
BLOCK, FAN = 20_000, 256
STEPS = "event_type string, place long, hits long, upto array<long>, free array<long>, n array<long>"


def _block_steps(gap: int, key: str = "event_type"):
    """A block's instants -> a function from the time that a firing may be again to the same after the block, and how many fired.

    It is a list of steps: the first with `upto` at or after that time says it, and past the last one nothing fires and the time stays. Nothing that fired
    before the block can hold back longer than its first instant and the gap, so instants beyond are only followed.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        at = rows["at"].to_numpy()
        follow = np.searchsorted(at, at + gap, "left")
        free, n = [0] * len(at), [0] * len(at)
        for i, j in zip(range(len(at) - 1, -1, -1), follow[::-1].tolist(), strict=True):
            free[i], n[i] = (free[j], n[j] + 1) if j < len(at) else (int(at[i]) + gap, 1)
        entries = min(len(at), int(follow[0]) + 1)
        steps = _merged(at[:entries].tolist(), free[:entries], n[:entries])
        return pd.DataFrame([(rows[key].iloc[0], int(rows["place"].iloc[0]), int(rows["hits"].sum()), *steps)], columns=[c.split()[0] for c in STEPS.split(", ")])

    return run


def _merged(upto: list[int], free: list[int], n: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Steps without those that the next one says as well."""
    keep = [i for i in range(len(upto)) if i == len(upto) - 1 or (free[i], n[i]) != (free[i + 1], n[i + 1])]
    return [upto[i] for i in keep], [free[i] for i in keep], [n[i] for i in keep]


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    """Functions of blocks in a row -> the one of all of them."""
    rows = rows.sort_values("place")
    upto, free, n = [], [], []
    for r in rows.itertuples(index=False):
        own = [int(x) for x in r.upto], [int(x) for x in r.free], [int(x) for x in r.n]
        at = np.searchsorted(own[0], free, "left").tolist() if free else []
        n = [m + (own[2][i] if i < len(own[0]) else 0) for m, i in zip(n, at, strict=True)]
        free = [own[1][i] if i < len(own[0]) else f for f, i in zip(free, at, strict=True)]
        first = int(np.searchsorted(own[0], upto[-1], "right")) if upto else 0
        upto, free, n = _merged(upto + own[0][first:], free + own[1][first:], n + own[2][first:])
    return pd.DataFrame([(rows["event_type"].iloc[0], int(rows["place"].iloc[0]) // FAN, int(rows["hits"].sum()), upto, free, n)], columns=[c.split()[0] for c in STEPS.split(", ")])


def cooldown(events: DataFrame, seconds: int, block: int = BLOCK) -> DataFrame:
    """Events of a type fire only so long after the last one that fired: event_type, hits and how many fired.

    Events of one instant are counted first. A type's time is cut into blocks of about `block` instants, and blocks that hold many more once again, so that a dense hour is
    many blocks. Each block becomes a function of what enters it, all side by side, and functions are composed FAN at a time until one of a type is left: no
    group holds more than a block or FAN functions, whatever the number of events and however dense they are.

    Defined results: rows without a type are a type of their own, those without a time count for nothing; an empty table gives an empty result.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    instants = events.filter(F.col("ts").isNotNull()).groupBy("event_type", at.alias("at")).agg(F.count("*").alias("hits"))
    same = lambda a, b: a["event_type"].eqNullSafe(b["event_type"])
    spans = instants.groupBy("event_type").agg(F.min("at").alias("begin"), F.ceil(F.count("*") / block).alias("parts"), (F.max("at") - F.min("at") + 1).alias("span"))
    cut = instants.join(spans, same(instants, spans)).drop(spans["event_type"])
    coarse = cut.withColumn("width", F.greatest(F.lit(1), F.ceil(F.col("span") / F.col("parts")))).withColumn("coarse", F.floor((F.col("at") - F.col("begin")) / F.col("width")))
    sizes = coarse.groupBy("event_type", "coarse").agg(F.ceil(F.count("*") / block).alias("fine_parts"))
    fine = coarse.join(sizes, same(coarse, sizes) & (coarse["coarse"] == sizes["coarse"])).drop(sizes["event_type"]).drop(sizes["coarse"])
    inside = F.col("at") - F.col("begin") - F.col("coarse") * F.col("width")
    fine = fine.withColumn("fine", F.floor(inside / F.greatest(F.lit(1), F.ceil(F.col("width") / F.col("fine_parts")))))
    named = fine.select("event_type", "at", "hits", (F.col("coarse") * (1 << 32) + F.col("fine")).alias("place"))
    steps = named.groupBy("event_type", "place").applyInPandas(_block_steps(seconds * 1_000_000), STEPS)
    # blocks are few, a row for each: numbered without gaps, and composed level by level
    steps = steps.withColumn("place", (F.row_number().over(Window.partitionBy("event_type").orderBy("place")) - 1).cast("long"))
    left = spans.agg(F.max("parts")).first()[0] or 1
    blocks = 2 * left + 1
    while True:
        steps = steps.groupBy("event_type", F.floor(F.col("place") / FAN).alias("group")).applyInPandas(_composed, STEPS)
        blocks = -(-blocks // FAN)
        if blocks <= 1:
            return steps.select("event_type", "hits", F.get("n", F.lit(0)).alias("fired"))
