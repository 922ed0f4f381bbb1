"""Adaptive windows: a symbol's window grows with each value and loses its older side where the two sides' means part.

Rows go by symbol and time through one task each in Arrow batches; what is carried is the open window's prefix sums, so neither a series nor a
batch of series has to fit in memory. A step looks at all cuts of the window at once.

Defined results: rows whose x is null, NaN or infinite take no part; rows of one time go in order of x; symbols may be null, and are one symbol then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Bound:
    """side: values of a side at least; least: values of a window that is looked at; most: values of a window; halves: the older side is no longer than the newer."""

    side: int
    least: int
    most: int | None
    delta: float
    halves: bool

    def cuts(self, m: int) -> np.ndarray:
        return np.arange(self.side, (m // 2 if self.halves else m - self.side - 1) + 1)

    def gap(self, older: np.ndarray, m: int) -> np.ndarray:
        """How far the means of a side of `older` values and of the m - older others may be apart."""
        share = m / (older * (m - older))
        if self.halves:
            return np.sqrt(share / 2 * np.log(4 * np.log(m) / self.delta))
        sure = np.log(4 / self.delta)
        return np.sqrt(share * sure / 2 + sure * sure / (6 * m))


#: Fixed values of the two bounds.
BOUNDS = {"halves": Bound(5, 10, None, 0.002, True), "both_sides": Bound(30, 30, 1000, 0.01, False)}


class Open:
    """One symbol's window: prefix sums from before its first value on."""

    def __init__(self, bound: Bound):
        self.bound, self.sums, self.first, self.end = bound, np.zeros(256), 0, 0

    def add(self, x: float) -> int:
        """Takes a value in; how many go at the cut, 0 without one."""
        if self.end + 1 == len(self.sums):
            # what has been left goes; the array doubles only when half of it is in use
            kept = self.sums[self.first : self.end + 1]
            self.sums = np.concatenate([kept - kept[0], np.zeros(max(256, len(kept)))])
            self.first, self.end = 0, len(kept) - 1
        self.sums[self.end + 1] = self.sums[self.end] + x
        self.end += 1
        if self.bound.most and self.width > self.bound.most:
            self.first += 1
        m = self.width
        if m < self.bound.least:
            return 0
        older = self.bound.cuts(m)
        total = self.sums[self.first : self.end + 1] - self.sums[self.first]
        over = np.abs(total[older] / older - (total[m] - total[older]) / (m - older)) > self.bound.gap(older, m)
        cut = int(older[over.argmax()]) if over.any() else 0
        self.first += cut
        return cut

    @property
    def width(self) -> int:
        return self.end - self.first

    @property
    def mean(self) -> float:
        return float(self.sums[self.end] - self.sums[self.first]) / self.width


def _windows(bound: Bound) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, window = None, None
        for batch in batches:
            names = batch.column("symbol").dictionary_encode()
            codes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            x = batch.column("x").to_numpy(zero_copy_only=False)
            out = np.empty((len(x), 2), dtype=np.int64)
            mean, before = np.empty(len(x)), None
            for i, code in enumerate(codes):
                if code != before:
                    name = names.dictionary[int(code)].as_py() if code >= 0 else None
                    if window is None or name != symbol:
                        symbol, window = name, Open(bound)
                    before = code
                out[i] = window.add(x[i]), window.width
                mean[i] = window.mean
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out[:, 0]), pa.array(out[:, 1]), pa.array(mean)], [*batch.schema.names, "cut", "width", "mean"])

    return run


def windows(rows: DataFrame, bound: str = "halves") -> DataFrame:
    """symbol, ts, x -> with cut (values that leave at this one, 0 without drift), and the window's width and mean after it."""
    sound = rows.select("symbol", "ts", F.col("x").cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x") & (F.abs("x") < float("inf")))
    schema = T.StructType([*sound.schema.fields, T.StructField("cut", T.LongType()), T.StructField("width", T.LongType()), T.StructField("mean", T.DoubleType())])
    return sound.repartition("symbol").sortWithinPartitions("symbol", "ts", "x").mapInArrow(_windows(BOUNDS[bound]), schema)


def status(rows: DataFrame, bound: str = "both_sides") -> DataFrame:
    """By symbol: how often its window was cut, the size, mean and deviation of what the last one holds, and whether to train again (cut among its last values)."""
    newest = Window.partitionBy("symbol").orderBy(F.desc("ts"), F.desc("x"))
    q = windows(rows, bound).withColumn("back", F.row_number().over(newest)).withColumn("last", F.first("width").over(newest))
    held = F.col("back") <= F.col("last")
    out = q.groupBy("symbol").agg(F.sum(F.when(F.col("cut") > 0, 1).otherwise(0)).alias("splits"), F.max("last").alias("size"), F.avg(F.when(held, F.col("x"))).alias("mean"), F.stddev_pop(F.when(held, F.col("x"))).alias("std"), F.max(F.when(held & (F.col("cut") > 0), 1).otherwise(0)).alias("fresh"))
    return out.select("symbol", "splits", "size", "mean", "std", F.when(F.col("fresh") > 0, "train_again").otherwise("keep").alias("advice"))


def kolmogorov(lam: Column, terms: int = 60) -> Column:
    """1 less the Kolmogorov distribution at lam: the chance of a gap that large between samples of one distribution. Below 0.2 the chance is 1 to twelve digits."""
    series = sum((F.lit(2.0 * (-1) ** (k - 1)) * F.exp(-2.0 * k * k * lam * lam) for k in range(1, terms + 1)), F.lit(0.0))
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def ks_p_value(gap: Column, a: Column, b: Column) -> Column:
    """The chance of the greatest gap between two samples' distributions, of a and b rows, by the limit's distribution."""
    return kolmogorov(gap * F.sqrt(a * b / (a + b)))
