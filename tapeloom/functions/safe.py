"""Column helpers with defined results where a plain expression would fail or give NaN."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def div(a: Column, b: Column, default: float | None = None) -> Column:
    """a / b, or the default where b is zero or either is null."""
    out = F.try_divide(a, b)
    return out if default is None else F.coalesce(out, F.lit(float(default)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def corr(x: Column, y: Column, window) -> Column:
    """Pearson's correlation over a window; 0 where either side does not vary."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y).over(window), F.stddev_pop(x).over(window) * F.stddev_pop(y).over(window)), F.lit(0.0))


def deviation_agg(x: Column) -> Column:
    """The deviation of a group, exactly 0 where it doesn't vary: added up from parts, means are off by a rounding (50 / 11 * 11 is not 50), and a quotient by such a deviation is noise."""
    low, high = F.min(x), F.max(x)
    return F.when(low == high, high - low).otherwise(F.stddev_pop(x))


def corr_agg(x: Column, y: Column) -> Column:
    """Pearson's correlation of a group; 0 where either side does not vary."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), deviation_agg(x) * deviation_agg(y)), F.lit(0.0))


def finite(x: Column) -> Column:
    """x, or null where it is not a finite number."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)
