"""Several sources' features as one vector of fixed width: side by side, brought to length 1, and filled up with zeros or projected at random.

The projection is drawn by a seed on the driver, and is as large as the two widths: it goes into the plan as one array, and a row's vector is a
handful of products in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@cache
def projection(n: int, width: int, seed: int = 42) -> np.ndarray:
    """n rows, width columns of normal draws with deviation 1 / sqrt(n)."""
    return np.random.RandomState(seed).normal(0, 1 / np.sqrt(n), size=(n, width))


def spread(values: Sequence[Column]) -> Column:
    """Values scaled to 0..1 among themselves, as an array; nulls count 0, and all are 0 where none differs."""
    made = F.array(*(F.coalesce(v.cast("double"), F.lit(0.0)) for v in values))
    return bound(made, lambda a: bound(F.struct(F.array_min(a).alias("lo"), F.array_max(a).alias("hi")), lambda e: F.transform(a, lambda x: F.when(e.hi > e.lo, (x - e.lo) / (e.hi - e.lo)).otherwise(0.0))))


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is worked out once, however often it is used there: it is the argument of a lambda."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fused(parts: Sequence[tuple[Column, int]], width: int = 64, seed: int = 42) -> Column:
    """Arrays of known lengths -> one of `width`: nulls count 0, a vector of nothing but zeros stays one."""
    n = sum(k for _, k in parts)
    whole = F.transform(F.concat(*(F.coalesce(a, F.array_repeat(F.lit(0.0), k)) for a, k in parts)), lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))

    def finished(v: Column) -> Column:
        # the norm is bound outside of the loop over elements, which would work it out for each of them
        unit = bound(F.sqrt(dot(v, v)), lambda norm: F.transform(v, lambda x: F.when(norm > 1e-10, x / norm).otherwise(x)))
        if n < width:
            return F.concat(unit, F.array_repeat(F.lit(0.0), width - n))
        table = F.array(*(F.lit(row) for row in np.ascontiguousarray(projection(n, width, seed).T)))
        return bound(unit, lambda u: F.transform(table, lambda column: dot(u, column)))

    return bound(whole, finished)
