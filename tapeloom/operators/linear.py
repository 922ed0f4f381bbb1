"""Linear algebra over any number of factors: a Gram matrix in a row, and elimination and sweeps on it by higher-order functions.

The sums of products are one aggregation by key, map-side combined; what is solved is k x k numbers in that key's row, in the
JVM, and what comes of it is joined back by key. Nothing is gathered, and the number of factors is the length of a list.

A pivot that is left with less than `LEAST` of its factor is of a factor that those before it explain: it is passed over, its
loadings and slope are none, and its inflation is infinite (null here). A date on which a factor doesn't vary is such a case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.safe import div

LEAST = 1e-6


def _products(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (key, then k columns) -> by key, a task's rows, sums and products of all pairs of columns, each over the rows that have both, in the pairs' order."""
    upper = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            there = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns[1:]]).astype(float)
            x = np.column_stack([c.fill_null(0.0).to_numpy() for c in batch.columns[1:]])
            at = keys.indices.fill_null(len(keys.dictionary)).to_numpy()
            for i in np.unique(at).tolist():
                key = keys.dictionary[i].as_py() if i < len(keys.dictionary) else None
                own, has = x[at == i], there[at == i]
                new = np.concatenate([[len(own)], own.sum(0), has.sum(0), (own.T @ own)[upper], (has.T @ has)[upper]])
                total[key] = total[key] + new if key in total else new
        values = np.concatenate([np.zeros(0), *total.values()])
        offsets = pa.array(np.linspace(0, len(values), len(total) + 1).round().astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), batch.schema.field(0).type if total else None), pa.ListArray.from_arrays(offsets, pa.array(values))], ["key", "sums"])

    return run


def gram(rows: DataFrame, columns: Sequence[str], *keys: str, y: str | None = None) -> DataFrame:
    """By key (one, or none): n, means and deviations of the columns, and s, their correlations and, as a last row and column, their covariances with y by a
    column's deviation. A column that doesn't vary goes with nothing, not with itself either.

    A task adds up its rows' products by key as matrices, and passes on a row for each key; those are added by place."""
    k, every = len(columns), [*columns, *([y] if y else [])]
    pairs = [(i, j) for i in range(len(every)) for j in range(i, len(every))]
    source = rows.select(F.col(keys[0]).alias("key") if keys else F.lit(0).alias("key"), *(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(every)))
    parts = source.mapInArrow(_products(len(every)), f"key {source.schema['key'].dataType.simpleString()}, sums array<double>")
    m, w = len(every), len(pairs)
    summed = parts.select("key", F.posexplode("sums").alias("at", "v")).groupBy("key", "at").agg(F.sum("v").alias("v"))
    out = summed.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda e: e.v).alias("t"))
    mean = lambda total, count: f"try_divide(t[{total}], t[{count}])"
    made = [f"{mean(1 + i, 1 + m + i)} AS m{i}" for i in range(m)] + [f"{mean(1 + 2 * m + q, 1 + 2 * m + w + q)} AS p{i}_{j}" for q, (i, j) in enumerate(pairs)]
    out = out.selectExpr(*(f"key AS {c}" for c in keys), "cast(t[0] AS bigint) AS n", *made)
    # deviations of less than a millionth of the values are those of rounding
    spread = lambda i: f"(p{i}_{i} - m{i} * m{i})"
    out = out.selectExpr("*", *(f"CASE WHEN {spread(i)} > 1e-12 * p{i}_{i} THEN sqrt({spread(i)}) ELSE 0D END AS d{i}" if i < k else f"1D AS d{i}" for i in range(len(every))))
    out = out.selectExpr("*", *(f"CASE WHEN d{i} = 0 OR d{j} = 0 THEN 0D ELSE (p{i}_{j} - m{i} * m{j}) / (d{i} * d{j}) END AS s{i}_{j}" for i, j in pairs))
    listed = lambda c, n: f"array({', '.join(c(i) for i in range(n))})"
    s = listed(lambda i: listed(lambda j: f"s{min(i, j)}_{max(i, j)}", len(every)), len(every))
    return out.selectExpr(*keys, "n", f"{listed(lambda i: f'm{i}', k)} AS means", f"{listed(lambda i: f'd{i}', k)} AS sds", f"{s} AS s")


def standard(columns: Sequence[str]) -> Column:
    """The columns against their means and deviations, as an array; one that doesn't vary is 0."""
    return F.expr(f"array({', '.join(f'CASE WHEN sds[{i}] = 0 THEN 0D ELSE ({c} - means[{i}]) / sds[{i}] END' for i, c in enumerate(columns))})")


def eliminated(s: Column, k: int) -> Column:
    """Rows of s with all below each pivot taken out: what is left of each factor on the diagonal, products with it beside."""

    def step(a: Column, i: Column) -> Column:
        pivot = a[i][i]
        return F.transform(a, lambda row, r: F.when((r <= i) | ~(pivot > LEAST), row).otherwise(F.transform(row, lambda v, c: v - row[i] * a[i][c] / pivot)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), s, step)


def loadings(u: Column, k: int) -> Column:
    """By factor: its loadings on the orthogonal factors before it, from the eliminated rows: an array of that many numbers.

    u is a column of its own, so that it isn't worked out again for each number.
    """
    numbers = lambda n: F.sequence(F.lit(0), n)
    return F.transform(numbers(F.lit(k - 1)), lambda j: F.when(j == 0, F.array().cast("array<double>")).otherwise(F.transform(numbers(j - 1), lambda i: F.when(u[i][i] > LEAST, u[i][j] / u[i][i]).otherwise(0.0))))


def orthogonal(z: Column, by: Column, k: int) -> Column:
    """Each factor without its projection on those before it."""

    def step(q: Column, j: Column) -> Column:
        taken = F.aggregate(F.zip_with(q, by[j], lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
        return F.concat(q, F.array(z[j] - taken))

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<double>"), step)


def swept(s: Column, k: int) -> Column:
    """s swept on its first k pivots: minus the inverse among them, slopes beside, what is left of the rest in the corner.

    Of correlations, an inverse has 1 or more on its diagonal, so a swept pivot is told by -1 or less from one that was passed over.
    """

    def step(a: Column, i: Column) -> Column:
        pivot = a[i][i]
        one = lambda row, r: F.transform(row, lambda v, c: F.when((r == i) & (c == i), -1 / pivot).when((r == i) | (c == i), v / pivot).otherwise(v - row[i] * a[i][c] / pivot))
        return F.when(pivot > LEAST, F.transform(a, one)).otherwise(a)

    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), s, step)


def orthogonal_factors(rows: DataFrame, columns: Sequence[str], key: str = "ts") -> DataFrame:
    """q: by row, the standardised columns in their order, each without its projection on those before it within the key."""
    k = len(columns)
    by = gram(rows, columns, key).select(key, "means", "sds", eliminated(F.col("s"), k).alias("u")).select(key, "means", "sds", loadings(F.col("u"), k).alias("by"))
    z = rows.join(F.broadcast(by), key).select(*rows.columns, "by", standard(columns).alias("z"))
    return z.select(*rows.columns, orthogonal(F.col("z"), F.col("by"), k).alias("q"))


def left_of_factors(rows: DataFrame, columns: Sequence[str], key: str = "ts") -> DataFrame:
    """By key and factor: left, the share of it that those before it leave."""
    u = gram(rows, columns, key).select(key, "n", eliminated(F.col("s"), len(columns)).alias("u"), "s")
    i = F.col("i")
    each = u.select(key, "n", F.posexplode(F.array(*(F.lit(c) for c in columns))).alias("i", "factor"), "u", "s")
    return each.select(key, "n", "factor", F.when(F.col("s")[i][i] > LEAST, F.col("u")[i][i] / F.col("s")[i][i]).otherwise(0.0).alias("left"))


def inflation(rows: DataFrame, columns: Sequence[str], key: str = "ts") -> DataFrame:
    """By key and factor: vif, the factor's variance against what all others leave of it; null where they leave nothing."""
    k = len(columns)
    s = gram(rows, columns, key)
    each = s.select(key, "n", F.posexplode(F.array(*(F.lit(c) for c in columns))).alias("i", "factor"), swept(F.col("s"), k).alias("w"), F.col("s"))
    i = F.col("i")
    inverse = -F.col("w")[i][i]
    return each.select(key, "n", "factor", F.when(inverse > 0.5, F.col("s")[i][i] * inverse).alias("vif"))


def regressions(rows: DataFrame, columns: Sequence[str], y: str, key: str = "ts") -> DataFrame:
    """By key and factor: slope of y on all standardised factors and an intercept, and its t; factors passed over have no row."""
    k = len(columns)
    s = gram(rows, columns, key, y=y).select(key, "n", swept(F.col("s"), k).alias("w"))
    used = F.size(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.col("w")[i][i] < -0.5))
    s = s.withColumn("free", F.col("n") - used - 1).filter("free > 0")
    i = F.col("i")
    each = s.select(key, "n", "free", F.posexplode(F.array(*(F.lit(c) for c in columns))).alias("i", "factor"), "w").filter(F.col("w")[i][i] < -0.5)
    error = F.greatest(F.lit(0.0), F.col("w")[k][k]) * F.col("n") / F.col("free")
    t = F.coalesce(div(F.col("w")[i][k], F.sqrt(error * -F.col("w")[i][i] / F.col("n"))), F.lit(0.0))
    return each.select(key, "n", "factor", F.col("w")[i][k].alias("slope"), t.alias("t"))


def uncorrelated(rows: DataFrame, columns: Sequence[str], most: float = 0.7) -> DataFrame:
    """Over all rows, factor and kept: in order, a factor is kept unless it goes with a kept one above `most`."""
    k = len(columns)
    # past a generator, so that s is worked out once and not for each number that is read from it
    s = gram(rows, columns).select(F.explode(F.array(F.lit(0))).alias("whole"), "s")

    def step(kept: Column, j: Column) -> Column:
        clash = F.exists(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: i < j), lambda i: kept[i] & (F.abs(F.col("s")[i][j]) > most))
        return F.concat(kept, F.array(~clash))

    kept = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<boolean>"), step)
    each = s.select(F.posexplode(F.array(*(F.lit(c) for c in columns))).alias("i", "factor"), kept.alias("kept"))
    return each.select("factor", F.col("kept")[F.col("i")].alias("kept"))
