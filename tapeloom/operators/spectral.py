"""Embedding of a graph by the lowest eigenvectors of its normalised Laplacian.

Block Lanczos: nodes carry a row of the basis, a round multiplies its last block by the sparse matrix (a join of edges and an aggregation by node),
makes the result orthogonal to the basis twice, and adds it. What comes to the driver is the matrix of products of the basis, at most (BASIS + k) wide whatever the number of nodes,
whose eigenvectors say how far off the wanted ones are. Each round's nodes are written to the shared folder, so that lineage ends there.

Defined results: ties in both directions are averaged, loops and weights that are null or not above 0 don't count; nodes without an edge keep their
place with 0 in all vectors of other parts; vectors have length 1 and a positive greatest component (least node first). Where values repeat, the vectors are any of their space.
A graph with fewer nodes than k has as many vectors as nodes, the others are 0. Beyond BASIS vectors without convergence it raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.streaming.alerts import discard, scratch

BASIS = 400
CLOSE = 1e-8


def symmetric(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, w of D^-1/2 A D^-1/2, A the mean of both directions."""
    one = edges.filter("src != dst AND w > 0").select("src", "dst", F.col("w").cast("double").alias("w"))
    both = one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")).groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))
    known = nodes.select("k").distinct()
    both = both.join(known.withColumnRenamed("k", "src"), "src", "left_semi").join(known.withColumnRenamed("k", "dst"), "dst", "left_semi")
    degree = both.groupBy("src").agg(F.sum("w").alias("d"))
    return both.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("d").alias("e")), "dst").select("src", "dst", (F.col("w") / F.sqrt(F.col("d") * F.col("e"))).alias("w"))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for b in batches:
        if b.num_rows:
            x = np.hstack([c.flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in b.columns])
            total = x.T @ x if total is None else total + x.T @ x
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.reshape(-1))], ["at", "v"])


def products(rows: DataFrame, *arrays: str) -> np.ndarray:
    """The products of all columns of the arrays side by side, summed over rows: each task adds up its own."""
    got = rows.select(*arrays).mapInArrow(_products, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(len(got))
    for r in got:
        out[r["at"]] = r.v
    return out.reshape(round(len(got) ** 0.5), -1)


def times(column: str, table: np.ndarray) -> Column:
    """A row's array times a small matrix."""
    n, width = table.shape
    flat = F.lit(np.ascontiguousarray(table.T).reshape(-1))
    dot = lambda j: F.aggregate(F.zip_with(F.col(column), F.slice(flat, j * n + 1, n), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), dot) if width else F.array().cast("array<double>")


def _orthogonal(rows: DataFrame, basis: int) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """y without what the basis q says of it, of length 1 and orthogonal in itself; what q says of it, and what it was made by."""
    g = products(rows, "q", "y")
    share = g[:basis, basis:]
    if basis:
        rows = rows.withColumn("y", F.zip_with("y", times("q", share), lambda a, b: a - b))
    left = products(rows, "y")
    values, vectors = np.linalg.eigh(left)
    keep = values > 1e-20 * max(1.0, g[basis:, basis:].trace())
    return rows.withColumn("y", times("y", vectors[:, keep] / np.sqrt(values[keep]))), share, (vectors[:, keep] * np.sqrt(values[keep])).T


def embedding(nodes: DataFrame, edges: DataFrame, k: int = 4, seed: int = 42) -> tuple[DataFrame, np.ndarray]:
    """nodes (k), edges (src, dst, w) -> k and v, its components of the k lowest eigenvectors; and the eigenvalues, lowest first."""
    spark = nodes.sparkSession
    path = scratch(spark, "edges")
    symmetric(nodes, edges).write.parquet(path)
    matrix = spark.read.parquet(path)

    places: list[str] = []

    def written(rows: DataFrame) -> DataFrame:
        places.append(scratch(spark, "basis"))
        rows.write.parquet(places[-1])
        # what the rows were made of is not read again
        if len(places) > 1:
            discard(spark, places[-2])
        return spark.read.parquet(places[-1])

    draw = F.array(*(F.xxhash64("k", F.lit(seed + j)) / 2.0**63 for j in range(k)))
    rows = written(nodes.select("k").distinct().select("k", F.array().cast("array<double>").alias("q"), draw.alias("y")))
    n = rows.count()
    if not n:
        return rows.select("k", F.col("y").alias("v")), np.zeros(0)
    basis, block, small = 0, min(k, n), np.zeros((0, 0))
    while True:
        # once more over what the first pass leaves
        rows, _, made = _orthogonal(rows, basis)
        rows = written(rows)
        if len(made):
            rows, _, again = _orthogonal(rows, basis)
            rows, block = written(rows.select("k", F.concat("q", "y").alias("q"), F.col("y").alias("last"))), len(again)
            basis += block
            near = matrix.join(rows.select(F.col("k").alias("dst"), "last"), "dst")
            got = near.groupBy("src").agg(F.array(*(F.sum(F.col("w") * F.get("last", F.lit(j))) for j in range(block))).alias("got"))
            rows = written(rows.join(got, F.col("k") == F.col("src"), "left").select("k", "q", F.coalesce("got", F.array_repeat(F.lit(0.0), block)).alias("y")))
            g = products(rows, "q", "y")
            grown = np.zeros((basis, basis))
            grown[: len(small), : len(small)] = small
            grown[:, basis - block :] = g[:basis, basis:]
            grown[basis - block :, :] = grown[:, basis - block :].T
            small = (grown + grown.T) / 2
            beyond = g[basis:, basis:] - g[:basis, basis:].T @ g[:basis, basis:]
        values, vectors = np.linalg.eigh(small)
        best = np.argsort(-values)[:k]
        tail = vectors[basis - block :, best]
        off = np.sqrt(np.maximum(np.einsum("ij,ik,kj->j", tail, beyond, tail), 0))
        if not len(made) or basis >= n or (basis >= 2 * k and off.max() < CLOSE):
            break
        if basis + block > BASIS:
            raise ValueError("the eigenvectors are not found within the largest basis")
    out = written(rows.select("k", times("q", vectors[:, best]).alias("v")))
    discard(spark, path)
    ends = out.agg(*(F.max_by(F.signum(F.get("v", F.lit(j))), F.struct(F.round(F.abs(F.get("v", F.lit(j))), 6).alias("a"), (-F.col("k")).alias("b"))).alias(f"s{j}") for j in range(len(best)))).first()
    signed = F.array(*(F.get("v", F.lit(j)) * float(ends[j] or 1.0) for j in range(len(best))), *(F.lit(0.0) for _ in range(k - len(best))))
    return out.select("k", signed.alias("v")), 1 - values[best]
