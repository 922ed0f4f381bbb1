"""Centroid clustering over a vector-approximation file.

Each component of a vector is an integer, floor(scale * x). A component is approximated by one of 64 cells of its dimension, six
bits, so that the approximations take a quarter of the vectors and less when compressed. The cells' edges follow from mean, deviation,
least and greatest value of a dimension over all vectors, and a cell is a range of integers.

To assign vectors, only the approximations are read. For a dimension's cell and a centroid, a table has the least and the
greatest squared gap of any value in the cell; their sums over the dimensions are an interval that holds the distance. A
centroid is a candidate unless its interval begins above the end of another's. A vector with one candidate is assigned
by that; where intervals overlap, the vector itself is fetched and held against its candidates alone. The sums behind the
centroids are kept and changed by the vectors that move, so that only these and the undecided ones are fetched in a round; the last
assignment fetches all vectors for their distances. Vectors are in buckets by their row number, so that a fetch moves only
numbers and candidates.

To the driver come sums by cluster and dimension, at most `MAX_CENTROIDS` * dims rows, and nothing by vector.

Defined results: vectors that are null, of another length, or with a component that is null, NaN or infinite are left out;
vectors without an id are assigned like any other, but their ids sort last for the first centroids; repeated ids are rows of
their own, ordered by their components for the first centroids; fewer vectors than centroids make a centroid of each; equal distances go to the
smaller number; an empty table gives an empty result; a component of 2**27 and more after scaling raises, as a squared
distance would not fit a long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.shared import Workspace
from tapeloom.llm.textbuf import buffers

DIMS = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
CELLS = 64
SPAN = 3.0
MAX_CENTROIDS = 4096
LIMIT = 1 << 27
SLICE = 2048

Batches = Iterator[pa.RecordBatch]


def quantised(embeddings: DataFrame, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, v: the integers of each vector that has all of its components."""
    x = F.col("embedding")
    sound = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = lambda c: F.floor(F.lit(float(scale)) * c.cast("double"))
    whole = F.transform(x, lambda c: F.when(F.abs(c.cast("double") * scale) < LIMIT - 1, scaled(c)).otherwise(F.raise_error(F.lit(f"a component is beyond {LIMIT} after scaling"))).cast("int"))
    return embeddings.filter(F.coalesce(sound, F.lit(False))).select("vec_id", whole.alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """The vectors of a list column as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def edges(stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last integer of each cell, by dimension, of rows (count, sum, sum of squares, least, greatest).

    Inner edges are evenly spaced over `SPAN` deviations on both sides of the mean, as far as there are values; the outermost
    cells reach to the least and the greatest value. An empty cell ends before it begins, and no value is in it.
    """
    n, total, squares, least, most = (stats[:, i].astype(float) for i in range(5))
    mean = total / n
    spread = np.sqrt(np.maximum(squares / n - mean * mean, 0))
    begin, end = np.maximum(least, mean - SPAN * spread), np.minimum(most + 1, mean + SPAN * spread)
    inner = np.ceil(begin[:, None] + (end - begin)[:, None] * np.arange(1, CELLS) / CELLS)
    first = np.concatenate([least[:, None], np.clip(inner, least[:, None], most[:, None] + 1)], 1).astype(np.int64)
    last = np.concatenate([first[:, 1:] - 1, most[:, None].astype(np.int64)], 1)
    return first, last


def approximate(v: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The cells of vectors, a byte for a dimension."""
    return np.stack([np.searchsorted(first[j, 1:], v[:, j], "right") for j in range(v.shape[1])], 1).astype(np.uint8)


def binary_rows(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def tables(centroids: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared gap: (dimension, cell, centroid)."""
    c = centroids.T[:, None, :]
    lo, hi = first[:, :, None], np.maximum(first, last)[:, :, None]
    under, over = np.maximum(lo - c, 0), np.maximum(c - hi, 0)
    return (under + over) ** 2, np.maximum((c - lo) ** 2, (c - hi) ** 2)


def intervals(cells: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the squared distance of each vector to each centroid."""
    low = np.zeros((len(cells), least.shape[2]), np.int64)
    high = np.zeros_like(low)
    for j in range(cells.shape[1]):
        low += least[j, cells[:, j]]
        high += most[j, cells[:, j]]
    return low, high


def _narrowed(centroids: np.ndarray, first: np.ndarray, last: np.ndarray) -> Callable[[Batches], Batches]:
    """row, cells, cluster -> those and the numbers of the centroids that may be nearest."""

    def run(batches: Batches) -> Batches:
        least, most = tables(centroids, first, last)
        for batch in batches:
            data, _ = buffers(batch.column("cells"))
            cells = data.reshape(batch.num_rows, least.shape[0])
            counts, found = [], []
            for at in range(0, batch.num_rows, SLICE):
                low, high = intervals(cells[at : at + SLICE], least, most)
                open_ = low <= high.min(1)[:, None]
                counts.append(open_.sum(1))
                found.append(np.nonzero(open_)[1])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts or [[]]))]).astype(np.int32)
            values = np.concatenate(found or [[]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], ["row", "cells", "cluster", "candidates"])

    return run


def nearest(v: np.ndarray, counts: np.ndarray, candidates: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of each vector's candidates, which are in order, and the squared distance to it."""
    begin = np.cumsum(counts) - counts
    gap = v[np.repeat(np.arange(len(v)), counts)] - centroids[candidates]
    distance = (gap * gap).sum(1)
    least = np.minimum.reduceat(distance, begin)
    hits = np.flatnonzero(distance == np.repeat(least, counts))
    return candidates[hits[np.searchsorted(hits, begin)]], least


def _fetched(centroids: np.ndarray, dims: int, keep: tuple[str, ...]) -> Callable[[Batches], Batches]:
    """Columns to keep, candidates, v -> the kept columns, nearest centroid, distance."""

    def run(batches: Batches) -> Batches:
        for batch in batches:
            cluster, distance = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                lists = part.column("candidates")
                found = nearest(matrix(part.column("v"), dims), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), centroids)
                cluster.append(found[0])
                distance.append(found[1])
            new = [pa.array(np.concatenate(cluster).astype(np.int32)), pa.array(np.concatenate(distance).astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *new], [*keep, "nearest", "distance"])

    return run


def _statistics(dims: int) -> Callable[[Batches], Batches]:
    """v -> count, sum, sum of squares, least and greatest value by dimension, a row each for a task."""

    def run(batches: Batches) -> Batches:
        n, total, squares = 0, np.zeros(dims, np.int64), np.zeros(dims)
        least, most = np.full(dims, LIMIT), np.full(dims, -LIMIT)
        for batch in batches:
            if batch.num_rows:
                v = matrix(batch.column(0), dims)
                n += len(v)
                total += v.sum(0)
                squares += (v.astype(float) ** 2).sum(0)
                least, most = np.minimum(least, v.min(0)), np.maximum(most, v.max(0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(dims), np.full(dims, n), total, squares, least, most)], ["dim", "n", "total", "squares", "least", "most"])

    return run


def _moves(dims: int, count: int) -> Callable[[Batches], Batches]:
    """was, cluster, v -> what comes to each cluster, less what leaves it: a row for a cluster and dimension in a task."""

    def run(batches: Batches) -> Batches:
        total, n = np.zeros((count, dims), np.int64), np.zeros(count, np.int64)
        for batch in batches:
            v = matrix(batch.column("v"), dims)
            for name, sign in (("cluster", 1), ("was", -1)):
                to = batch.column(name).to_numpy(zero_copy_only=False)
                use = to >= 0
                np.add.at(total, to[use], sign * v[use])
                n += sign * np.bincount(to[use], minlength=count)
        touched = np.flatnonzero(n.astype(bool) | total.any(1))
        if len(touched):
            cluster = np.repeat(touched, dims).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(touched))), pa.array(np.repeat(n[touched], dims)), pa.array(total[touched].ravel())], ["cluster", "dim", "n", "total"])

    return run


def cluster(embeddings: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE) -> DataFrame:
    """vec_id, embedding -> vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row for each sound vector."""
    if not 0 < centroids <= MAX_CENTROIDS:
        raise ValueError(f"1 to {MAX_CENTROIDS} centroids")
    spark = embeddings.sparkSession
    with Workspace(spark) as space:
        vectors = space.bucketed(quantised(embeddings, dims, scale).withColumn("row", F.monotonically_increasing_id()), "row", "va-vectors")
        order = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
        start = vectors.select(order.alias("place"), "v").orderBy(F.asc_nulls_last("place"), "v").limit(centroids).collect()
        if not start:
            empty = "vec_id {}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
            return spark.createDataFrame([], empty.format(embeddings.schema["vec_id"].dataType.simpleString()))
        middle = np.array([r.v for r in start], np.int64)
        found = vectors.select("v").mapInArrow(_statistics(dims), "dim long, n long, total long, squares double, least long, most long")
        found = found.groupBy("dim").agg(*(F.sum(c) for c in ("n", "total", "squares")), F.min("least"), F.max("most")).orderBy("dim").collect()
        first, last = edges(np.array([tuple(r)[1:] for r in found]))

        def marked(batches: Batches) -> Batches:
            for batch in batches:
                cells = approximate(matrix(batch.column("v"), dims), first)
                yield pa.RecordBatch.from_arrays([batch.column("row"), binary_rows(cells), pa.array(np.full(len(cells), -1, np.int32))], ["row", "cells", "cluster"])

        state = space.keep(vectors.select("row", "v").mapInArrow(marked, "row long, cells binary, cluster int"), "va-cells")
        total, count = np.zeros((len(middle), dims), np.int64), np.zeros(len(middle), np.int64)
        seen_as = "row long, cells binary, cluster int, candidates array<int>"
        for number in range(rounds):
            seen = space.keep(state.select("row", "cells", "cluster").mapInArrow(_narrowed(middle, first, last), seen_as), f"va-seen-{number}")
            same = (F.size("candidates") == 1) & (F.element_at("candidates", 1) == F.col("cluster"))
            fetched = seen.filter(~same).join(vectors.select("row", "v"), "row")
            fetched = fetched.mapInArrow(_fetched(middle, dims, ("row", "cells", "cluster", "v")), "row long, cells binary, cluster int, v array<int>, nearest int, distance long")
            moved = F.when(F.col("nearest") != F.col("cluster"), F.col("v"))
            fetched = fetched.select("row", "cells", F.col("nearest").alias("cluster"), F.col("cluster").alias("was"), moved.alias("v"))
            quiet = seen.filter(same).select("row", "cells", "cluster", F.col("cluster").alias("was"), F.lit(None).cast("array<int>").alias("v"))
            state = space.keep(quiet.unionByName(fetched), f"va-state-{number}")
            changes = state.filter("v IS NOT NULL").select("was", "cluster", "v").mapInArrow(_moves(dims, len(middle)), "cluster int, dim int, n long, total long")
            for r in changes.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
                total[r.cluster, r.dim] += r.total
                count[r.cluster] += r.n if r.dim == 0 else 0
            full = count > 0
            middle = middle.copy()
            middle[full] = total[full] // count[full, None]
        seen = state.select("row", "cells", "cluster").mapInArrow(_narrowed(middle, first, last), seen_as).select("row", "candidates")
        assigned = seen.join(vectors, "row").mapInArrow(_fetched(middle, dims, ("vec_id",)), f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, nearest int, distance long")
        assigned = space.keep(assigned.withColumnRenamed("nearest", "cluster"), "va-assigned")
        inertia = {r["cluster"]: int(r.inertia) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
        name = lambda c: hashlib.sha256(",".join(map(str, middle[c].tolist())).encode()).hexdigest()
        about = spark.createDataFrame([(c, i, sum(inertia.values()), name(c)) for c, i in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
        return space.result(assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "va-result")


def _round(k: int) -> str:
    """The assignment to centroids k, and centroids k + 1 from it."""
    return f"""
    a{k} AS (
        SELECT rid, CAST(arg_min(c, d * {MAX_CENTROIDS} + c) AS INT) AS c, min(d) AS d FROM (
            SELECT x.rid, m.c, CAST(list_sum(list_transform(list_zip(x.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS HUGEINT) AS d FROM kept x CROSS JOIN c{k} m
        ) GROUP BY rid),
    c{k + 1} AS (
        SELECT c{k}.c, coalesce(m.v, c{k}.v) AS v FROM c{k} LEFT JOIN (
            SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
                SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(range({DIMS})) AS i, unnest(k.v) AS x FROM a{k} a JOIN kept k USING (rid)) GROUP BY c, i
            ) GROUP BY c
        ) m USING (c))"""


ORACLE = f"""
    WITH kept AS MATERIALIZED (
        SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
        WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
    c0 AS (
        SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM kept
        QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) <= {CENTROIDS}),
    {",".join(_round(k) for k in range(ROUNDS + 1))},
    per AS (SELECT c, CAST(sum(d) AS BIGINT) AS cluster_inertia FROM a{ROUNDS} GROUP BY c)
    SELECT k.vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance, per.cluster_inertia, CAST((SELECT sum(cluster_inertia) FROM per) AS BIGINT) AS inertia,
        sha256(array_to_string(m.v, ',')) AS centroid_sha256
    FROM kept k JOIN a{ROUNDS} a USING (rid) JOIN per USING (c) JOIN c{ROUNDS} m USING (c)
"""
