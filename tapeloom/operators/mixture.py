"""Regimes as a Gaussian mixture: expectation-maximisation with full covariances.

Features are packed once, a block of doubles for each Arrow batch, and the blocks are held: a round reads bytes and converts no row. A round is one
pass: each task adds up weights, weighted sums and weighted products of its rows' responsibilities, and these sums, k * (1 + d + d * d) numbers
whatever the number of rows, are added by one aggregation and come to the driver, which makes the next round's parameters of them. The start is
fixed: the means one deviation below, at and above that of the first feature, so that reruns agree and components are in its order.

Defined results: rows with a feature that is null, NaN or infinite take no part, and have no regime; a feature that doesn't vary is left at 0; no
sound row raises; rows far from all components go to the nearest by density. Covariances have `RIDGE` added on the diagonal.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RIDGE = 1e-6
ROUNDS = 200
GAIN = 1e-7


@dataclass(frozen=True)
class Mixture:
    """Of scaled features: weights (k), means (k, d), covariances (k, d, d); and the mean log-likelihood before each round."""

    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    likelihoods: list[float] = field(default_factory=list)

    @cached_property
    def roots(self) -> list[tuple[np.ndarray, float]]:
        """For each component the inverse of its covariance's Cholesky root, and the logarithm of weight times density at its mean."""
        out = []
        for w, c in zip(self.weights, self.covariances, strict=True):
            root = np.linalg.cholesky(c)
            out.append((np.linalg.inv(root), float(np.log(max(w, 1e-300)) - np.log(np.diag(root)).sum() - 0.5 * len(c) * np.log(2 * np.pi))))
        return out

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Scaled features, a row for each: what is added up lies side by side."""
        return (x.T - self.centre[:, None]) / self.scale[:, None]

    def weighed(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of scaled features: probabilities by component and place, and the log-likelihood of each place."""
        log = np.empty((len(self.weights), z.shape[1]))
        for k, (inverse, height) in enumerate(self.roots):
            far = inverse @ (z - self.means[k][:, None])
            log[k] = height - 0.5 * (far * far).sum(0)
        top = log.max(0)
        log -= top
        np.exp(log, out=log)
        total = log.sum(0)
        log /= total
        return log, top + np.log(total)

    def responsibilities(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities by row and component, and each row's log-likelihood."""
        r, likelihood = self.weighed(self.scaled(x))
        return np.ascontiguousarray(r.T), likelihood


def sound(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose features are numbers; `x` holds them."""
    ok = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")) for c in columns]
    keep = ok[0]
    for o in ok[1:]:
        keep = keep & o
    return rows.filter(keep).withColumn("x", F.array(*(F.col(c).cast("double") for c in columns)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _packed(d: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """x -> a row for each batch: the bytes of its features, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([_matrix(batch.column(0), d).tobytes()], pa.binary())], ["block"])

    return run


def _added(blocks: DataFrame, d: int, width: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all blocks of what a block's rows come to: `width` numbers, added up in the tasks and by one aggregation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            for block in batch.column(0):
                total += of(np.frombuffer(block.as_buffer()).reshape(-1, d))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(total)], ["place", "value"])

    out = np.zeros(width)
    for r in blocks.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).collect():
        out[r.place] = r.value
    return out


def _sums(model: Mixture) -> Callable[[np.ndarray], np.ndarray]:
    """Rows -> their sums: for each component weight, first and second moments, and at the end the log-likelihood and rows."""

    def of(x: np.ndarray) -> np.ndarray:
        z = model.scaled(x)
        r, likelihood = model.weighed(z)
        return np.concatenate([r.sum(1), (r @ z.T).ravel(), *(((z * own) @ z.T).ravel() for own in r), [likelihood.sum(), len(x)]])

    return of


def fit(rows: DataFrame, columns: Sequence[str], k: int = 3, rounds: int = ROUNDS, gain: float = GAIN) -> Mixture:
    """The mixture of k components; it ends when a round adds less than `gain` to the mean log-likelihood."""
    d = len(columns)
    blocks = sound(rows, columns).select("x").mapInArrow(_packed(d), "block binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        total = _added(blocks, d, d + 1, lambda x: np.append(x.sum(0), len(x)))
        if not total[-1]:
            raise ValueError("no row with all features")
        centre = total[:-1] / total[-1]
        spread = np.sqrt(_added(blocks, d, d, lambda x: ((x - centre) ** 2).sum(0)) / total[-1])
        means = np.zeros((k, d))
        means[:, 0] = np.linspace(-1, 1, k)
        model = Mixture(centre, np.where(spread < 1e-10, 1.0, spread), np.full(k, 1 / k), means, np.repeat(np.eye(d)[None], k, 0))
        for _ in range(rounds):
            total = _added(blocks, d, k * (1 + d + d * d) + 2, _sums(model))
            n, likelihoods = total[:k], [*model.likelihoods, total[-2] / total[-1]]
            held = np.maximum(n, 1e-12)
            means = total[k : k + k * d].reshape(k, d) / held[:, None]
            second = total[k + k * d : -2].reshape(k, d, d) / held[:, None, None]
            model = Mixture(model.centre, model.scale, n / total[-1], means, second - means[:, :, None] * means[:, None, :] + RIDGE * np.eye(d), likelihoods)
            if len(likelihoods) > 1 and likelihoods[-1] - likelihoods[-2] < gain:
                break
    finally:
        blocks.unpersist()
    return model


def regimes(rows: DataFrame, columns: Sequence[str], model: Mixture, keys: Sequence[str] = ("symbol", "ts")) -> DataFrame:
    """keys, probabilities (an array, components by their mean of the first feature) and regime (the most probable one's number)."""
    order = np.argsort(model.means[:, 0], kind="stable")
    source = sound(rows, columns).select(*keys, "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.responsibilities(_matrix(batch.column("x"), len(columns)))[0][:, order]
            offsets = pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keys), pa.ListArray.from_arrays(offsets, pa.array(p.ravel())), pa.array(p.argmax(1).astype(np.int32))], [*keys, "probabilities", "regime"])

    kept = ", ".join(f"`{c}` {source.schema[c].dataType.simpleString()}" for c in keys)
    return source.mapInArrow(run, f"{kept}, probabilities array<double>, regime int")
