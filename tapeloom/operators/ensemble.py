"""Learners over folds in time: Spark's tree ensembles and a linear model fitted fold by fold, stacked by a ridge, and searched by the mean coefficient over folds.

A fold is a run of dates. `purged` folds are tested on one run and fitted on all others but the dates near to it; `forward` folds are
fitted on what lies before the tested run alone. A label looks `horizon` bars ahead, so the embargo of both is that many dates.
What comes to the driver are the models, a coefficient a fold, and one matrix of sums as wide as the number of learners.

Rows are laid out by symbol and time before a fit, in PARTS partitions whatever the session's own number, so that draws and thus trees are the
same for a seed. A fit is some hundred jobs of a task a partition, each of which sends a few KB to the driver: few partitions keep that small, and
above PARTS * PART_ROWS rows they grow with the rows.

Defined results: rows with a feature that is null, NaN or infinite take no part; a fold with fewer than LEAST rows to fit or 5 to test,
or with one class only, is left out, and its rows have no prediction; without any fold's coefficient above 0 learners weigh the same.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.operators.mixture import sound
from tapeloom.operators.studies import labels
from tapeloom.operators.timeseries import W, ml_row
from tapeloom.streaming.alerts import scratch

LEAST = 30
#: Fits that run side by side.
AT_ONCE = 4
#: Partitions that fits go through, and rows of one, about, above which there are more.
PARTS, PART_ROWS = 24, 2_000_000
#: Above this a stacked score is a rise, below its negative a fall.
SURE = 0.33
#: Of the ridge, on what is centred.
ALPHA = 1.0


def learning_rows(bars: DataFrame, horizon: int = 5) -> tuple[DataFrame, list[str]]:
    """symbol, ts, the features of each bar that has 30 up to it (before, they are defaults), and y: 1, 0 or -1, null where the future isn't known; with the features' names."""
    x = ml_row(bars)
    x = x.withColumn("rn", F.row_number().over(W())).filter("rn >= 30").drop("rn")
    y = labels(bars, horizon).select("symbol", "ts", F.col("label").cast("double").alias("y"))
    return x.join(y, ["symbol", "ts"], "left"), [c for c in x.columns if c not in ("symbol", "ts")]


@dataclass(frozen=True)
class Fold:
    """Dates by number: tested from lo to hi (exclusive), fitted outside of lo - embargo to hi + embargo, or before lo - embargo alone."""

    no: int
    lo: int
    hi: int
    embargo: int
    forward: bool

    def tests(self, d: Column) -> Column:
        return (d >= self.lo) & (d < self.hi)

    def fits(self, d: Column) -> Column:
        before = d < self.lo - self.embargo
        return before if self.forward else before | (d >= self.hi + self.embargo)


def purged(dates: int, k: int = 5, embargo: int = 5) -> list[Fold]:
    return [Fold(i, i * dates // k, (i + 1) * dates // k, embargo, False) for i in range(k)]


def forward(dates: int, k: int = 5, embargo: int = 5) -> list[Fold]:
    size = dates // (k + 1)
    return [Fold(i, dates - (k - i) * size, dates - (k - i - 1) * size, embargo, True) for i in range(k)] if size else []


def learners(seed: int = 42) -> dict[str, Estimator]:
    return {
        "forest": RandomForestClassifier(labelCol="up", featuresCol="v", numTrees=20, maxDepth=5, minInstancesPerNode=5, seed=seed),
        "boosted": boosted(seed=seed),
        "linear": LogisticRegression(labelCol="up", featuresCol="v", regParam=0.01, maxIter=30),
    }


def boosted(depth: int = 3, rounds: int = 8, rate: float = 0.1, seed: int = 42) -> GBTClassifier:
    return GBTClassifier(labelCol="up", featuresCol="v", maxDepth=depth, maxIter=rounds, stepSize=rate, minInstancesPerNode=5, seed=seed)


class Table:
    """Rows ready to be fitted: numbered dates (d), features as one vector (v), the label (y) and whether it is a rise (up). Held until `close`."""

    def __init__(self, rows: DataFrame, features: Sequence[str]):
        known = rows.filter("y IS NOT NULL").groupBy("ts").agg(F.count("*").alias("n"))
        # a row for each date
        found = known.agg(F.count("*").alias("dates"), F.sum("n").alias("rows")).first()
        self.dates, parts = found.dates, max(PARTS, -(-(found.rows or 0) // PART_ROWS))
        dates = known.select("ts", (F.row_number().over(Window.orderBy("ts")) - 1).alias("d"))
        joined = sound(rows.join(dates, "ts", "left"), features).withColumn("up", (F.col("y") > 0).cast("double"))
        laid = VectorAssembler(inputCols=list(features), outputCol="v").transform(joined).repartition(parts, "symbol").sortWithinPartitions("symbol", "ts")
        # every task of a fit sends the counters of all steps in its lineage, so that ends here
        context = rows.sparkSession.sparkContext
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(scratch(rows.sparkSession, "learning"))
        self.rows = laid.select("symbol", "ts", "d", "y", "up", "v").checkpoint().persist(StorageLevel.MEMORY_AND_DISK)
        self.labelled = self.rows.filter("y IS NOT NULL")

    def close(self) -> None:
        self.rows.unpersist()

    def enough(self, folds: Sequence[Fold | None]) -> list[bool]:
        """Whether each fold (None: all rows) has rows to fit and to test, and rises and others among them: one aggregation for all."""
        d, up, counts = F.col("d"), F.col("up") > 0, []
        for f in folds:
            fits, tests = (f.fits(d), f.tests(d)) if f else (F.lit(True), F.lit(True))
            counts.append(F.struct(F.count_if(fits & up).alias("rises"), F.count_if(fits & ~up).alias("others"), F.count_if(tests).alias("tested")))
        found = self.labelled.agg(F.array(*counts).alias("c")).first().c if counts else []
        return [c.rises + c.others >= LEAST and c.rises > 0 and c.others > 0 and c.tested >= 5 for c in found]

    def fit(self, made: dict[str, Estimator], folds: Sequence[Fold | None]) -> list[dict[str, Model | None]]:
        """For each fold, each learner fitted outside of it; None where there is too little."""
        use = [self.labelled.filter(f.fits(F.col("d"))) if f else self.labelled for f in folds]
        tasks = [(i, n) for i, ok in enumerate(self.enough(folds)) if ok for n in made]
        out: list[dict[str, Model | None]] = [dict.fromkeys(made) for _ in folds]
        # a fit is many small jobs one after another, so several fits share the cluster
        with ThreadPoolExecutor(AT_ONCE) as pool:
            fitted = pool.map(inheritable_thread_target(self.rows.sparkSession)(lambda task: made[task[1]].copy().fit(use[task[0]])), tasks)
            for (i, n), model in zip(tasks, fitted, strict=True):
                out[i][n] = model
        return out


def scored(rows: DataFrame, models: dict[str, Model | None]) -> DataFrame:
    """A column for each learner: the chance of a rise, null without a model. Chained, so that no rows are joined."""
    for name, model in models.items():
        if model is None:
            rows = rows.withColumn(name, F.lit(None).cast("double"))
            continue
        drop = [c for c in ("rawPrediction", "probability", "prediction") if model.hasParam(c + "Col")]
        rows = model.transform(rows).withColumn(name, vector_to_array("probability")[1]).drop(*drop)
    return rows


def out_of_fold(table: Table, made: dict[str, Estimator], folds: Sequence[Fold]) -> DataFrame:
    """The tested rows of each fold with its number and what learners say that haven't seen them."""
    parts = [scored(table.labelled.filter(f.tests(F.col("d"))), models).withColumn("fold", F.lit(f.no)) for f, models in zip(folds, table.fit(made, folds), strict=True)]
    if not parts:
        return scored(table.labelled.limit(0), dict.fromkeys(made)).withColumn("fold", F.lit(0))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def coefficients(tested: DataFrame, names: Sequence[str]) -> DataFrame:
    """learner, fold, n, ic: the correlation of what a learner says with the label, 0 where either doesn't vary, and accuracy of a rise at 0.5."""
    each = tested.select("fold", "y", "up", F.explode(F.array(*(F.struct(F.lit(n).alias("learner"), F.col(n).alias("p")) for n in names))).alias("s")).select("fold", "y", "up", "s.*").filter("p IS NOT NULL")
    spread = F.stddev_pop("p") * F.stddev_pop("y")
    return each.groupBy("learner", "fold").agg(F.count("*").alias("n"), F.when(spread > 1e-12, F.covar_pop("p", "y") / spread).otherwise(0.0).alias("ic"), F.avg(((F.col("p") > 0.5) == (F.col("up") > 0)).cast("double")).alias("accuracy"))


def ridge(tested: DataFrame, names: Sequence[str], alpha: float = ALPHA) -> tuple[float, dict[str, float]]:
    """Intercept and weights of learners that fit the label best, the intercept free: one aggregation of sums and products."""
    cols = [F.col(n) for n in names] + [F.col("y")]
    full = tested.select(*(c.alias(f"z{i}") for i, c in enumerate(cols))).dropna()
    k = len(cols)
    z = [F.col(f"z{i}") for i in range(k)]
    sums = full.agg(F.count("*"), *(F.sum(c) for c in z), *(F.sum(z[i] * z[j]) for i in range(k) for j in range(k))).first()
    n = sums[0]
    if not n:
        return 0.0, dict.fromkeys(names, 1 / max(1, len(names)))
    mean = np.array(sums[1 : k + 1]) / n
    gram = np.array(sums[k + 1 :]).reshape(k, k) - n * np.outer(mean, mean)
    w = np.linalg.solve(gram[:-1, :-1] + alpha * np.eye(k - 1), gram[:-1, -1])
    return float(mean[-1] - w @ mean[:-1]), dict(zip(names, map(float, w), strict=True))


def stacked(rows: DataFrame, intercept: float, weights: dict[str, float]) -> DataFrame:
    """Adds score, and call: 1, 0 or -1."""
    score = sum((F.col(n) * w for n, w in weights.items()), F.lit(intercept))
    return rows.withColumn("score", score).withColumn("call", F.when(F.col("score") > SURE, 1).when(F.col("score") < -SURE, -1).when(F.col("score").isNotNull(), 0))


def stack(rows: DataFrame, features: Sequence[str], made: dict[str, Estimator] | None = None, k: int = 5, embargo: int = 5) -> DataFrame:
    """Every sound row once: symbol, ts, y, fold, a column for each learner, score and call.

    Rows with a label have what learners of their fold say; the others (fold null) what learners fitted on all rows with one say.
    Learners whose mean coefficient over folds is above 0 are weighed by the ridge.
    """
    made = made or learners()
    table = Table(rows, features)
    try:
        tested = out_of_fold(table, made, purged(table.dates, k, embargo)).persist(StorageLevel.MEMORY_AND_DISK)
        ics: dict[str, list[float]] = {}
        for r in coefficients(tested, list(made)).collect():  # a number a learner and fold
            ics.setdefault(r.learner, []).append(r.ic)
        good = [n for n in made if ics.get(n) and np.mean(ics[n]) > 0]
        intercept, weights = ridge(tested, good) if good else (0.0, dict.fromkeys(made, 1 / len(made)))
        new = scored(table.rows.filter("y IS NULL"), table.fit(made, [None])[0]).withColumn("fold", F.lit(None).cast("int"))
        tested.unpersist()
        return stacked(tested.unionByName(new), intercept, weights).select("symbol", "ts", "y", "fold", *made, "score", "call")
    finally:
        table.close()


def tested_forward(rows: DataFrame, features: Sequence[str], made: dict[str, Estimator] | None = None, k: int = 5, embargo: int = 5) -> DataFrame:
    """Each learner's coefficient and accuracy on each run of dates, fitted on what lies before it."""
    made = made or learners()
    table = Table(rows, features)
    try:
        return coefficients(out_of_fold(table, made, forward(table.dates, k, embargo)), list(made))
    finally:
        table.close()


def searched(rows: DataFrame, features: Sequence[str], grid: dict[str, Sequence], k: int = 3, embargo: int = 5) -> DataFrame:
    """Each combination of the boosted trees' settings, the folds it was tested on, the mean coefficient over them and its place, best first."""
    table = Table(rows, features)
    try:
        settings = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
        out = coefficients(out_of_fold(table, {f"s{i}": boosted(**s) for i, s in enumerate(settings)}, forward(table.dates, k, embargo)), [f"s{i}" for i in range(len(settings))])
        named = F.array(*(F.struct(F.lit(f"s{i}").alias("learner"), F.lit(i).alias("no"), *(F.lit(v).alias(n) for n, v in s.items())) for i, s in enumerate(settings)))
        mean = out.groupBy("learner").agg(F.count("*").alias("folds"), F.avg("ic").alias("ic"))
        # a row a combination: the grid is an argument, not data
        all_settings = rows.sparkSession.range(1).select(F.explode(named).alias("s")).select("s.*")
        q = all_settings.join(mean, "learner", "left").select("no", *grid, F.coalesce("folds", F.lit(0)).alias("folds"), F.round(F.coalesce("ic", F.lit(0.0)), 6).alias("ic"))
        return q.withColumn("place", F.row_number().over(Window.orderBy(F.desc("ic"), "no"))).drop("no")
    finally:
        table.close()
