"""Queries of learners over folds in time. Trees are beyond SQL; tests hold folds, stacking and places against plain versions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.operators import ensemble
from tapeloom.plans.registry import query
from tapeloom.sources import market as m


@query("m02_stacking")
def m02(spark, d):
    """What stacked learners say of every bar, none of them having seen it."""
    rows, features = ensemble.learning_rows(m.monthly_bars(spark, d))
    out = ensemble.stack(rows, features)
    return out.select("symbol", "ts", "y", "fold", *(F.round(c, 6).alias(c) for c in (*ensemble.learners(), "score")), "call")


@query("m03_forward_learners")
def m03(spark, d):
    rows, features = ensemble.learning_rows(m.monthly_bars(spark, d))
    return ensemble.tested_forward(rows, features).select("learner", "fold", "n", F.round("ic", 6).alias("ic"), F.round("accuracy", 6).alias("accuracy"))


@query("m08_settings")
def m08(spark, d):
    rows, features = ensemble.learning_rows(m.monthly_bars(spark, d))
    return ensemble.searched(rows, features, {"depth": (2, 4), "rounds": (4, 8)})
