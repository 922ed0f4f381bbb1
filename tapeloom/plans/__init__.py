"""Registered queries over the driver's tables, each with the SQL that says the same."""

from tapeloom.plans import composites, engines, ensembles, factors, feeds, ladders, linears, mixtures, panels, series, states, streams, studies  # noqa: F401
from tapeloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
