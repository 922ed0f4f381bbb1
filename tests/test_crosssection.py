"""Cross-sections by date without gathering a date."""

import numpy as np
import pandas as pd

from tapeloom.operators import crosssection
from tapeloom.plans import QUERIES

DATA = "/root/testdata/sf0.001"


def plain(x, industry, size):
    x = np.round(np.maximum(x.mean() - 3 * x.std(), np.minimum(x.mean() + 3 * x.std(), x)), 9)
    p = np.clip((pd.Series(x).rank().to_numpy() - 0.5) / (len(x) + 1), 1e-6, 1 - 1e-6)
    t = np.sqrt(-2 * np.log(np.minimum(p, 1 - p)))
    z = t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3)
    z = np.where(p >= 0.5, z, -z)
    z = z - np.array([z[industry == i].sum() / ((industry == i).sum() + 0.01) for i in industry])
    one = np.column_stack([size, np.ones(len(z))])
    return z - one @ np.linalg.solve(one.T @ one + 0.01 * np.eye(2), one.T @ z)


def test_neutral_normal_is_that_of_a_loop(spark):
    rng, rows, want = np.random.default_rng(3), [], {}
    for d in range(3):
        n = 40 + d
        x, flat, size, industry = np.round(rng.normal(size=n) ** 3, 1), np.full(n, 2.5), rng.uniform(1, 9, n), np.array(list("abc"))[rng.integers(0, 3, n)]
        rows += [(d, i, str(industry[i]), float(size[i]), float(x[i]), float(flat[i])) for i in range(n)]
        want |= {(d, i): v for i, v in enumerate(zip(plain(x, industry, size), plain(flat, industry, size), strict=True))}
    df = spark.createDataFrame(rows, "ts int, symbol int, industry string, size double, x double, flat double")
    got = {(r.ts, r.symbol): (r.x, r.flat) for r in crosssection.neutral_normal(df, ["x", "flat"]).collect()}
    assert got.keys() == want.keys() and max(np.abs(np.subtract(got[k], want[k])).max() for k in want) < 1e-9


def test_no_window_takes_a_whole_date_of_all_columns(spark):
    for name in ("x19_normalised_factors", "x24_scoreboard"):
        plan = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        by_date = [line for line in plan.splitlines() if "Window [" in line and "windowspecdefinition(ts#" in line and "row_number()" not in line]
        assert not by_date, name
