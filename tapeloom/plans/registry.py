"""Named queries and the SQL that says the same."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            # this dialect rounds small negative numbers to a negative zero
            ORACLES[name] = re.sub(r", (\d+)\) AS (?=\w)", r", \1) + 0.0 AS ", sql)
        return f

    return keep


MONTHLY = """
ticks AS (SELECT l_suppkey AS symbol, l_shipdate AS t, l_extendedprice / l_quantity AS price, l_quantity AS volume, l_extendedprice AS amount,
  CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END AS outer_vol, row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS o FROM lineitem),
bars AS (SELECT symbol, date_trunc('month', t) AS ts, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close,
  sum(volume) AS volume, round(sum(amount), 2) AS amount, sum(outer_vol) AS outer_vol, count(*) AS n FROM ticks GROUP BY 1, 2)"""

WEEKLY = """
bars AS (SELECT o_orderpriority AS symbol, date_trunc('week', o_orderdate) AS ts, arg_min(o_totalprice, row(o_orderdate, o_orderkey)) AS open, max(o_totalprice) AS high,
  min(o_totalprice) AS low, arg_max(o_totalprice, row(o_orderdate, o_orderkey)) AS close, count(*)::DOUBLE AS volume, round(sum(o_totalprice), 2) AS amount,
  sum(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END)::DOUBLE AS outer_vol, count(*) AS n FROM orders GROUP BY 1, 2)"""

RETURNS = """
r AS (SELECT *, coalesce(close / lag(close) OVER w - 1, 0.0) AS ret, ln(close / lag(close) OVER w) AS logret, close - lag(close) OVER w AS diff, row_number() OVER w AS rn
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""

DIMS = """
dims AS (SELECT s_suppkey AS symbol, n_name AS industry, r_name AS sector, s_acctbal AS cap FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def over(k: int) -> str:
    """The last k rows of a symbol."""
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def prior(k: int) -> str:
    """The k rows before."""
    return f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


W = "OVER (PARTITION BY symbol ORDER BY ts)"
ALL = "OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def corr_sql(x: str, y: str, frame: str) -> str:
    sd = f"(stddev_pop({x}) {frame} * stddev_pop({y}) {frame})"
    return f"coalesce(CASE WHEN {sd} <> 0 THEN covar_pop({x}, {y}) {frame} / {sd} END, 0.0)"


def ratio(a: str, b: str, default: str = "NULL") -> str:
    return f"coalesce(({a}) / nullif(({b}), 0), {default})"
