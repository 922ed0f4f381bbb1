"""Every registered market query against its SQL on the smallest tables, and properties that SQL doesn't show."""

import datetime as dt
import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tapeloom.operators import crosssection, fold, rules, timeseries
from tapeloom.plans import ORACLES, QUERIES
from tapeloom.sources import market

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{DATA}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)) or v is pd.NA:
            return "~"
        if isinstance(v, pd.Timestamp | dt.datetime):
            return str(pd.Timestamp(v))
        if isinstance(v, bool):
            return str(v)
        try:
            return f"{float(v):.9g}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, duck, name):
    assert canonical(QUERIES[name](spark, DATA).toPandas()) == canonical(duck.sql(ORACLES[name]).df())


def test_entry_and_registries(spark):
    assert entry_point.entry(spark).columns == ["ts", "symbol", "score", "place"]
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def bars(spark, series: dict[str, list[float]]):
    rows = [(s, dt.datetime(2020, 1, 1) + dt.timedelta(days=i), c, c + 1, c - 1, c, 100.0 + i, c * 100, 50.0) for s, closes in series.items() for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double, amount double, outer_vol double")


WAVE = [100 + 10 * math.sin(i / 3) + i / 5 for i in range(70)]


def test_no_feature_looks_ahead(spark):
    whole, part = bars(spark, {"a": WAVE}), bars(spark, {"a": WAVE[:40]})
    for f in (timeseries.alpha_factors, timeseries.ml_row, timeseries.realised, timeseries.volume_indicators, timeseries.drawdown, timeseries.regime, fold.macd, fold.rsi_wilder, fold.adx, fold.garch, fold.atr_wilder):
        assert canonical(f(whole).filter(F.col("ts") < "2020-02-10").toPandas()) == canonical(f(part).toPandas()), f.__name__


def test_constant_and_short_series(spark):
    b = bars(spark, {"flat": [5.0] * 40, "one": [3.0], "two": [1.0, 2.0]})
    out = timeseries.alpha_factors(b).toPandas()
    assert len(out) == 43 and not out.drop(columns=["symbol", "ts"]).isin([float("inf")]).any().any()
    assert {r.corr for r in b.select(timeseries.ts_corr("close", "volume", 10).alias("corr")).collect()} == {0.0}
    rsi = fold.rsi_wilder(b).filter("symbol = 'flat'").agg(F.min("rsi"), F.max("rsi")).first()
    assert tuple(rsi) == (50.0, 100.0)
    assert fold.ema_series(b.limit(0), 5).collect() == []


def test_rsi_stays_in_bounds(spark):
    b = timeseries.returns(bars(spark, {"a": WAVE, "b": WAVE[::-1]}))
    for rsi in (timeseries.rsi_cutler(14), timeseries.rsi_winners(14), timeseries.rsi_recent_gains(14)):
        low, high = b.select(rsi.alias("r")).agg(F.min("r"), F.max("r")).first()
        assert 0 <= low and high <= 100


def test_fold_against_a_loop(spark):
    got = [r.ema for r in fold.ema_series(bars(spark, {"a": WAVE}), 12).orderBy("ts").collect()]
    state, want = WAVE[0], []
    for x in WAVE:
        state += (x - state) * 2 / 13
        want.append(state)
    assert got == pytest.approx(want)


def test_neutral_factors_sum_to_nearly_nothing(spark):
    rows = spark.createDataFrame([("d", i % 3, float(i)) for i in range(30)], "ts string, industry int, x double")
    from pyspark.sql import Window

    out = rows.select("industry", crosssection.neutralise_group(F.col("x"), Window.partitionBy("ts", "industry")).alias("r")).groupBy("industry").agg(F.sum("r").alias("s")).collect()
    assert all(abs(r.s) < 1 for r in out)


def test_same_result_for_any_number_of_partitions(spark):
    b = market.monthly_bars(spark, DATA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(canonical(crosssection.scoreboard(b, market.industries(spark, DATA)).toPandas()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]


def test_quotes_and_units(spark):
    lines = ['v_sz="1~name~000001~10.5~10.0~x~200~9.9/9.5/1"', "", 'v="1~a"', None]
    out = [r.q for r in spark.createDataFrame([(s,) for s in lines], "line string").select(market.quote_fields(F.col("line")).alias("q")).collect()]
    assert (out[0].price, out[0].open, out[0].low, out[1].price, out[3]["code"] if out[3] else None) == (10.5, None, 9.5, None, None)
    said = spark.createDataFrame([("12.3%",), ("1.2亿",), ("3万",), ("-",), (None,)], "s string")
    assert [r.v for r in said.select(market.unit_number(F.col("s")).alias("v")).collect()] == [12.3, 1.2e8, 3e4, None, None]


def test_rules(spark):
    one = spark.range(1)
    signals = [("buy", "buy", "strong_buy"), ("hold", "sell", "sell"), ("buy", "hold", "buy"), ("buy", "sell", "hold"), ("hold", "hold", "hold")]
    for a, b, want in signals:
        assert one.select(rules.combine(F.lit(a), F.lit(b))).first()[0] == want
    assert [one.select(rules.board_limit(F.lit(c))).first()[0] for c in ("600000", "688001", "300001", "830001")] == [0.1, 0.2, 0.2, 0.3]
    assert one.select(rules.at_limit(F.lit(11.0), F.lit(10.0), F.lit(0.1))).first()[0] == "up"
    assert one.select(rules.lots(F.lit(250.0))).first()[0] == 200
    assert 0.05 <= one.select(rules.kelly(F.lit(0.9), F.lit(3.0), F.lit(0.1))).first()[0] <= 0.25
