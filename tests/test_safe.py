"""Moments of groups that are added up from parts."""

from pyspark.sql import functions as F

from tapeloom.functions.safe import corr_agg, deviation_agg
from tapeloom.operators import factors, sets


def test_a_constant_added_up_from_parts_has_no_deviation_and_no_correlation(spark):
    # eight parts of eleven rows: 50 / 11 * 11 is not 50
    rows = spark.range(0, 88, 1, 8).select((F.col("id") * 0 + 50.0).alias("x"), F.rand(3).alias("y"), F.col("id").cast("double").alias("z"))
    got = rows.agg(deviation_agg(F.col("x")).alias("deviation"), corr_agg(F.col("x"), F.col("y")).alias("right"), corr_agg(F.col("y"), F.col("x")).alias("left"), corr_agg(F.col("z"), F.col("z")).alias("own")).first()
    assert (got.deviation, got.right, got.left, round(got.own, 9)) == (0.0, 0.0, 0.0, 1.0)
    gaps = spark.createDataFrame([(None,), (None,)], "x double").agg(deviation_agg(F.col("x")).alias("none")).first()
    assert gaps.none is None


def test_a_factor_that_does_not_vary_has_no_rank_and_no_slope(spark):
    # a date's eight parts of eleven symbols; two factors stand at 50
    rows = spark.range(0, 88, 1, 8).select(F.col("id").alias("symbol"), F.lit("d").alias("ts"), F.rand(1).alias("mom5"), F.rand(2).alias("ret_sd"), (F.col("id") * 0 + 50.0).alias("vol_ratio"), F.rand(4).alias("mom20"), (F.col("id") * 0 + 50.0).alias("rsi14"), F.rand(5).alias("ret_next"))
    got = {r.factor: r for r in factors.ranked(factors.ics(factors.long_form(rows))).collect()}
    assert (got["rsi14"].ic, got["vol_ratio"].ic) == (0.0, 0.0) and got["mom5"].ic != 0
    assert factors.regression_moments(rows).first().y3 == 0.0


def test_a_ratio_of_coefficients_that_do_not_vary_is_nothing(spark):
    by_date = spark.range(0, 88, 1, 8).select(F.lit("f").alias("factor"), (F.col("id") * 0 + 50.0).alias("ic"))
    assert factors.ranked(by_date).first().icir == 0.0
    pair = spark.range(0, 88, 1, 8).select(F.col("id").alias("ts"), F.explode(F.array(F.struct(F.lit("a").alias("name"), F.rand(6).alias("x")), F.struct(F.lit("b").alias("name"), (F.col("id") * 0 + 50.0).alias("x")))).alias("r")).select("ts", "r.*")
    assert sets.pair_correlations(pair).first()["corr"] == 0.0
