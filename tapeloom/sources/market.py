"""Canonical inputs: bars, ticks, snapshots and dimensions, and the parsers of delimited quotes and units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def resample(ticks: DataFrame, period: str, order: list[str]) -> DataFrame:
    """symbol, ts, price, volume, amount (+ outer) -> open, high, low, close and sums per period.

    order: columns that put the ticks of a symbol in one order. Aggregates map-side; one shuffle of partial bars.
    """
    at = F.struct(*order)
    return ticks.groupBy("symbol", F.date_trunc(period, "ts").alias("ts")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("volume").alias("volume"), F.round(F.sum("amount"), 2).alias("amount"), F.sum("outer_vol").alias("outer_vol"), F.count("*").alias("n"),
    )


def monthly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's line items as a symbol's monthly bars."""
    ticks = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), F.col("l_shipdate").alias("ts"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("amount"), F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0).alias("outer_vol"), "l_orderkey", "l_linenumber", "l_partkey",
    )
    return resample(ticks, "month", ["ts", "l_orderkey", "l_linenumber", "l_partkey", "amount", "volume"])


def weekly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a priority as a symbol's weekly bars."""
    ticks = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("price"), F.lit(1.0).alias("volume"), F.col("o_totalprice").alias("amount"),
        F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0).alias("outer_vol"), "o_orderkey",
    )
    return resample(ticks, "week", ["ts", "o_orderkey"])


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a type as a symbol's hourly bars."""
    ticks = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1.0).alias("volume"), F.col("value").alias("amount"), F.lit(0.0).alias("outer_vol"), "event_id")
    return resample(ticks, "hour", ["ts", "event_id"])


def industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, industry (nation), sector (region), cap (the account balance): dimensions of fixed size but for suppliers."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("s_suppkey").alias("symbol"), F.col("n_name").alias("industry"), F.col("r_name").alias("sector"), F.col("s_acctbal").alias("cap"))


def tail(bars: DataFrame, n: int) -> DataFrame:
    """Each symbol's last n bars."""
    return bars.withColumn("back", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("ts")))).filter(F.col("back") <= n)


def quote_fields(line: Column) -> Column:
    """A delimited quote `v_code="1~name~code~price~prev~open~volume~high/low/..."` as a struct; fields that don't parse are null."""
    part = F.split(F.regexp_extract(line, r'="([^"]*)"', 1), "~")
    number = lambda i: F.get(part, F.lit(i)).try_cast("double")
    return F.struct(F.get(part, F.lit(2)).alias("code"), F.get(part, F.lit(1)).alias("name"), number(3).alias("price"), number(4).alias("prev_close"), number(5).alias("open"), number(6).alias("volume"), F.get(F.split(F.get(part, F.lit(7)), "/"), F.lit(1)).try_cast("double").alias("low"))


def unit_number(said: Column) -> Column:
    """`12.3%`, `1.2亿`, `3万` and plain numbers as doubles; null if there is no number."""
    number = F.regexp_extract(said, r"(-?[0-9]+\.?[0-9]*)", 1).try_cast("double")
    return number * F.when(F.contains(said, F.lit("亿")), 1e8).when(F.contains(said, F.lit("万")), 1e4).otherwise(1.0)


def quality(bars: DataFrame) -> DataFrame:
    """Missing or zero values by symbol over the five bar fields, and a score with deductions."""
    fields = ("open", "high", "low", "close", "volume")
    missing = sum(F.count_if(F.col(c).isNull() | (F.col(c) == 0)) for c in fields)
    out = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), missing.alias("missing"), F.count_if(F.col("high") < F.col("low")).alias("crossed"))
    rate = F.col("missing") / (F.col("bars") * len(fields))
    return out.withColumn("missing_rate", F.round(rate, 6)).withColumn("score", F.lit(100) - F.when(rate > 0.05, 30).when(rate > 0.01, 10).otherwise(0) - F.when(F.col("bars") < 60, 20).otherwise(0) - F.when(F.col("crossed") > 0, 40).otherwise(0))
