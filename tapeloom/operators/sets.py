"""Joins and set operations as operators of their own: enrichment, defaults, intervals, pairs, semi and anti joins, recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.safe import corr_agg


def enriched(left: DataFrame, *sides: tuple[DataFrame, list[str]]) -> DataFrame:
    """Left joins one after the other; what is missing stays null."""
    for side, keys in sides:
        left = left.join(side, keys, "left")
    return left


def looked_up(rows: DataFrame, dimension: DataFrame, key: str, value: str, default: Column) -> DataFrame:
    """A dimension's value by key, or the default; the dimension is a small table of fixed size."""
    return rows.join(F.broadcast(dimension), key, "left").withColumn(value, F.coalesce(F.col(value), default))


def in_interval(rows: DataFrame, value: Column, intervals: DataFrame) -> DataFrame:
    """Rows with the interval [low, high) that their value is in; the intervals are a small table of fixed size."""
    return rows.join(F.broadcast(intervals), (value >= F.col("low")) & (value < F.col("high")), "left")


def pair_correlations(rows: DataFrame) -> DataFrame:
    """a < b of a bounded dimension (name, ts, x): how they go together. Rows by date are as many as the dimension has members, squared."""
    a, b = rows.select("ts", F.col("name").alias("a"), F.col("x").alias("xa")), rows.select("ts", F.col("name").alias("b"), F.col("x").alias("xb"))
    j = a.join(b, "ts").filter("a < b")
    return j.groupBy("a", "b").agg(F.count("*").alias("n"), corr_agg(F.col("xa"), F.col("xb")).alias("corr"))


def most_recent(rows: DataFrame, key: str, order: list[Column], size: int) -> DataFrame:
    """The last `size` rows of each key: a ring of that length."""
    return rows.withColumn("back", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("back") <= size)
