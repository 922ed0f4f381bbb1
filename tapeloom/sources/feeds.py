"""Feeds and sinks: coded JSON quotes, bars of several providers, JSONP lists, fundamentals by period, histories and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CODED = "struct<f43:long,f44:long,f45:long,f57:string,f58:string,f60:long>"


def coded_quote(body: Column) -> Column:
    """A quote whose fields have codes, prices in hundredths; null where the body does not parse."""
    q = F.from_json(body, "struct<data:" + CODED + ">")["data"]
    price = lambda c: q[c] / 100
    return F.struct(q["f57"].alias("code"), q["f58"].alias("name"), price("f43").alias("price"), price("f44").alias("high"), price("f45").alias("low"), price("f60").alias("prev_close"))


def csv_bar(line: Column) -> Column:
    """`date,open,close,high,low,volume` as a struct."""
    part = F.split(line, ",")
    number = lambda i: F.get(part, F.lit(i)).try_cast("double")
    return F.struct(F.get(part, F.lit(0)).alias("day"), number(1).alias("open"), number(2).alias("close"), number(3).alias("high"), number(4).alias("low"), number(5).alias("volume"))


def by_priority(*providers: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of several providers, of each key those of the first that has it: one union and one aggregation."""
    out = None
    for number, rows in enumerate(providers):
        one = rows.withColumn("provider", F.lit(number))
        out = one if out is None else out.unionByName(one)
    columns = [c for c in providers[0].columns if c not in keys]
    best = out.groupBy(*keys).agg(F.min_by(F.struct(*columns, "provider"), "provider").alias("b"))
    return best.select(*keys, "b.*")


def jsonp(body: Column, schema: str) -> Column:
    """The value within `name(...)`; null where there is none."""
    return F.from_json(F.regexp_extract(body, r"^\s*[\w.$]+\((.*)\)\s*;?\s*$", 1), schema)


def trends(rows: DataFrame, value: str) -> DataFrame:
    """key, period, value -> the latest of each key, the one before and how it went."""
    w = Window.partitionBy("key").orderBy("period")
    q = rows.withColumn("before", F.lag(value).over(w)).withColumn("last", F.max("period").over(Window.partitionBy("key")))
    change = F.col(value) / F.col("before") - 1
    return q.filter("period = last").select("key", "period", value, "before", F.when(change > 0.05, "up").when(change < -0.05, "down").when(change.isNotNull(), "flat").otherwise("unknown").alias("trend"))


def saved(rows: DataFrame, path: str) -> DataFrame:
    """Write as JSON lines and read back with the same schema."""
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def report(rows: DataFrame, title: Column, *lines: tuple[str, Column]) -> DataFrame:
    """A Markdown page for each row, made where the row is."""
    body = [F.concat(F.lit("# "), title)] + [F.concat(F.lit(f"- {name}: "), F.coalesce(value.cast("string"), F.lit("n/a"))) for name, value in lines]
    return rows.withColumn("page", F.concat_ws("\n", *body))
