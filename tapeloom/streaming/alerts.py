"""Alerts on event streams: stateless rules, windows with watermarks, cool-downs and latches, and their sinks.

Everything is event-time. The same functions work on batch and streaming frames; only the keyed states
(`cooldown`, `latch`) have a streaming form of their own.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
_LOCAL: list[tempfile.TemporaryDirectory] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names, or in a temporary one where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not base:
        if not _LOCAL:
            _LOCAL.append(tempfile.TemporaryDirectory(prefix="tapeloom-stream-"))
        base = "file://" + _LOCAL[0].name
    return f"{base.rstrip('/')}/tapeloom-stream/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a table of `scratch` that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def events_stream(spark: SparkSession, sf_dir: str, files_a_batch: int = 1000) -> DataFrame:
    stream = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events*.parquet").option("maxFilesPerTrigger", files_a_batch).parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def alerts(events: DataFrame) -> DataFrame:
    """A row for each rule that an event meets."""
    rule = lambda cond, kind, severity: F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(severity).alias("severity")))
    v = F.col("value")
    met = F.array_compact(F.array(rule(v > 50, "large", "high"), rule((v > 30) & (v <= 50), "large", "medium"), rule(v < 1, "tiny", "low"), rule((F.col("event_type") == "error") & (v > 20), "error", "high")))
    return events.select("event_id", "ts", "event_type", "user_id", F.explode(met).alias("a")).select("event_id", "ts", "event_type", "user_id", "a.kind", "a.severity")


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", length, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def routed(alert_rows: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Alerts of subscribed users only: a stream-static semi join."""
    return alert_rows.join(subscriptions, "user_id", "left_semi")


def cooldown(alert_rows: DataFrame, seconds: int = 3600) -> DataFrame:
    """A key's alerts fire only so long after its last one that fired; the last firing time is the key's state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        fired = []
        for r in rows.itertuples():
            at = r.ts.value // 1000
            if last is None or at - last >= seconds * 1_000_000:
                last = at
                fired.append((r.event_id, r.ts, key[0]))
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(fired, columns=["event_id", "ts", "event_type"])

    return alert_rows.groupBy("event_type").applyInPandasWithState(run, "event_id long, ts timestamp, event_type string", "last long", "append", GroupStateTimeout.NoTimeout)


def throttled(requests: DataFrame, seconds: int = 10, late: str = "10 minutes") -> DataFrame:
    """event_id, ts, user_id, value -> what each request is served: its own value if its key was last fetched so long ago, and then that is a fetch; else the last fetched one.

    A stream's key holds its last fetch until the watermark has passed the time for which that is served; a request after that is a fetch in any case,
    so results don't depend on when states go, and there are as many as keys asked for of late. A request that comes in a later batch with an earlier time is served the
    last value. A key's requests of one batch are sorted together. Rows without a time or a key take no part.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, value = state.get if state.exists else (None, None)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        fetched, served = [], []
        for at, own in zip((rows.ts.astype("datetime64[us]").astype("int64")).tolist(), rows.value.tolist(), strict=True):
            fetched.append(last is None or at - last >= seconds * 1_000_000)
            if fetched[-1]:
                last, value = at, own
            served.append(value)
        state.update((last, value))
        # a timer must be ahead of the watermark
        state.setTimeoutTimestamp(max(last // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"event_id": rows.event_id, "ts": rows.ts, "user_id": key[0], "fetched": fetched, "served": served})

    known = requests.select("event_id", "ts", "user_id", "value").filter("ts IS NOT NULL AND user_id IS NOT NULL").withWatermark("ts", late)
    return known.groupBy("user_id").applyInPandasWithState(run, "event_id long, ts timestamp, user_id long, fetched boolean, served double", "last long, value double", "append", GroupStateTimeout.EventTimeTimeout)


def latch(events: DataFrame, level: float = 40.0) -> DataFrame:
    """One event above the level for each user, the first that the stream brings; the state is a row for each user that fired."""
    return events.filter(F.col("value") > level).dropDuplicates(["user_id"]).select("user_id", "event_id")


def to_table(stream: DataFrame, name: str) -> DataFrame:
    """Run the stream over what there is and read its sink: parquet files, appended once for each batch."""
    spark = stream.sparkSession
    path = scratch(spark, name)
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def insert(alert_rows: DataFrame, path: str) -> None:
    """Append alerts, one or many, to a table."""
    alert_rows.write.mode("append").parquet(path)


def technical(prices: DataFrame, history: DataFrame) -> DataFrame:
    """event_id, symbol, price against a symbol's rsi, hi and lo: a row for each rule that is met. Works on batch and stream."""
    rule = lambda cond, kind: F.when(cond, kind)
    met = F.array_compact(F.array(rule(F.col("rsi") > 70, "overbought"), rule(F.col("rsi") < 30, "oversold"), rule(F.col("price") > F.col("hi") * 1.005, "breakout"), rule(F.col("price") < F.col("lo") * 0.995, "breakdown")))
    return prices.join(history, "symbol").select("event_id", F.explode(met).alias("kind"))


def recent(alert_rows: DataFrame, n: int = 100) -> DataFrame:
    """The newest n alerts: a top-k report."""
    return alert_rows.orderBy(F.desc("ts"), F.desc("event_id"), "kind").limit(n)


def retained(alert_rows: DataFrame, days: int = 7) -> DataFrame:
    """Alerts of the last days before the newest one."""
    newest = alert_rows.agg(F.max("ts").alias("newest"))
    return alert_rows.crossJoin(F.broadcast(newest)).filter(F.col("ts") >= F.col("newest") - F.expr(f"interval {days} days")).drop("newest")


def insert_dated(alert_rows: DataFrame, path: str) -> None:
    """Append alerts to a table with a folder for each day."""
    alert_rows.withColumn("day", F.to_date("ts")).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def drop_old(spark: SparkSession, path: str, days: int = 7) -> list[str]:
    """Deletes what is older than `days` before the newest alert from a table of `insert_dated`; the days that went, oldest first.

    Whole days go as folders. The one day that the bound cuts is written aside and then put in place of itself by dynamic overwrite;
    the files of all later days, and of alerts without a time, are not touched. A table without alerts stays as it is.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    # a name for each day
    names = sorted(s.getPath().getName() for s in files.listStatus(folder) if s.isDirectory())
    dated = [n for n in names if n.startswith("day=") and not n.endswith("__")]
    if not dated:
        return []
    table = spark.read.option("basePath", path)
    oldest = table.parquet(f"{path}/{dated[-1]}").agg((F.max("ts") - F.expr(f"interval {days} days")).alias("oldest")).select(F.col("oldest").cast("string").alias("at"), F.to_date("oldest").cast("string").alias("day")).first()
    gone = [n[4:] for n in dated if n[4:] < oldest.day]
    if f"day={oldest.day}" in dated:
        aside = scratch(spark, "retained-day")
        cut = table.parquet(f"{path}/day={oldest.day}")
        young = F.col("ts") >= F.lit(oldest.at).cast(cut.schema["ts"].dataType)
        if cut.filter(~young).limit(1).count():
            cut.filter(young).write.parquet(aside)
            spark.read.schema(cut.schema).parquet(aside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
            if not spark.read.schema(cut.schema).parquet(aside).limit(1).count():
                gone.append(oldest.day)
            discard(spark, aside)
    for day in gone:
        discard(spark, f"{path}/day={day}")
    return gone
