"""Streaming queries, run over what there is, and the batch SQL that they have to agree with."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.plans.registry import query
from tapeloom.plans.series import RECURSIVE
from tapeloom.sources import market as m
from tapeloom.streaming import alerts as s

ALERTS = """a AS (SELECT event_id, ts, event_type, user_id, 'large' AS kind, CASE WHEN value > 50 THEN 'high' ELSE 'medium' END AS severity FROM events WHERE value > 30
UNION ALL SELECT event_id, ts, event_type, user_id, 'tiny', 'low' FROM events WHERE value < 1 UNION ALL SELECT event_id, ts, event_type, user_id, 'error', 'high' FROM events WHERE event_type = 'error' AND value > 20)"""


def plain(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")) if "ts" in df.columns else df


@query("st02_stream_alerts", f"WITH {ALERTS} SELECT * FROM a")
def st02(spark, d):
    return plain(s.to_table(s.alerts(s.events_stream(spark, d)), "alerts"))


@query("st07_stream_windows", """SELECT w AS start, w + INTERVAL 1 HOUR AS "end", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w FROM events) WHERE w + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1, 2, 3""")
def st07(spark, d):
    out = s.to_table(s.windowed_counts(s.events_stream(spark, d)), "windows")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("st05_stream_cooldown", """WITH RECURSIVE q AS (SELECT event_type, event_id, ts, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE value > 30), f AS (SELECT event_type, event_id, i, ts AS fired, TRUE AS fires FROM q WHERE i = 1 UNION ALL SELECT q.event_type, q.event_id, q.i, CASE WHEN epoch_us(q.ts) - epoch_us(f.fired) >= 3600000000 THEN q.ts ELSE f.fired END, epoch_us(q.ts) - epoch_us(f.fired) >= 3600000000 FROM f JOIN q ON q.event_type = f.event_type AND q.i = f.i + 1) SELECT event_id, fired AS ts, event_type FROM f WHERE fires""")
def st05(spark, d):
    return plain(s.to_table(s.cooldown(s.alerts(s.events_stream(spark, d)).filter("kind = 'large'"), 3600), "cooldown"))


@query("st09_stream_routing", f"WITH {ALERTS} SELECT user_id, count(*) AS n FROM a WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1")
def st09(spark, d):
    who = m.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return s.to_table(s.routed(s.alerts(s.events_stream(spark, d)), who), "routed").groupBy("user_id").agg(F.count("*").alias("n"))


@query("st06_stream_latch", "SELECT DISTINCT user_id FROM events WHERE value > 40")
def st06(spark, d):
    return s.to_table(s.latch(s.events_stream(spark, d)), "latch").select("user_id")


@query("s16_recent_alerts", f"WITH {ALERTS} SELECT event_id, ts, kind, severity FROM a ORDER BY ts DESC, event_id DESC, kind LIMIT 100")
def s16(spark, d):
    return s.recent(s.alerts(m.table(spark, d, "events"))).select("event_id", "ts", "kind", "severity")


@query("s17_retained_alerts", f"WITH {ALERTS} SELECT event_id, kind FROM a WHERE ts >= (SELECT max(ts) FROM a) - INTERVAL 7 DAY")
def s17(spark, d):
    return s.retained(s.alerts(m.table(spark, d, "events"))).select("event_id", "kind")


@query("s17_dropped_alerts", f"WITH {ALERTS} SELECT event_id, kind FROM a WHERE ts >= (SELECT max(ts) FROM a) - INTERVAL 7 DAY")
def s17_dropped(spark, d):
    """All alerts go to a table by day, of which the old ones are dropped."""
    path = s.scratch(spark, "dated-alerts")
    s.insert_dated(s.alerts(m.table(spark, d, "events")), path)
    s.drop_old(spark, path, 7)
    return spark.read.parquet(path).select("event_id", "kind")


@query("st08_stream_throttle", RECURSIVE.format(bars="e AS (SELECT user_id, user_id AS symbol, row(ts, event_id) AS ts, event_id, ts AS moment, value FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL)", source="e", first="event_id, moment AS last, value AS served, true AS fetched", step="b.event_id, CASE WHEN b.moment - f.last >= INTERVAL 3600 SECOND THEN b.moment ELSE f.last END, CASE WHEN b.moment - f.last >= INTERVAL 3600 SECOND THEN b.value ELSE f.served END, b.moment - f.last >= INTERVAL 3600 SECOND").replace(" b AS (", " b AS MATERIALIZED (") + " SELECT symbol AS user_id, event_id, fetched, round(served, 6) AS served FROM f")
def st08(spark, d):
    """What each request for a user's value is served when a fetched one is good for an hour."""
    return s.to_table(s.throttled(s.events_stream(spark, d), 3600), "throttle").select("user_id", "event_id", "fetched", F.round("served", 6).alias("served"))
