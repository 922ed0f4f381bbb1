"""Tables by day that lose their old ones, and throttled requests against a plain loop."""

import datetime as dt
from pathlib import Path

import numpy as np
import pytest

from tapeloom.streaming import alerts

ALERT = "event_id long, ts timestamp, kind string"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


def test_old_days_go_and_others_stay(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = [(d * 100 + h, at(d, h), "k") for d in range(1, 13) for h in (1, 13, 23)] + [(9999, None, "k")]
    alerts.insert_dated(spark.createDataFrame(rows, ALERT), path)
    before = {p: p.stat().st_mtime_ns for p in Path(path).glob("day=*/*.parquet")}
    # the newest is of the 12th at 23: the 5th loses two of three
    assert alerts.drop_old(spark, path, 7) == [f"2024-01-0{d}" for d in range(1, 5)]
    left = spark.read.parquet(path)
    assert sorted(r.event_id for r in left.collect()) == [523] + [d * 100 + h for d in range(6, 13) for h in (1, 13, 23)] + [9999]
    after = {p: p.stat().st_mtime_ns for p in Path(path).glob("day=*/*.parquet")}
    touched = {p.parent.name for p in before.keys() ^ after.keys()}
    assert touched == {f"day=2024-01-0{d}" for d in range(1, 6)} and all(before[p] == after[p] for p in before.keys() & after.keys())
    assert alerts.drop_old(spark, path, 7) == []
    assert alerts.drop_old(spark, path, 0) and [r.event_id for r in spark.read.parquet(path).orderBy("event_id").collect()] == [1223, 9999]


def test_empty_table_stays(spark, tmp_path):
    path = str(tmp_path / "empty")
    alerts.insert_dated(spark.createDataFrame([(1, None, "k")], ALERT), path)
    assert alerts.drop_old(spark, path) == [] and spark.read.parquet(path).count() == 1


def plain(rows, seconds):
    last, out = {}, {}
    for e, t, u, v in sorted((r for r in rows if r[1] and r[2] is not None), key=lambda r: (r[1], r[0])):
        fetch = u not in last or (t - last[u][0]).total_seconds() >= seconds
        if fetch:
            last[u] = (t, v)
        out[e] = (u, fetch, last[u][1])
    return out


@pytest.mark.parametrize("files", [1, 6])
def test_throttle_against_a_loop(spark, tmp_path, files):
    rng = np.random.default_rng(files)
    rows = [(i, at(1) + dt.timedelta(seconds=int(s)), int(rng.integers(0, 5)), float(i)) for i, s in enumerate(np.sort(rng.integers(0, 40_000, 600)))] + [(900, None, 1, 1.0), (901, at(1), None, 1.0)]
    schema = "event_id long, ts timestamp, user_id long, value double"
    # in order of time over files, a batch each
    for f in range(files):
        part = rows[f * len(rows) // files : (f + 1) * len(rows) // files]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.event_id: (r.user_id, r.fetched, r.served) for r in alerts.to_table(alerts.throttled(stream, 300, "0 seconds"), "throttle-test").collect()}
    assert got == plain(rows, 300)
