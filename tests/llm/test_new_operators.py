"""Resharding, ranked search and centroids against plain versions, and their SQL on the smallest tables."""

import functools
import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from samples import words
from pyspark.sql import functions as F

from tapeloom.llm import maxsketch, queries, reshard, vafile
from tapeloom.llm.shared import Workspace, fresh_path

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), con.sql(queries.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert sorted(map(tuple, got[columns].values.tolist())) == sorted(map(tuple, want[columns].values.tolist()))


# resharding


def test_flow_is_of_least_cost():
    rng = np.random.default_rng(3)
    for _ in range(120):
        n, m = rng.integers(1, 5, 2)
        sizes = rng.integers(0, 6, n)
        room = np.bincount(rng.integers(0, m, sizes.sum()), minlength=m)
        cost = rng.integers(0, 9, (n, m))
        flow = reshard.transfers(sizes, room, cost)
        units = [i for i in range(n) for _ in range(sizes[i])]

        @functools.cache
        def best(k, room):
            return 0 if k == len(units) else min(cost[units[k], j] + best(k + 1, room[:j] + (room[j] - 1,) + room[j + 1 :]) for j in range(m) if room[j])  # noqa: B023

        assert (flow >= 0).all() and (flow.sum(1) == sizes).all() and (flow.sum(0) == room).all()
        assert (flow * cost).sum() == best(0, tuple(room.tolist()))


def test_default_flow_moves_the_excess_only():
    rng = np.random.default_rng(4)
    for _ in range(50):
        sizes = rng.integers(0, 1000, 30)
        room = np.array(reshard.capacities_for(sizes, [1.0] * 30, [0] * 30))
        flow = reshard.transfers(sizes, room)
        assert flow.sum() - np.trace(flow) == np.maximum(sizes - room, 0).sum() and np.ptp(room) <= 1


def test_capacity_of_a_large_document():
    assert reshard.capacities_for([100, 0, 0], [1, 1, 1], [80, 0, 0]) == [80, 10, 10]
    assert reshard.capacities_for([10, 11, 0], [1, 1, 1], [0, 0, 0]) == [7, 7, 7]
    assert reshard.capacities_for([0, 0], [1, 1], [0, 0]) == [0, 0]


def test_pieces_cover_the_blocks():
    blocks = [reshard.Block(0, "0-0", 10, 3), reshard.Block(0, "0-1", 10, 3), reshard.Block(1, "1-0", 4, 4)]
    pieces = reshard.pieces_of(blocks, np.array([[8, 12], [0, 4]]))
    assert pieces == [reshard.Piece(0, "0-0", 0, 8, 0), reshard.Piece(0, "0-0", 8, 10, 1), reshard.Piece(0, "0-1", 0, 10, 1), reshard.Piece(1, "1-0", 0, 4, 1)]


def placed(docs, shards):
    out = reshard.reshard_query(docs, shards).toPandas()
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert set(out.law) <= {"bytes"} and out.grown_shard.isna().all()
    return out


def test_edge_documents_have_a_shard(spark, edge_docs, no_docs):
    out = placed(edge_docs, 5)
    want = Counter((r.doc_id if r.doc_id is not None else -1, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in edge_docs.collect())
    assert Counter(zip(out.doc_id.fillna(-1).astype(int), out["size"], out.text_crc32, strict=True)) == want
    assert reshard.reshard_query(no_docs).collect() == []


def test_hot_groups_are_levelled(spark):
    """Half of the rows have one text, a sixth are one row repeated and a sixth have no id."""
    rng = random.Random(8)
    copies = words(rng, 40)
    rows = [(i, copies if i % 2 else words(rng, rng.randint(1, 60))) for i in range(4000)] + [(7, "again and again")] * 1000 + [(None, words(rng, 5)) for _ in range(1000)]
    out = placed(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 24)
    size = out.groupby("shard")["size"].sum()
    assert len(out) == 6000 and len(size) == 24 and np.ptp(size) <= 0.02 * size.mean()


def test_only_affected_files_are_rewritten(spark):
    rng = random.Random(9)
    docs = spark.createDataFrame([(i, words(rng, 12), "x") for i in range(3000)], "doc_id long, text string, shard string")
    with Workspace(spark) as space:
        folder, schema = fresh_path(spark, "layout"), reshard.layout_schema(docs)
        space.paths.append(folder)
        reshard.lay_out(docs, folder, space, 4, block_rows=50)
        place = Path(folder.removeprefix("file://"))
        before = {p: p.stat().st_mtime_ns for p in place.rglob("*.parquet")}
        sizes = Counter()
        for b in reshard.measured(reshard.opened(spark, folder, schema)):
            sizes[b.shard] += b.bytes
        moved, blocks = reshard.reshard(spark, folder, schema, [2.0, 1.0, 1.0, 1.0, 0.5])
        after = {p: p.stat().st_mtime_ns for p in place.rglob("*.parquet")}
        same = [p for p in before if after.get(p) == before[p]]
        assert moved > 0 and 0 < blocks < 40 and len(same) == len(before) - blocks
        now = reshard.opened(spark, folder, schema)
        assert now.select("doc_id", "text", "shard").exceptAll(docs).count() == 0 and now.count() == 3000
        got = {r.layout_shard: r.n for r in now.groupBy("layout_shard").agg(F.sum("layout_bytes").alias("n")).collect()}
        for shard, weight in enumerate([2.0, 1.0, 1.0, 1.0, 0.5]):
            assert got[shard] == pytest.approx(sum(sizes.values()) * weight / 5.5, rel=0.02)


# ranked search


def by_force(docs, items, k=50):
    split = lambda t: TERM.findall((t or "").translate(LOWER))
    bags = [(d, Counter(split(t))) for d, t in docs]
    n = sum(1 for _, b in bags if b)
    length = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for d, b in bags:
            m = 50 + 50 * sum(b.values()) * n // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 20 * m)) for t in set(split(text)) if b[t])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scores)[:k])]
    return out


def found(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_search_is_exact(spark, edge_docs, no_docs):
    rng = random.Random(2)
    docs = [(r.doc_id, r.text) for r in edge_docs.collect()]
    docs += [(100 + i, words(rng, rng.randint(1, 90))) for i in range(400)] + [(600 + i, docs[0][1]) for i in range(70)] + [(5000, "die " * 40_000 + words(rng, 3000))]
    items = [(i, words(rng, rng.randint(1, 40))) for i in range(12)] + [(3, docs[0][1]), (3, docs[0][1]), (None, "É ü 漢字 token"), (90, None), (91, ""), (92, "?!"), (93, "nowhere-to-be-found"), (94, "die")]
    frame = spark.createDataFrame([(*d, 0.5) for d in docs], "doc_id long, text string, score double").repartition(7)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, rank int")
    assert found(maxsketch.search(frame, asked)) == sorted(by_force(docs, items), key=str)
    assert found(maxsketch.search(frame, asked, 3)) == sorted(by_force(docs, items, 3), key=str)
    assert maxsketch.search(no_docs, asked).collect() == [] and maxsketch.search(frame, asked.limit(0)).collect() == []


def test_bounds_are_never_below_scores():
    rng = random.Random(6)
    texts = [words(rng, rng.randint(0, 400)) for _ in range(200)] + ["the " * 1000, "", None]
    known = maxsketch.queries([words(rng, 30) for _ in range(20)])
    for _, hi, rows, hashes in maxsketch.terms(pa.array(texts)):
        lengths = np.bincount(rows, minlength=hi)
    from dataclasses import replace

    known = replace(known, weights=np.full(len(known.hashes), 1000), documents=202, length=int(lengths.sum()))
    data, offsets = maxsketch.sketches(rows, hashes, len(texts))
    score = maxsketch.exact(known, pa.array(texts), lengths)
    seen, over = set(), []
    for part, bound in maxsketch.bounds(known, data, offsets, lengths):
        seen |= set(part.tolist())
        assert (bound >= score[part]).all()
        over.append((bound - score[part]).sum() / max(bound.sum(), 1))
    assert seen == {i for i, t in enumerate(texts) if t}
    assert max(over) < 0.2


# centroids


def plain_clusters(rows, count=16, rounds=3, dims=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, hashlib.sha256(f"1:{kept[k][0]}".encode()).hexdigest(), kept[k][1]))
    middle = [kept[k][1] for k in order[:count]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for last in range(rounds + 1):
        near = [min((gap(v, c), k) for k, c in enumerate(middle)) for _, v in kept]
        if last == rounds:
            break
        for k in range(len(middle)):
            own = [v for (_, v), (_, at) in zip(kept, near, strict=True) if at == k]
            middle[k] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else middle[k]
    inertia = Counter()
    for d, k in near:
        inertia[k] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in middle]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), name[k]) for (i, _), (d, k) in zip(kept, near, strict=True)), key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_clusters_are_exact(spark, kind):
    rng = random.Random(1)
    around = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    near = lambda: [float(np.float32(x + rng.gauss(0, 0.4))) for x in rng.choice(around)]
    rows = [(i, near()) for i in range(300)]
    rows += [(7, near()), (7, rows[7][1]), (None, near()), (None, near()), (400, None), (401, []), (402, [0.5] * 63), (403, [0.5] * 65), (404, [None] + [0.1] * 63)]
    rows += [(405, [math.nan] * 64), (406, [math.inf] + [0.0] * 63), (407, [0.0] * 64), (408, [-1e4] * 64), (409, [1e4] * 64)] + [(500 + i, rows[0][1]) for i in range(150)]
    frame = spark.createDataFrame([(*r, 3, "x") for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, row string").repartition(5)
    got = vafile.cluster(frame).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_clusters(rows)
    assert vafile.cluster(frame.limit(0)).collect() == []
    few = frame.filter("vec_id in (1, 2, 407)")
    assert sorted((tuple(r) for r in vafile.cluster(few).collect()), key=str) == plain_clusters([r for r in rows if r[0] in (1, 2, 407)])


def test_a_component_that_does_not_fit_raises(spark):
    frame = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond"):
        vafile.cluster(frame).collect()


def test_intervals_hold_the_distances_and_leave_few_open():
    rng = np.random.default_rng(7)
    around = rng.normal(0, 8, (10, 64))
    v = np.floor(around[rng.integers(0, 10, 3000)] + rng.normal(0, 3, (3000, 64))).astype(np.int64)
    v[0] = 100
    stats = np.stack([np.full(64, len(v)), v.sum(0), (v.astype(float) ** 2).sum(0), v.min(0), v.max(0)], 1)
    first, last = vafile.edges(stats)
    cells = vafile.approximate(v, first)
    j = np.arange(64)
    assert (first[j, cells] <= v).all() and (v <= last[j, cells]).all() and cells.max() < vafile.CELLS
    centroids = v[:16]
    low, high = vafile.intervals(cells, *vafile.tables(centroids, first, last))
    distance = ((v[:, None] - centroids) ** 2).sum(2)
    assert (low <= distance).all() and (distance <= high).all()
    assert (low <= high.min(1)[:, None]).sum(1).mean() < 4  # of 16 centroids


def test_intermediate_tables_go(spark, edge_docs):
    from tapeloom.llm.shared import shared_dir

    place = Path(shared_dir(spark).removeprefix("file://"), "tapeloom")
    before = set(place.iterdir()) if place.exists() else set()
    maxsketch.search(edge_docs, edge_docs.select(F.col("doc_id").alias("item_id"), "text")).count()
    assert [p.name.rpartition("-")[0] for p in set(place.iterdir()) - before] == ["search-result"]
