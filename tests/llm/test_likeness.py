"""Near-duplicates by likeness against brute force."""

import random

import numpy as np
import pyarrow as pa
from samples import words

from tapeloom.llm import golay


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return 5 * len(a & b) >= 4 * len(a | b)


def grouped(spark, texts):
    return {r.doc_id: r.component_id for r in golay.like_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()}


def plain_groups(texts):
    label = list(range(len(texts)))
    near = [[j for j in range(len(texts)) if alike(texts[i], texts[j])] for i in range(len(texts))]
    while True:
        fresh = [min(label[j] for j in near[i]) for i in range(len(texts))]
        if fresh == label:
            return dict(enumerate(label))
        label = fresh


def other(rng, i):
    return f"w{rng.randrange(1 << 40)}x{i}"


def test_a_text_between_two_copies_does_not_part_them(spark):
    """A shares passages with B and C but is alike to neither; B and C are alike, and stay linked whichever comes first."""
    rng = random.Random(4)
    texts = []
    for i in range(30):
        b = [other(rng, i) for _ in range(200)]
        c = b[:195] + [other(rng, i) for _ in range(5)]
        for n in (1, 2, 3, 4):
            texts.append(" ".join(b[: 200 - 12 * n] + [other(rng, i) for _ in range(12 * n)]))
            texts.append(" ".join([other(rng, i) for _ in range(40 + n)] + b[40 + n :]))
        texts += [" ".join(b), " ".join(c)]
    assert grouped(spark, texts) == plain_groups(texts)
    # the same in a key's task: what may be alike joins the cluster, and only what holds is thinned
    sets = [[1, 2, 3, 4, 5, 6, 7, 8, 9], [11, 12, 13, 14, 15, 6, 7, 8, 9, 10], [1, 2, 3, 4, 5, 6, 7, 8, 9, 10]]
    i, j = golay._alike(np.array(sum(sets, []), np.uint64), np.array([9, 10, 10]))
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 2)]


def test_crowded_keys_and_clusters_meet_in_all_blocks(spark, monkeypatch):
    """Many texts of one key, and clusters of more shingles than a block holds: no link is lost between blocks."""
    monkeypatch.setattr(golay, "MANY", 40)
    monkeypatch.setattr(golay, "CROWD", 2000)
    rng = random.Random(6)
    texts = []
    for i in range(3):
        base = [other(rng, i) for _ in range(100)]
        # copies of two halves that are alike within each, and not across
        for half in range(2):
            start = base[: 60 + 10 * half] + [other(rng, i) for _ in range(40 - 10 * half)]
            for _ in range(40):
                texts.append(" ".join(start[:97] + [other(rng, i) for _ in range(3)]))
    rng.shuffle(texts)
    assert grouped(spark, texts) == plain_groups(texts)


def test_every_pair_of_blocks_of_a_key_meets():
    n = np.full(50, 4)
    row, deal = golay._in_blocks(np.zeros(50, np.int64), np.arange(50, dtype=np.uint64), n)
    met = {(a, b) for d in set(deal.tolist()) for a in row[deal == d].tolist() for b in row[deal == d].tolist()}
    assert met == {(a, b) for a in range(50) for b in range(50)} and max(np.bincount(np.unique(deal, return_inverse=True)[1])) < 50


def test_a_key_that_fills_batches_is_held_whole():
    """Rows of one key over several Arrow batches: each is linked, also where the last row of a batch is like none."""
    import pyarrow as pa

    rng = np.random.default_rng(2)
    same = rng.integers(0, 1 << 63, golay.SKETCH, dtype=np.int64)
    size = golay.MANY + 10
    rows = np.tile(same, (2 * size, 1))
    rows[size - 1] = ~same
    names = ["deal", "node", *(f"s{k}" for k in range(golay.SKETCH))]
    batch = lambda lo: pa.RecordBatch.from_arrays([pa.array(np.zeros(size, np.int64)), pa.array(np.arange(lo, lo + size)), *(pa.array(c) for c in np.ascontiguousarray(rows[lo : lo + size].T))], names=names)
    pairs = [(a, b) for out in golay._like_pairs(iter([batch(0), batch(size)])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True)]
    assert {x for pair in pairs for x in pair} == set(range(2 * size)) - {size - 1} and len(pairs) == 2 * size - 2


def test_recall_and_precision_about_four_fifths(spark):
    """Pairs of 0.80 to 0.85, and of just below 0.8: those are grouped, these are not."""
    rng = random.Random(8)
    texts = []
    for i in range(400):
        a = words(rng, 300).split() if i % 2 else [other(rng, i) for _ in range(300)]
        edits = rng.randint(24, 42)
        texts += [" ".join(a), " ".join(a[: len(a) - edits] + [other(rng, i) for _ in range(edits)])]
    exact = [len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b)) for a, b in zip(texts[::2], texts[1::2], strict=True)]
    assert sum(0.8 <= x < 0.85 for x in exact) > 100 and sum(0.75 <= x < 0.8 for x in exact) > 100
    got = grouped(spark, texts)
    assert [got[2 * i] == got[2 * i + 1] for i in range(400)] == [x >= 0.8 for x in exact]


def test_rows_of_one_id_and_of_none_do_not_multiply(spark):
    """100,000 rows of one id with different texts, as many without an id, and copies among both: no key gathers the product."""
    from pyspark.sql import functions as F

    base = spark.range(100_000).select(F.expr("array_join(transform(sequence(1, 8), i -> sha2(concat(cast(id % 60000 AS STRING), '-', cast(i AS STRING)), 224)), ' ')").alias("text"))
    docs = base.select(F.lit(7).cast("long").alias("doc_id"), "text").union(base.select(F.lit(None).cast("long"), "text"))
    docs = docs.union(base.limit(500).select(F.lit(3).cast("long"), "text"))
    seen = golay.like_groups(docs)
    assert seen.count() == 200_500
    kept = golay.without_copies(docs).groupBy("doc_id").count().collect()
    assert sorted((r.doc_id or 0, r["count"]) for r in kept) == [(0, 100_000), (3, 1)] or sorted((r.doc_id or 0, r["count"]) for r in kept) == [(0, 100_000), (3, 1), (7, 1)]


def test_the_row_of_an_id_is_the_same_in_each_run(spark):
    rows = [(1, f"text {i} of the first id, with enough words to be told apart {i}", i) for i in range(40)]
    runs = {tuple(golay.without_copies(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(n, "n")).collect()) for n in (1, 3, 7)}
    assert len(runs) == 1


def test_golay_keys_find_what_least_hashes_leave(spark, monkeypatch):
    """With no pair by least hashes, texts within 3 bits are still grouped, by Golay keys, and held against each other by their shingles."""
    monkeypatch.setattr(golay, "_like_pairs", lambda batches: iter(()))
    rng = random.Random(9)
    texts = []
    for i in range(40):
        a = [other(rng, i) for _ in range(2000)]
        texts += [" ".join(a), " ".join([*a[:-1], other(rng, i)])]
    prints = [int(golay.majority(*next(golay._sets(pa.array([t])))[:2])[0]) for t in texts]
    bits = [(x ^ y).bit_count() for x, y in zip(prints[::2], prints[1::2], strict=True)]
    assert sum(b <= 3 for b in bits) > 30
    got = grouped(spark, texts)
    assert all(got[2 * i] == got[2 * i + 1] == 2 * i for i, b in enumerate(bits) if b <= 3)
    # equal prints of different sets are connected, and so are prints 3 bits apart, but not 4
    nodes = spark.createDataFrame([(1, 0), (2, 0), (3, 7), (4, 0x78), (5, 0xF << 40)], "node long, print long")
    assert sorted(tuple(sorted(r)) for r in golay.golay_pairs(nodes).collect()) == [(1, 2), (1, 3)]
