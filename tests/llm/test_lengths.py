"""Packing over more lengths than a small table has."""

import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm import packing


def slow(lengths, counts, buckets):
    """Every cut tried, the shortest start first."""
    n, length, count = len(lengths), lengths.astype(float), counts.astype(float)
    docs, tokens = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * length)])
    best, cuts = np.full(n + 1, np.inf), []
    best[0] = 0
    for k in range(1, buckets + 1):
        fresh, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for j in range(k, n + 1):
            cost = best[:j] + length[j - 1] * (docs[j] - docs[:j]) - (tokens[j] - tokens[:j])
            cut[j] = np.argmin(cost)
            fresh[j] = cost[cut[j]]
        best = fresh
        cuts.append(cut)
    out, j = [], n
    for cut in cuts[::-1]:
        out.append(int(lengths[j - 1]))
        j = cut[j]
    return out[::-1]


def test_boundaries_are_those_of_the_slow_search():
    rng = np.random.default_rng(1)
    for n in (1, 2, 15, 16, 17, 60, 300):
        for most in (2, 1000):
            lengths = np.sort(rng.choice(5 * n, n, replace=False))
            counts = rng.integers(1, most, n)
            assert packing.boundaries(lengths, counts) == slow(lengths, counts, min(16, n))
    assert len(packing.boundaries(np.arange(50_000), rng.integers(1, 9, 50_000))) == 16


def test_more_than_4096_lengths_have_the_best_boundaries(spark):
    n = 5000
    lengths, counts = np.arange(1, n + 1) * 3, 1 + np.arange(n) % 3
    sized = spark.range(n).select(((F.col("id") + 1) * 3).alias("length"), F.explode(F.sequence(F.lit(0), F.col("id") % 3)).alias("k")).select((F.col("length") * 10 + F.col("k")).alias("doc_id"), "length")
    got = sorted(r.padded_length for r in packing.pack(sized).select("padded_length").distinct().collect())
    assert got == slow(lengths, counts, 16)
