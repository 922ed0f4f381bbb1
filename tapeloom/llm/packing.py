"""Packing by optimal length buckets.

A global histogram of lengths goes through dynamic programming, which chooses the bucket boundaries with the
least padding. In each bucket, documents are numbered without gaps in a seeded order, and batches hold as many
of them as the token budget allows at the bucket's padded length; only a bucket's last batch is not full.

The histogram comes to the driver with a row for each length: L different lengths take L * (L - 1) / 2 words at
least, so there are at most 100,000 of them in 5 billion words, and never more than the longest text has words.
The cost of a run fulfils the quadrangle inequality, so the best cuts are found by divide and conquer.
The numbering uses shard counts, at most MAX_SHARDS rows.

Defined results: a null or empty text has length 0, and its bucket has the least boundary; documents of equal
length are in the same bucket; repeated rows are numbered apart; a text longer than the budget is a batch of its own beyond it; an empty table gives an empty result. Columns
other than the id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.mixing import numbered, word_count
from tapeloom.llm.shared import materialise

BUCKETS = 16
BUDGET = 65_536
SHARD_DOCS = 8000
MAX_SHARDS = 65_536
SEED = 20240612


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds of at most `buckets` runs of sorted lengths, with the least sum of count * (bound - length).

    best[k][j]: least padding of the first j lengths in k runs; ties take the shortest last run's start first.
    """
    n = len(lengths)
    if not n:
        return []
    buckets = min(buckets, n)
    length, count = lengths.astype(float), counts.astype(float)
    docs, tokens = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * length)])
    cut = np.zeros((buckets + 1, n + 1), np.int64)
    best = np.full(n + 1, np.inf)
    best[0] = 0
    for k in range(1, buckets + 1):
        before, best = best, np.full(n + 1, np.inf)
        # ends of a run, the middle ones of all open ranges at once, and bounds of their starts: these never go down
        lo, hi, first, last = (np.array([x], np.int64) for x in (k, n, k - 1, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            size = np.minimum(last, j - 1) - first + 1
            begin = np.cumsum(size) - size
            i = np.arange(int(size.sum())) - np.repeat(begin - first, size)
            end = np.repeat(j, size)
            cost = before[i] + length[end - 1] * (docs[end] - docs[i]) - (tokens[end] - tokens[i])
            least = np.minimum.reduceat(cost, begin)
            at = np.flatnonzero(cost == np.repeat(least, size))
            cut[k, j] = i[at[np.searchsorted(at, begin)]]
            best[j] = least
            lo, hi, first, last = (np.concatenate(x) for x in ((lo, j + 1), (j - 1, hi), (first, cut[k, j]), (cut[k, j], last)))
            use = lo <= hi
            lo, hi, first, last = lo[use], hi[use], first[use], last[use]
    out, j = [], n
    for k in range(buckets, 0, -1):
        out.append(int(lengths[j - 1]))
        j = int(cut[k, j])
    return out[::-1]


def histogram(sized: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All lengths, in order, and their counts."""
    rows = sized.groupBy("length").agg(F.count("*").alias("n")).toPandas().sort_values("length")
    return rows["length"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)


def pack(sized: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, length -> those, bucket, padded_length, batch and slot; batch numbers are dense within a bucket."""
    spark = sized.sparkSession
    lengths, counts = histogram(sized)
    bounds = boundaries(lengths, counts, buckets)
    number = F.lit(None).cast("int")
    padded = F.lit(None).cast("long")
    for i, bound in reversed(list(enumerate(bounds))):
        number = F.when(F.col("length") <= bound, i).otherwise(number)
        padded = F.when(F.col("length") <= bound, F.lit(bound).cast("long")).otherwise(padded)
    shards = max(1, min(MAX_SHARDS // max(1, len(bounds)), -(-int(counts.sum()) // shard_docs)))
    rows = numbered(sized.select("doc_id", "length"))
    placed = rows.select("doc_id", "length", "copy", number.alias("bucket"), padded.alias("padded_length"), F.expr(f"cast(pmod(xxhash64(doc_id, length, copy, {SEED}), {shards}) as int)").alias("shard"))
    before: dict[int, int] = {}
    offsets = []
    for r in sorted(placed.groupBy("bucket", "shard").agg(F.count("*").alias("n")).collect()):
        offsets.append((r.bucket, r.shard, before.get(r.bucket, 0)))
        before[r.bucket] = before.get(r.bucket, 0) + r.n
    begin = F.broadcast(spark.createDataFrame(offsets, "bucket int, shard int, first long"))
    order = Window.partitionBy("bucket", "shard").orderBy(F.xxhash64(F.col("doc_id"), F.col("copy"), F.lit(SEED + 1)), "doc_id", "length", "copy")
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("padded_length"), F.lit(1))))
    return (
        placed.withColumn("row", F.row_number().over(order))
        .join(begin, ["bucket", "shard"])
        .withColumn("row", F.col("first") + F.col("row") - 1)
        .select("doc_id", "length", "bucket", "padded_length", F.floor(F.col("row") / per_batch).alias("batch"), (F.col("row") % per_batch).cast("int").alias("slot"))
    )


def pack_query(documents: DataFrame) -> DataFrame:
    """Every document's bucket, batch and slot; a length is a count of words."""
    return pack(materialise(documents.select("doc_id", word_count(F.col("text")).alias("length")), "pack-lengths"))
