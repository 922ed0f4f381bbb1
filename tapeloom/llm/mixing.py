"""Mixing sources to target weights by Sainte-Lague apportionment.

The words to take are cut into equal blocks, and the blocks go to the sources by highest quotients
target / (2 q + 1). A source's blocks go to its shards the same way, by shard size, which gives each shard an
integer quota. A shard lays its documents out in a seeded order and takes whole passes first and then blocks
of the layout in a seeded order, until its quota is met.

Only per-source and per-shard totals come to the driver: at most MAX_SOURCES and MAX_SHARDS rows.

Defined results: a null text has size 0 and takes nothing; null is a source of its own, the last; a source
without words has target 0; repeated rows are taken apart from each other, in a fixed order; an empty table
gives an empty result. Columns other than the id, text and source are ignored, or passed on as they are by
`mixed_documents`.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.shared import materialise

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2
BLOCK = 8
SEED = 20240611
SHARD_DOCS = 2000
MAX_SHARDS = 65_536
MAX_SOURCES = 1_000_000

WORDS = r"[^ \t-\r]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> np.ndarray:
    """Each source's words by weight; what is above cap times its size is shared again among the others."""
    size = np.asarray(sizes, float)
    weight = np.resize(np.asarray(weights, float), len(size))
    most, out, open_ = cap * size, np.zeros(len(size)), np.ones(len(size), bool)
    left = share * size.sum()
    while open_.any():
        given = left * weight / weight[open_].sum()
        full = open_ & (given > most)
        if not full.any():
            out[open_] = given[open_]
            break
        out[full] = most[full]
        left -= most[full].sum()
        open_ &= ~full
    return np.minimum(out, most)


def sainte_lague(weights: Sequence[float], seats: int, most: Sequence[int] | None = None) -> np.ndarray:
    """Seats by highest quotients weight / (2 q + 1), with an upper bound for each; ties go to the first.

    It begins with the whole shares and then awards or takes back single seats, which ends in the same house as
    awarding them one by one.
    """
    w = np.asarray(weights, float)
    top = np.full(len(w), np.iinfo(np.int64).max) if most is None else np.asarray(most, np.int64)
    seats = int(min(seats, top.sum() if most is not None else seats))
    if not len(w) or w.sum() <= 0 or seats <= 0:
        return np.zeros(len(w), np.int64)
    q = np.minimum(np.floor(w / w.sum() * seats).astype(np.int64), top)
    up = [(-w[i] / (2 * q[i] + 1), i) for i in range(len(w)) if q[i] < top[i] and w[i] > 0]
    heapq.heapify(up)

    def award() -> None:
        _, i = heapq.heappop(up)
        q[i] += 1
        if q[i] < top[i]:
            heapq.heappush(up, (-w[i] / (2 * q[i] + 1), i))

    left = seats - int(q.sum())
    while left > 0 and up:
        award()
        left -= 1
    while up:
        held = np.where(q > 0, w / np.maximum(2 * q - 1, 1), np.inf)
        worst = len(w) - 1 - int(np.argmin(held[::-1]))
        if -up[0][0] <= held[worst]:
            break
        q[worst] -= 1
        award()
        up = [(-w[i] / (2 * q[i] + 1), i) for i in range(len(w)) if q[i] < top[i] and w[i] > 0]
        heapq.heapify(up)
    return q


def numbered(rows: DataFrame, chunk: int = 4096) -> DataFrame:
    """The rows with a column `copy`: 0 to n - 1 for n equal rows.

    Equal rows are counted map-side and written out again, so that however many there are of one kind (rows without an
    id, say) they can be dealt by their number.
    """
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    chunks = counted.withColumn("chunk", F.explode(F.expr(f"sequence(0L, (copies - 1) div {chunk})")))
    each = chunks.withColumn("copy", F.explode(F.expr(f"sequence(chunk * {chunk}, least(copies, (chunk + 1) * {chunk}) - 1)")))
    return each.select(*rows.columns, "copy")


def _plan(sized: DataFrame, weights, share, cap, block, shard_docs) -> tuple[DataFrame, DataFrame]:
    """Documents with their source's number and shard, and the quota in words of each shard."""
    spark = sized.sparkSession
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources: raise MAX_SOURCES if the driver has room for them")
    totals = sorted(totals, key=lambda r: (r.source is None, r.source or ""))
    want = targets([r["size"] for r in totals], weights, share, cap)
    rows = sum(r.n for r in totals)
    shards = [max(1, min(-(-r.n // shard_docs), MAX_SHARDS * r.n // max(rows, 1))) for r in totals]
    seats = sainte_lague(want, round(want.sum() / block), [-(-cap * r["size"] // block) for r in totals])
    table = [(r.source, i, r["size"], float(want[i]), shards[i]) for i, r in enumerate(totals)]
    sources = spark.createDataFrame(table, "source string, source_no int, source_size long, target double, shards int")
    placed = (
        sized.join(F.broadcast(sources.withColumnRenamed("source", "its")), F.col("source").eqNullSafe(F.col("its")))
        .drop("its")
        .withColumn("shard", F.expr(f"cast(pmod(xxhash64(doc_id, size, copy, {SEED}), shards) as int)"))
    )
    parts: list[list[tuple[int, int]]] = [[] for _ in totals]
    for r in placed.groupBy("source_no", "shard").agg(F.sum("size").alias("size")).collect():
        parts[r.source_no].append((r.shard, r["size"]))
    quotas = []
    for i, shard in enumerate(parts):
        shard.sort()
        given = sainte_lague([s for _, s in shard], int(seats[i]), [-(-cap * s // block) for _, s in shard])
        # the last block of a shard that is taken as often as it may be is a shorter one
        quotas += [(i, k, s, min(int(q) * block, cap * s)) for (k, s), q in zip(shard, given.tolist(), strict=True)]
    return placed, spark.createDataFrame(quotas, "source_no int, shard int, shard_size long, quota long")


def _taken(begin: Column, end: Column, block: int) -> Column:
    """Words of the layout's [begin, end) that a shard's last, partial pass takes.

    The shard's blocks are ranked by a seeded step through their numbers; those ranked below `whole` are taken,
    and of the next one the first `rest` words.
    """
    overlap = lambda a, b: F.greatest(F.lit(0), F.least(end, b) - F.greatest(begin, a))
    rank = lambda j: (j * F.col("stride") + F.col("shift")) % F.col("blocks")
    part = lambda j: F.when(rank(j) < F.col("whole"), overlap(j * block, (j + 1) * block)).when(rank(j) == F.col("whole"), overlap(j * block, j * block + F.col("rest"))).otherwise(F.lit(0))
    first, last = F.floor(begin / block), F.least(F.floor((end - 1) / block), F.col("blocks") - 1)
    inside = F.aggregate(F.sequence(first, last), F.lit(0).cast("long"), lambda acc, j: acc + part(j))
    # past the last whole block, the layout has fewer words than a block; they go last
    tail = F.when(F.col("whole") >= F.col("blocks"), overlap(F.col("blocks") * block, F.col("blocks") * block + F.col("rest"))).otherwise(F.lit(0))
    return (F.when((end > begin) & (last >= first), inside).otherwise(F.lit(0)) + F.when(end > begin, tail).otherwise(F.lit(0))).cast("long")


def mix(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, block: int = BLOCK, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """doc_id, source, size -> those, source_size, target, shard, begin (in the shard's layout) and taken."""
    placed, quotas = _plan(numbered(sized.select("doc_id", "source", "size")), weights, share, cap, block, shard_docs)
    order = Window.partitionBy("source_no", "shard").orderBy(F.xxhash64(F.col("doc_id"), F.col("copy"), F.lit(SEED + 1)), "doc_id", "size", "copy")
    laid = placed.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("begin", F.col("end") - F.col("size"))
    # a prime stride steps through all block numbers, as it is larger than any shard's count of blocks and so coprime to it
    quotas = (
        quotas.withColumn("passes", F.when(F.col("shard_size") > 0, F.expr("quota div shard_size")).otherwise(F.lit(0)))
        .withColumn("left", F.col("quota") - F.col("passes") * F.col("shard_size"))
        .withColumn("blocks", F.floor(F.col("shard_size") / block))
        .withColumn("whole", F.floor(F.col("left") / block))
        .withColumn("rest", F.col("left") % block)
        .withColumn("stride", F.lit(2_147_483_647) % F.greatest(F.col("blocks"), F.lit(1)))
        .withColumn("shift", F.expr(f"pmod(xxhash64(source_no, shard, {SEED + 2}), greatest(blocks, 1))"))
    )
    return (
        laid.join(F.broadcast(quotas), ["source_no", "shard"])
        .withColumn("taken", F.col("passes") * F.col("size") + _taken(F.col("begin"), F.col("end"), block))
        .select("doc_id", "source", "size", "source_size", "target", "source_no", "shard", "begin", "passes", "quota", "taken")
    )


def mix_query(documents: DataFrame) -> DataFrame:
    """The mix of all documents, one row each."""
    sized = materialise(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken", "source", "shard")


def mixed_documents(documents: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, each as often as its taken words round to whole copies.

    A document keeps floor(taken / size) copies, and one more when the rest of its size is above a seeded share
    of it, so that a source's copies hold about its target of words. Those without words are dropped.
    """
    sized = materialise(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")
    # repeated rows of a document are mixed one by one and add up
    taken = mix(sized, **options).groupBy("doc_id").agg(F.sum("taken").alias("mix_taken"), F.sum("size").alias("mix_size"), F.count("*").alias("mix_rows"))
    draw = F.expr(f"pmod(xxhash64(doc_id, {SEED + 3}), 1048576) / 1048576d")
    copies = taken.filter("mix_size > 0").select("doc_id", F.floor(F.col("mix_taken") / F.col("mix_size") + draw).cast("int").alias("mix_copies")).filter("mix_copies > 0")
    copies = copies.withColumnRenamed("doc_id", "mix_doc_id")
    chosen = documents.join(copies, F.col("doc_id").eqNullSafe(F.col("mix_doc_id")))
    return chosen.select("*", F.explode(F.expr("array_repeat(1, mix_copies)")).alias("mix_copy")).select(*documents.columns)
