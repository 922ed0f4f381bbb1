"""Ranked lexical search over hashed max-sketches.

A document's sketch has two rows of coordinates. Each of its terms is hashed to a coordinate of either row, and a coordinate
keeps the greatest number of occurrences among the terms that meet there, as one of 16 levels that are never below the number.
What a term adds to a score grows with its occurrences, and all else in it is the document's length or the corpus's
counts, so the lesser of a term's two coordinates bounds what the term adds, and the sum over a query's terms bounds the score.
A sketch is eight to sixteen coordinates wide for each different term of its document, so a term that isn't in it meets
another one in both rows for about one in a hundred.

One pass over the texts writes sketches, lengths and texts as a table, and counts the documents of each query term. All queries
are looked up together in a batch of sketches. The highest bounds of each query are scored exactly first, which gives
a threshold: the score of the last place among them. Then every document is taken up whose bound for some query reaches that
query's threshold, by descending bound, and scored exactly; each task raises its thresholds as it finds more, and gives its best for each query.
No document below a threshold can be among the best, so the result is exact.

To the driver come the queries themselves, counts by query term and a threshold by query: at most MAX_ITEMS queries of MAX_TERMS
terms, whatever the corpus. More raise.

Defined results: a null or empty text, or one of separators alone, has no term and is never found; queries without a term
find nothing; a repeated query row is a query of its own; a repeated document row takes a rank of its own, and documents without
an id come last among equal scores; an empty corpus gives an empty result; other columns are ignored.
Terms are known by 64-bit hashes, which two different terms share with a chance of 5e-20.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.shared import Workspace
from tapeloom.llm.textbuf import LOWER, buffers, flat, pieces, span_hashes, words

K = 50
SEEDS = 64
WIDE = 8
LEAST_WIDTH, MOST_WIDTH = 64, 1 << 20
#: The greatest number of occurrences that a level stands for.
LEVELS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 48, 128, np.iinfo(np.int64).max])
MAX_ITEMS = 10_000
MAX_TERMS = 2_000_000
CELLS = 1 << 22
GROUP = 128
SALTS = 64

APART = np.ones(256, bool)
for _first, _last in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    APART[_first : _last + 1] = False

Batches = Iterator[pa.RecordBatch]


def terms(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, rows counted from the first, hashes) of all terms, for runs of whole rows."""
    data, offs = buffers(flat(column))
    rows, hashes = [], []
    for lo, hi, part, own, last in pieces(data, offs):
        low = LOWER[part]
        starts, ends, row = words(low, own, APART)
        rows.append(row)
        hashes.append(span_hashes(low, starts, ends))
        if last:
            yield lo, hi, np.concatenate(rows), np.concatenate(hashes)
            rows, hashes = [], []


@dataclass(frozen=True)
class Queries:
    """Hashes of all terms in order; for each, the items that hold it; its weight, when the corpus is counted."""

    hashes: np.ndarray
    offsets: np.ndarray
    items: np.ndarray
    count: int
    weights: np.ndarray | None = None
    documents: int = 0
    length: int = 0

    def spread(self, rows: np.ndarray, term: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
        """Sums by row and item of what each (row, term) adds: whole numbers below 2**53."""
        times = np.diff(self.offsets)[term]
        at = np.repeat(self.offsets[term] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        return np.bincount(np.repeat(rows, times) * self.count + self.items[at], np.repeat(parts, times).astype(float), n * self.count).reshape(n, self.count)

    def added(self, term: np.ndarray, occurrences: np.ndarray, length: np.ndarray) -> np.ndarray:
        """What a term adds to the score of a document of that many terms."""
        relative = 50 + 50 * length * self.documents // self.length
        times = np.minimum(occurrences, 1 << 32)
        return self.weights[term] * (1_000_000_000 * times // (1000 * times + 20 * relative))


def queries(texts: list[str | None]) -> Queries:
    rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for lo, _, row, hash_ in terms(pa.array(texts, pa.string())):
        rows.append(row + lo)
        hashes.append(hash_)
    pairs = np.unique(np.stack([np.concatenate(hashes), np.concatenate(rows).astype(np.uint64)], 1), axis=0)
    known, counts = np.unique(pairs[:, 0], return_counts=True)
    if len(pairs) > MAX_TERMS:
        raise ValueError(f"more than {MAX_TERMS} terms in the queries: search for them in several runs")
    return Queries(known, np.concatenate([[0], np.cumsum(counts)]), pairs[:, 1].astype(np.int64), len(texts))


def occurrences(known: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number of the query term and occurrences, for all query terms in the rows."""
    if not len(known) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
    hit = known[at] == hashes
    key, times = np.unique(rows[hit] * len(known) + at[hit], return_counts=True)
    return key // len(known), key % len(known), times


def sketches(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of n rows, end to end, and the offsets: a byte has a coordinate of the first row below one of the second."""
    key, times = np.unique(rows.astype(np.uint64) << np.uint64(40) | hashes >> np.uint64(24), return_counts=True)
    row = (key >> np.uint64(40)).astype(np.int64)
    different = np.bincount(row, minlength=n)
    width = np.clip(1 << np.ceil(np.log2(np.maximum(different * WIDE, 1))).astype(np.int64), LEAST_WIDTH, MOST_WIDTH)
    width[different == 0] = 0
    offsets = np.concatenate([[0], np.cumsum(width)])
    level = np.searchsorted(LEVELS, times).astype(np.uint8)
    order = np.argsort(level, kind="stable")  # of several values for one place, the last and greatest one stays
    row, level = row[order], level[order]
    first, second = coordinates(key[order], width[row])
    low, high = (np.zeros(int(offsets[-1]), np.uint8) for _ in range(2))
    low[offsets[row] + first] = level
    high[offsets[row] + second] = level
    return low | high << 4, offsets


def coordinates(key: np.ndarray, width: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """The two coordinates of a 40-bit hash."""
    key = key.astype(np.int64) & ((1 << 40) - 1)
    return key & (width - 1), key >> 20 & (width - 1)


def bounds(known: Queries, data: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of rows and their bounds by item, for runs of rows whose sketches are equally wide."""
    width = np.diff(offsets)
    step = max(1, CELLS // max(len(known.hashes), known.count, 1))
    for wide in np.unique(width[width > 0]).tolist():
        first, second = coordinates(known.hashes >> np.uint64(24), wide)
        every = np.flatnonzero(width == wide)
        size = max(1, min(step, (1 << 26) // wide))
        for at in range(0, len(every), size):
            part = every[at : at + size]
            sketch = np.stack([data[o : o + wide] for o in offsets[part].tolist()])
            levels = np.minimum(sketch.take(first, 1) & 15, sketch.take(second, 1) >> 4)
            row, term = np.nonzero(levels)
            yield part, known.spread(row, term, known.added(term, LEVELS[levels[row, term]], lengths[part[row]]), len(part))


def _index(known: Queries) -> Callable[[Batches], Batches]:
    """row, doc_id, text -> the table of sketches, and a task's documents by query term."""
    names = ["row", "doc_id", "text", "n_terms", "sketch", "term", "documents"]

    def run(batches: Batches) -> Batches:
        found = np.zeros(len(known.hashes), np.int64)
        for batch in batches:
            for lo, hi, rows, hashes in terms(batch.column("text")):
                n = hi - lo
                data, offsets = sketches(rows, hashes, n)
                sketch = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])
                found += np.bincount(occurrences(known.hashes, rows, hashes)[1], minlength=len(found))
                whole = batch.slice(lo, n)
                lengths = pa.array(np.bincount(rows, minlength=n))
                yield pa.RecordBatch.from_arrays([*whole.columns, lengths, sketch, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        term = np.flatnonzero(found)
        if len(term):
            nothing = [pa.nulls(len(term), t) for t in (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(term), pa.array(found[term])], names)

    return run


def _highest(known: Queries, seeds: int) -> Callable[[Batches], Batches]:
    """row, n_terms, sketch -> the highest bounds of each item in a task."""

    def run(batches: Batches) -> Batches:
        best, whose = np.zeros((known.count, 0)), np.zeros((known.count, 0), np.int64)
        for batch in batches:
            number = batch.column("row").to_numpy()
            data, offsets = buffers(batch.column("sketch"))
            for part, bound in bounds(known, data, offsets, batch.column("n_terms").to_numpy()):
                best = np.concatenate([best, bound.T], 1)
                whose = np.concatenate([whose, np.broadcast_to(number[part], bound.T.shape)], 1)
                if best.shape[1] > seeds:
                    top = np.argpartition(best, -seeds, 1)[:, -seeds:]
                    best, whose = np.take_along_axis(best, top, 1), np.take_along_axis(whose, top, 1)
        item, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(whose[item, place]), pa.array(best[item, place])], ["item", "row", "bound"])

    return run


def exact(known: Queries, texts: pa.Array, lengths: np.ndarray) -> np.ndarray:
    """Scores by row and item."""
    out = np.zeros((len(texts), known.count))
    for lo, hi, rows, hashes in terms(texts):
        row, term, times = occurrences(known.hashes, rows, hashes)
        out[lo:hi] = known.spread(row, term, known.added(term, times, lengths[lo + row]), hi - lo)
    return out


class Best:
    """The k best documents of each item so far; a threshold is the score that a document has to reach."""

    def __init__(self, thresholds: np.ndarray, k: int) -> None:
        self.thresholds, self.k = np.maximum(thresholds, 1.0), k
        self.held = [np.zeros(0, np.int64) for _ in range(3)] + [np.zeros(0, bool)]
        self.fresh: list[tuple[np.ndarray, ...]] = []
        self.more = 0

    def add(self, score: np.ndarray, doc_id: np.ndarray, null: np.ndarray) -> None:
        row, item = np.nonzero(score >= self.thresholds)
        if len(row):
            self.fresh.append((item, score[row, item].astype(np.int64), doc_id[row], null[row]))
            self.more += len(row)
            if self.more > 4 * self.k * len(self.thresholds) or self.more > 4096:
                self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """Item, score, id and whether that is null, of the best."""
        item, score, doc_id, null = (np.concatenate(x) for x in zip(self.held, *self.fresh, strict=True))
        order = np.lexsort((doc_id, null, -score, item))
        item, score, doc_id, null = (x[order] for x in (item, score, doc_id, null))
        place = np.arange(len(item)) - np.searchsorted(item, item)
        last = place == self.k - 1
        self.thresholds[item[last]] = np.maximum(self.thresholds[item[last]], score[last])
        self.held, self.fresh, self.more = [x[place < self.k] for x in (item, score, doc_id, null)], [], 0
        return tuple(self.held)


def _rescored(known: Queries, thresholds: np.ndarray, k: int, all_of_them: bool) -> Callable[[Batches], Batches]:
    """doc_id, text, n_terms, and sketch unless all are to be scored -> a task's best documents of each item."""

    def run(batches: Batches) -> Batches:
        best = Best(thresholds, k)
        for batch in batches:
            lengths = batch.column("n_terms").to_numpy()
            ids = batch.column("doc_id")
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            if all_of_them:
                plan = [(np.arange(batch.num_rows), np.full((batch.num_rows, known.count), np.inf))]
            else:
                plan = bounds(known, *buffers(batch.column("sketch")), lengths)
            for part, bound in plan:
                margin = (bound - best.thresholds).max(1, initial=-1)
                order = np.argsort(-margin, kind="stable")
                order = order[: np.count_nonzero(margin >= 0)]
                for at in range(0, len(order), GROUP):
                    now = order[at : at + GROUP]
                    now = now[(bound[now] >= best.thresholds).any(1)]
                    if len(now):
                        at_rows = part[now]
                        best.add(exact(known, batch.column("text").take(pa.array(at_rows)), lengths[at_rows]), ids[at_rows], null[at_rows])
        item, score, doc_id, null = best.settle()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc_id, mask=null), pa.array(score)], ["item", "doc_id", "score"])

    return run


def ranked(found: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each item with their rank; a part of an item's rows is cut to k before they meet."""
    parts = Window.partitionBy("item", F.pmod(F.xxhash64(*found.columns), F.lit(SALTS))).orderBy(*order)
    whole = Window.partitionBy("item").orderBy(*order)
    return found.withColumn("rank", F.row_number().over(parts)).filter(F.col("rank") <= k).withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


def search(documents: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text and item_id, text -> item_id, rank, doc_id, score: the k best documents of each item."""
    spark = documents.sparkSession
    asked = items.select("item_id", "text").orderBy("item_id", "text").limit(MAX_ITEMS + 1).collect()
    if len(asked) > MAX_ITEMS:
        raise ValueError(f"more than {MAX_ITEMS} queries: search for them in several runs")
    schema = f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long"
    known = queries([r.text for r in asked])
    with Workspace(spark) as space:
        numbered = documents.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
        table = space.keep(numbered.mapInArrow(_index(known), "row long, doc_id long, text string, n_terms long, sketch binary, term long, documents long"), "sketches", compression="zstd")
        total = table.agg(F.count_if(F.col("n_terms") > 0).alias("n"), F.sum("n_terms").alias("length")).first()
        if not total.n or not len(known.hashes):
            return spark.createDataFrame([], schema)
        documents_of = np.zeros(len(known.hashes), np.int64)
        for r in table.filter("term IS NOT NULL").groupBy("term").agg(F.sum("documents").alias("n")).collect():
            documents_of[r.term] = r.n
        weights = np.array([math.floor(1000 * math.log((2 * total.n + 2) / (2 * n + 1))) for n in documents_of.tolist()])
        known = replace(known, weights=weights, documents=total.n, length=total.length)
        held = table.filter("n_terms > 0")
        # the highest bounds of each item: at most SEEDS rows for it, whatever the corpus
        seeds = held.select("row", "n_terms", "sketch").mapInArrow(_highest(known, SEEDS), "item long, row long, bound double")
        seeds = space.keep(ranked(seeds, SEEDS, F.desc("bound"), "row").select("row").distinct(), "seeds")
        found = held.select("row", "doc_id", "text", "n_terms").join(F.broadcast(seeds), "row").select("doc_id", "text", "n_terms")
        found = found.mapInArrow(_rescored(known, np.zeros(known.count), k, True), "item long, doc_id long, score long")
        thresholds = np.zeros(known.count)
        for r in ranked(found, k, F.desc("score"), F.asc_nulls_last("doc_id")).filter(F.col("rank") == k).select("item", "score").collect():
            thresholds[r["item"]] = r.score
        found = held.select("doc_id", "text", "n_terms", "sketch").mapInArrow(_rescored(known, thresholds, k, False), "item long, doc_id long, score long")
        ids = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(asked)], f"item long, item_id {items.schema['item_id'].dataType.simpleString()}")
        best = ranked(found, k, F.desc("score"), F.asc_nulls_last("doc_id")).join(F.broadcast(ids), "item")
        return space.result(best.select("item_id", F.col("rank").cast("int"), "doc_id", "score"), "search-result")


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE = f"""
    WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents),
    size AS (SELECT rid, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
    whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM size),
    tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) GROUP BY ALL),
    q AS (SELECT DISTINCT item_no, item_id, term FROM (SELECT row_number() OVER () AS item_no, item_id, unnest({_TERMS}) AS term FROM benchmark)),
    w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf CROSS JOIN whole GROUP BY term, docs),
    s AS (
        SELECT item_no, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // length)))) AS BIGINT) AS score
        FROM q JOIN tf USING (term) JOIN w USING (term) JOIN size USING (rid) CROSS JOIN whole GROUP BY item_no, item_id, rid, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank, doc_id, score FROM s WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY item_no ORDER BY score DESC, doc_id NULLS LAST) <= {K}
"""
