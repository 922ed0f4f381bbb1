"""Document fingerprints: improbable-feature digests.

Every window of WINDOW bytes is ranked by how rare its entropy is: how many of all windows of all documents have
it, counted in Spark on a scale of 0 to 1000. Of each run of RUN consecutive windows, the
leftmost one of least rank gets a vote; windows with VOTES votes or more are the document's features. Features
go, in order, into a chain of Bloom filters of FEATURES each. Two digests are compared by the bits that their
filters share, above what is due to chance, as a share of the most they could.

A buffer of many documents is ranked at once: entropies come from a running integer sum, windows that span two
documents can't be chosen, and as those are WINDOW - 1 in a row, no run sees windows of two documents. So a
digest depends on the document's bytes alone.

Defined results: a null text is empty; a text shorter than a window is one feature, padded; two empty texts
have likeness 1; equal texts have equal digests. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.textbuf import flat, mix64, slices

WINDOW = 64
RUN = 64
VOTES = 16
FEATURES = 160
BITS = 2048
HASHES = 5
#: Entropy is scaled to 0..SCALE.
SCALE = 1000
BLOCK = 1 << 20

_COUNT = np.arange(WINDOW + 1, dtype=float)
_GAIN = np.round(np.diff(np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0)) * 1024).astype(np.int32)
_ODD = mix64(np.arange(1, WINDOW // 8 + 1, dtype=np.uint64)) | np.uint64(1)


def entropies(data: np.ndarray) -> np.ndarray:
    """The entropy of each window of the buffer, 0..1000, by its start.

    Sliding by a byte adds the gain of one more occurrence of the byte that comes and takes back that of the
    byte that goes: the sum of count * log2(count) follows, exactly in fixed point.
    """
    n = len(data)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    step = 1 << 17
    for lo in range(0, n, step):  # blocks that stay in the cache
        hi = min(n, lo + step)
        for lag in range(1, WINDOW):
            a = max(lo, lag)
            if a < hi:
                same = data[a:hi] == data[a - lag : hi - lag]
                before[a:hi] += same
                after[a - lag : hi - lag] += same
    change = _GAIN[before].astype(np.int64)
    change[WINDOW:] -= _GAIN[after[:-WINDOW]]
    total = np.cumsum(change)[WINDOW - 1 :]
    most = WINDOW * np.log2(WINDOW) * 1024
    return ((most - total) * (1000 / most)).astype(np.int32)


def whole_windows(offs: np.ndarray) -> np.ndarray:
    """By start: whether a window of the buffer lies in one document."""
    valid = np.zeros(int(offs[-1]) + 1, np.int32)
    long = np.flatnonzero(np.diff(offs) >= WINDOW)
    np.add.at(valid, offs[long], 1)
    np.add.at(valid, offs[long + 1] - WINDOW + 1, -1)
    return np.cumsum(valid[: int(offs[-1]) - WINDOW + 1]) > 0


def entropy_ranks(texts: DataFrame, text_col: str = "text") -> np.ndarray:
    """The rank of each entropy, the rarest first, by the windows of all texts; sums of SCALE + 1 numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SCALE + 1, np.int64)
        for batch in batches:
            for _, _, data, offs in slices(batch.column(0), BLOCK):
                if len(data) >= WINDOW:
                    total += np.bincount(entropies(data)[whole_windows(offs)], minlength=SCALE + 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["entropy", "n"])

    count = np.zeros(SCALE + 1, np.int64)
    for r in texts.select(texts[text_col].alias("text")).mapInArrow(run, "entropy long, n long").groupBy("entropy").agg(F.sum("n").alias("n")).collect():
        count[r.entropy] = r.n
    return ranked(count)


def ranked(count: np.ndarray) -> np.ndarray:
    """Places by count, ties by entropy."""
    out = np.empty(len(count), np.int32)
    out[np.argsort(count, kind="stable")] = np.arange(len(count))
    return out


def features(data: np.ndarray, offs: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and starts of the chosen windows of a buffer of documents, in order."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rank = ranks[entropies(data)]
    valid = whole_windows(offs)
    position = np.arange(len(rank), dtype=np.int64)
    never = np.int64(1) << 62
    key = np.full(len(rank) + 2 * (RUN - 1), never)
    key[RUN - 1 : RUN - 1 + len(rank)] = np.where(valid, (rank.astype(np.int64) << 40) | position, never)
    width = 1
    while width < RUN:  # least key of each run, by doubling
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    key = key[key != never]
    chosen = key & ((1 << 40) - 1)
    edge = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1], [True]]))
    starts = chosen[edge[:-1]][np.diff(edge) >= VOTES]
    return np.searchsorted(offs, starts, "right") - 1, starts


def window_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    if not len(starts):
        return np.zeros(0, np.uint64)
    cut = data[starts[:, None] + np.arange(WINDOW)]
    out = np.zeros(len(starts), np.uint64)
    for i, word in enumerate(np.ascontiguousarray(cut).view(np.uint64).T):
        out = mix64(out ^ (word * _ODD[i]))
    return out


def digests(data: np.ndarray, offs: np.ndarray, ranks: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Per document: its filters (rows of BITS / 8 bytes) and its features' count."""
    n = len(offs) - 1
    row, start = features(data, offs, ranks)
    hashes = window_hashes(data, start)
    short = np.flatnonzero((np.diff(offs) < WINDOW) & (np.diff(offs) > 0))
    if len(short):
        padded = np.zeros((len(short), WINDOW), np.uint8)
        for i, r in enumerate(short.tolist()):
            padded[i, : offs[r + 1] - offs[r]] = data[offs[r] : offs[r + 1]]
        row = np.concatenate([row, short])
        hashes = np.concatenate([hashes, window_hashes(padded.reshape(-1), np.arange(len(short)) * WINDOW)])
        order = np.argsort(row, kind="stable")
        row, hashes = row[order], hashes[order]
    # a feature counts once in a document
    first = _first_of_each(row, hashes)
    row, hashes = row[first], hashes[first]
    count = np.bincount(row, minlength=n)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    filters = np.maximum(1, -(-count // FEATURES))
    base = np.cumsum(filters) - filters
    bits = np.zeros((int(filters.sum()), BITS), np.uint8)
    where = base[row] + rank // FEATURES
    for i in range(HASHES):
        bits[where, (hashes >> np.uint64(11 * i)).astype(np.int64) & (BITS - 1)] = 1
    packed = np.packbits(bits, axis=1)
    return [(packed[a : a + f], c) for a, f, c in zip(base.tolist(), filters.tolist(), count.tolist(), strict=True)]


def _first_of_each(row: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the first of equal (row, hash) pairs, in order."""
    order = np.lexsort((np.arange(len(row)), hashes, row))
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[order][1:] != row[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])
    return np.sort(order[fresh])


def likeness(a: tuple[np.ndarray, int], b: tuple[np.ndarray, int]) -> float:
    """Of each filter of the digest with fewer filters, its best match's shared bits above chance; the mean, 0 to 1."""
    if not a[1] or not b[1]:
        return float(a[1] == b[1])
    if len(a[0]) > len(b[0]) or (len(a[0]) == len(b[0]) and a[1] > b[1]):
        a, b = b, a
    wide_a, wide_b = (np.ascontiguousarray(x[0]).view(np.uint64) for x in (a, b))
    ones_a, ones_b = (np.bitwise_count(x).sum(1, dtype=np.int64) for x in (wide_a, wide_b))
    total, step = 0.0, max(1, (1 << 18) // len(wide_b))  # some megabytes at once, whatever the number of filters
    for lo in range(0, len(wide_a), step):
        shared = np.bitwise_count(wide_a[lo : lo + step, None, :] & wide_b[None]).sum(2, dtype=np.int64)
        own = ones_a[lo : lo + step, None]
        chance, most = own * ones_b / BITS, np.minimum(own, ones_b)
        total += np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1).max(1).sum()
    return float(total / len(wide_a))


def encode(digest: tuple[np.ndarray, int]) -> str:
    filters, count = digest
    return f"{len(filters)}:{count}:" + base64.b64encode(filters.tobytes()).decode()


def decode(said: str) -> tuple[np.ndarray, int]:
    n, count, body = said.split(":")
    return np.frombuffer(base64.b64decode(body), np.uint8).reshape(int(n), BITS // 8), int(count)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: np.ndarray | None = None) -> DataFrame:
    """The digest of every row's text, as id and fingerprint; digests that are to be compared need the same ranks."""
    ranks = entropy_ranks(df, text_col) if ranks is None else ranks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offs in slices(batch.column(1), BLOCK):
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(map(encode, digests(data, offs, ranks)), pa.string())], names=["id", "fingerprint"])

    return df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text")).mapInArrow(run, "id long, fingerprint string")


EDIT_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edits(ranks: np.ndarray):
    """Rows come in order of run and place in it; the last of a run is a guest, there as the next of the one before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            columns = [*batch.columns[:3], flat(batch.column(3))]
            for lo, hi, data, offs in slices(columns[3], BLOCK):
                texts = columns[3][lo:hi].to_pylist()
                rows = list(zip(*(c[lo:hi].to_pylist() for c in columns[:3]), texts, digests(data, offs, ranks), strict=True))
                yield from _pairs(last + rows, ranks)
                last = rows[-1:]

    return run


def _pairs(rows: list[tuple], ranks: np.ndarray) -> Iterator[pa.RecordBatch]:
    out = []
    for (run, guest, key, text, digest), (next_run, _, _, next_text, next_digest) in zip(rows, rows[1:], strict=False):
        if guest or run != next_run:
            continue
        edit = len(text) // 2
        out.append((key, len(text), text[: len(text) - edit] + next_text[:edit], digest, next_digest))
    if not out:
        return
    edited = pa.array([x[2] for x in out], pa.large_string())
    changed = [d for _, _, data, offs in slices(edited, BLOCK) for d in digests(data, offs, ranks)]
    rows = [
        (key, n, hashlib.sha256(text.encode()).hexdigest(), encode(digest), encode(new), likeness(digest, new), likeness(digest, after))
        for (key, n, text, digest, after), new in zip(out, changed, strict=True)
    ]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in EDIT_SCHEMA.split(", ")])


def edit_query(documents: DataFrame, run_docs: int = 500, max_runs: int = 65_536, runs_a_task: int = 8) -> DataFrame:
    """Each text's digest, its edited text's, and how alike it is to that and to the next document's.

    Documents are dealt into runs of consecutive descending ids, whose bounds come from quantiles of the ids
    alone (at most max_runs values on the driver); the texts move once. The first document of each run is sent
    to the run before as well, as a guest that closes it; the first of all closes the last run. Null ids come
    last; rows of equal id follow by text.
    """
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    runs = max(1, min(max_runs, -(-documents.count() // run_docs)))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / runs for i in range(1, runs)], 0.25 / runs))) if runs > 1 else []
    cuts = cuts or [0.0]
    deal = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="key", outputCol="bucket", handleInvalid="keep")
    # ids at or above the last cut are run 0, null ids the last run
    run = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - F.col("bucket")).cast("int")
    numbered = deal.transform(docs.withColumn("key", F.col("doc_id").cast("double"))).withColumn("run", run)
    starts = sorted((r.run, r.doc_id) for r in numbered.groupBy("run").agg(F.max("doc_id").alias("doc_id")).collect())
    guests = documents.sparkSession.createDataFrame([(key, starts[i - 1][0]) for i, (_, key) in enumerate(starts)], "guest_id long, to int")
    # guests has a row for each run: max_runs at most
    placed = numbered.join(F.broadcast(guests), F.col("doc_id").eqNullSafe(F.col("guest_id")), "left")
    there = F.struct(F.col("run").alias("run"), F.lit(False).alias("guest"))
    places = F.when(F.col("to").isNull(), F.array(there)).otherwise(F.array(there, F.struct(F.col("to").alias("run"), F.lit(True).alias("guest"))))
    dealt = placed.select(F.explode(places).alias("place"), "doc_id", "text").select("place.run", "place.guest", "doc_id", "text")
    # a task holds several runs, so that hashing their numbers evens out
    dealt = dealt.repartition(max(1, -(-len(starts) // runs_a_task)), "run").sortWithinPartitions("run", "guest", F.col("doc_id").desc_nulls_last(), "text")
    return dealt.mapInArrow(_edits(entropy_ranks(documents)), EDIT_SCHEMA)
