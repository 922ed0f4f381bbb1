"""Toxicity by bags of subword embeddings under a linear softmax.

A text's words, and their character n-grams with word ends, are hashed into rows of an embedding table. The
mean of those rows goes through a linear softmax; table and softmax are trained together, in numpy, on the
driver, from a bounded sample of labelled documents. A misspelling that the sample lacks shares the vectors of
its n-grams with words that it has.

Since the softmax is linear, a trained model folds into one number for each row, and scoring a text is a mean
of table look-ups, done for many texts at once on their bytes.

Defined results: a null text or one without letters has no features, and its score is that of the bias alone;
labels that are null are left out, and of repeated labels of a document the largest holds; repeated rows are
scored alike, and equal scores are verdicts alike; without any label of both kinds nothing can be learnt and every score is 0. Columns other than the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.textbuf import buffers, flat, mix64, pieces, span_hashes

#: The most documents to fit on.
SAMPLE_DOCS = 5000
BUCKETS = 1 << 20
DIM = 8
#: Buckets in fewer of the sample's documents (one in so many of them, and 2 at least) are left out of the fit.
MIN_SHARE = 500
#: Each step shrinks the touched rows by this share.
DECAY = 0.003
GRAMS = (3, 4, 5)
#: Passes over the sample, and steps of BATCH documents at least.
EPOCHS, STEPS, BATCH = 5, 1600, 16
RATE = 1.0
SEED = 20240613
THRESHOLD = 0.3

SPACE = 32
#: Letters stay, lower-cased; bytes of longer characters stay; the rest is white space.
LETTER = np.full(256, SPACE, np.uint8)
LETTER[97:123] = np.arange(97, 123)
LETTER[65:91] = np.arange(97, 123)
LETTER[128:256] = np.arange(128, 256)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0xD6E8FEB86659FD93)


def normalised(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with one blank before and after each row, and each byte's row."""
    n = len(offs) - 1
    row = np.repeat(np.arange(n), np.diff(offs))
    out = np.full(len(data) + 2 * n, SPACE, np.uint8)
    small = LETTER[data]
    # accented Latin capitals are 32 below their small letters
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    small = np.where(second & (small >= 0x80) & (small <= 0x9E) & (small != 0x97), small + 32, small)
    out[np.arange(len(data)) + 2 * row + 1] = small
    return out, np.repeat(np.arange(n), np.diff(offs) + 2)


def subwords(data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, bucket) of the n-grams of each size, then of the words, of a buffer of texts; an n-gram has no blank inside."""
    text, row = normalised(data, offs)
    blank = text == SPACE
    hashed = np.zeros(len(text), np.uint64)
    inside = np.concatenate([[0], np.cumsum(blank)])
    for n in range(1, max(GRAMS) + 1):
        if len(text) < n:
            return
        hashed = hashed[: len(text) - n + 1] * _STEP + _BYTE[text[n - 1 :]]
        if n in GRAMS:
            at = np.flatnonzero(inside[n - 1 : len(text)] == inside[1 : len(text) - n + 2])
            yield row[at], (mix64(hashed[at] + np.uint64(n)) >> np.uint64(44)).astype(np.int64)
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    if len(starts):
        yield row[starts], (span_hashes(text, starts, ends) >> np.uint64(44)).astype(np.int64)


def scores(table: np.ndarray, bias: float, column: pa.Array) -> np.ndarray:
    """Of all texts of a column; a long text is summed part by part."""
    data, offs = buffers(flat(column))
    n = len(offs) - 1
    total, count = np.zeros(n), np.zeros(n)
    for lo, hi, part, bounds, _ in pieces(data, offs):
        for row, bucket in subwords(part, bounds):
            total[lo:hi] += np.bincount(row, table[bucket], minlength=hi - lo)
            count[lo:hi] += np.bincount(row, minlength=hi - lo)
    return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -60, 60)))


def _pairs(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of whole texts: the first one's number, and row, bucket and weight of all their different features."""
    held = []
    for lo, hi, data, bounds, done in pieces(*buffers(flat(texts)), 1 << 18):
        found = list(subwords(data, bounds))
        if found:
            row, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
            held.append(np.unique(row * BUCKETS + bucket, return_counts=True))
        if not done or not held:
            continue
        pair, which = np.unique(np.concatenate([x[0] for x in held]), return_inverse=True)
        count = np.bincount(which, np.concatenate([x[1] for x in held]), minlength=len(pair))
        held = []
        row, bucket = pair // BUCKETS, pair % BUCKETS
        yield lo, row, bucket, count / np.bincount(row, count, minlength=hi - lo)[row]


def fit(texts: pa.Array, labels: np.ndarray) -> tuple[np.ndarray, float]:
    """The folded table (a number for each bucket) and the bias, by AdaGrad on documents in a seeded order.

    The texts are gone through twice: what is in too few documents is known before anything is kept, and what is kept is written into
    arrays of its size, so that the driver never holds more than that.
    """
    if len(np.unique(labels)) < 2:
        return np.zeros(BUCKETS, np.float32), -60.0
    seen = np.zeros(BUCKETS, np.int32)
    for _, _, bucket, _ in _pairs(texts):
        seen += np.bincount(bucket, minlength=BUCKETS).astype(np.int32)
    common = seen >= max(2, len(labels) // MIN_SHARE)
    size = int(seen[common].sum())
    if not size:
        return np.zeros(BUCKETS, np.float32), -60.0
    row, bucket, weight = np.empty(size, np.int32), np.empty(size, np.int32), np.empty(size, np.float32)
    at = 0
    for lo, own, what, share in _pairs(texts):
        use = common[what]
        end = at + int(use.sum())
        row[at:end], bucket[at:end], weight[at:end] = own[use] + lo, what[use], share[use]
        at = end
    place = np.cumsum(common) - 1
    used, bucket = np.flatnonzero(common), place.astype(np.int32)[bucket]
    first = np.searchsorted(row, np.arange(len(labels) + 1))
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 1 / DIM, (len(used), DIM)).astype(np.float32)
    out = rng.normal(0, 1 / DIM, (DIM, 2)).astype(np.float32)
    bias = np.log(np.bincount(labels, minlength=2) / len(labels)).astype(np.float32)
    sum_v, sum_o, sum_b = np.full(len(used), 1e-6, np.float32), np.full(out.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    epochs = max(EPOCHS, -(-STEPS * BATCH // len(labels)))
    for epoch in range(epochs):
        order = rng.permutation(len(labels))
        for lo in range(0, len(order), BATCH):
            # the steps shrink to nothing, so that the last batches don't decide the result
            rate = RATE * (1 - (epoch + lo / len(order)) / epochs)
            docs = order[lo : lo + BATCH]
            docs = docs[first[docs + 1] > first[docs]]
            if not len(docs):
                continue
            at = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            begin = np.cumsum([0, *(first[docs + 1] - first[docs])[:-1]])
            b, w = bucket[at], weight[at]
            hidden = np.add.reduceat(vectors[b] * w[:, None], begin, axis=0)
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(docs)), labels[docs]] -= 1
            back = p @ out.T
            grad = np.repeat(back, first[docs + 1] - first[docs], axis=0) * w[:, None]
            touched, which = np.unique(b, return_inverse=True)
            own = np.stack([np.bincount(which, grad[:, k], minlength=len(touched)) for k in range(DIM)], axis=1).astype(np.float32)
            sum_v[touched] += (own * own).mean(1)
            vectors[touched] *= 1 - DECAY * rate / RATE
            vectors[touched] -= rate * own / np.sqrt(sum_v[touched])[:, None]
            g = hidden.T @ p
            sum_o += g * g
            out -= rate * g / np.sqrt(sum_o)
            g = p.sum(0)
            sum_b += g * g
            bias -= 0.1 * rate * g / np.sqrt(sum_b)
    table = np.zeros(BUCKETS, np.float32)
    table[used] = vectors @ (out[:, 1] - out[:, 0])
    return table, float(bias[1] - bias[0])


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def sample(documents: DataFrame, labels: DataFrame, docs: int = SAMPLE_DOCS) -> tuple[pa.Array, np.ndarray]:
    """Texts and labels of at most about `docs` labelled documents outside the held-out fold, by a hash of the id."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, docs / max(1, known.count()))
    chosen = known.filter(F.expr(f"pmod(xxhash64(doc_id, {SEED}), 1000000)") < int(share * 1_000_000))
    # about `docs` ids of two numbers each: within a broadcast's bounds at any size of input
    rows = documents.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", F.col("toxic").cast("int").alias("toxic")).toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return rows.column("text").combine_chunks(), rows.column("toxic").to_numpy().astype(np.int64)


SCORE_SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def model(documents: DataFrame, labels: DataFrame):
    """The trained model as a broadcast (table, bias): BUCKETS numbers, whatever the input's size."""
    texts, marks = sample(documents, labels)
    return documents.sparkSession.sparkContext.broadcast(fit(texts, marks))


def score(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document's fold, score and verdict."""
    known = model(documents, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = known.value
        for batch in batches:
            p = scores(table, bias, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    ids = documents["doc_id"].cast("long")
    return documents.select(ids.alias("doc_id"), F.coalesce(held_out(ids), F.lit(False)).alias("held_out"), "text").mapInArrow(run, SCORE_SCHEMA)


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model does not reject, as they are."""
    known, schema, at = model(documents, labels), documents.schema, documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = known.value
        for batch in batches:
            yield batch.filter(pa.array(scores(table, bias, batch.column(at)) < THRESHOLD))

    return documents.mapInArrow(run, schema)
