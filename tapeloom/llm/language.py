"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its byte n-grams and its standing in each language's lexicon; transitions
between the labels of neighbouring words are learnt with them. Forward-backward gives each word a probability
of each label, so a text that switches language is labelled span by span; a text's language is the label that
its words hold most of.

The field is fitted in numpy on the driver, from a bounded sample of labelled documents whose runs of words are
interleaved into switching sequences; its gradient takes the expected transitions from the forward and backward
messages. Texts are stepped in blocks of BLOCK words side by side. The messages that enter and leave a block are
exact: each block's product of step matrices carries them along the text.

Defined results: a null text or one without a letter is `und` with score 1; without any labelled document every
text is `und` with score 0; ties go to the first label in code-point order; repeated rows are labelled alike. Columns other than the id, text and
language are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.textbuf import buffers, flat, mix64, pieces, span_hashes
from tapeloom.llm.toxicity import _BYTE, _STEP, SPACE, held_out, normalised

#: The most documents of a language, documents in all and words to fit on.
SAMPLE_DOCS, SAMPLE_ALL, SAMPLE_WORDS = 250, 20_000, 240_000
FEW_LANGUAGES = 100_000
BUCKETS = 1 << 18
LEXICON = 2000
AFFIXES, GRAMS = (1, 2, 3), (2, 3)
RUN_WORDS, SEQUENCE = (4, 24), 48
EPOCHS, BATCH, RATE, SHRINK = 4, 128, 0.3, 1e-4
#: Words of a text that are stepped one after the other; it has no bearing on the result.
BLOCK = 128
SEED = 20240614
UNKNOWN = "und"


@dataclass
class Words:
    """The words of a buffer of texts: their rows, their hashes, and (word, bucket) pairs by kind of feature."""

    row: np.ndarray
    hashes: np.ndarray
    pairs: list[tuple[np.ndarray | None, np.ndarray]]


def word_bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    blank = text == SPACE
    return np.flatnonzero(blank[:-1] & ~blank[1:]) + 1, np.flatnonzero(~blank[:-1] & blank[1:]) + 1


def word_hashes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the row of each word."""
    text, row = normalised(data, offs)
    starts, ends = word_bounds(text)
    return span_hashes(text, starts, ends), row[starts]


def word_features(data: np.ndarray, offs: np.ndarray) -> Words:
    text, row = normalised(data, offs)
    starts, ends = word_bounds(text)
    size = ends - starts
    pairs: list[tuple[np.ndarray | None, np.ndarray]] = []
    kind = 0

    def bucket(hashed: np.ndarray) -> np.ndarray:
        nonlocal kind
        kind += 1
        return (mix64(hashed + np.uint64(kind)) >> np.uint64(46)).astype(np.int64)

    hashed = np.zeros(len(text), np.uint64)
    for n in range(1, max(*AFFIXES, *GRAMS) + 1):
        if len(text) < n:
            break
        hashed = hashed[: len(text) - n + 1] * _STEP + _BYTE[text[n - 1 :]]
        if n in AFFIXES:
            # a shorter word has the blank before it as part of its suffix, and the one after it of its prefix
            pairs.append((None, bucket(hashed[np.minimum(starts, len(hashed) - 1)])))
            pairs.append((None, bucket(hashed[np.maximum(ends - n, 0)])))
        if n in GRAMS:
            count = np.maximum(size - n + 1, 0)
            word = np.repeat(np.arange(len(starts)), count)
            at = starts[word] + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
            pairs.append((word, bucket(hashed[at])))
    return Words(row[starts], span_hashes(text, starts, ends), pairs)


@dataclass
class Field:
    """Labels, bucket weights, lexicon (sorted word hashes, the language of each, its weights) and transitions."""

    labels: list[str]
    weights: np.ndarray
    words: np.ndarray
    word_label: np.ndarray
    lexicon: np.ndarray
    steps: np.ndarray

    def member(self, hashes: np.ndarray) -> np.ndarray:
        """The row of lexicon weights of each word: that of its language, or the last for words in no lexicon."""
        if not len(self.words):
            return np.full(len(hashes), len(self.labels))
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.word_label[at], len(self.labels))

    def emissions(self, words: Words) -> np.ndarray:
        out = self.lexicon[self.member(words.hashes)].copy()
        for word, bucket in words.pairs:
            if word is None:
                out += self.weights[bucket]
            elif len(word):
                first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                out[word[first]] += np.add.reduceat(self.weights[bucket], first, axis=0)
        return out


def marginals(emission: np.ndarray, steps: np.ndarray, place: np.ndarray, valid: np.ndarray, enter: np.ndarray | None = None, leave: np.ndarray | None = None, moves: np.ndarray | None = None) -> np.ndarray:
    """Label probabilities (steps, lanes, labels) of chains that step together; place: the word at (step, lane).

    enter and leave are the messages (lanes, labels) from before a chain's first and from after its last word, ones
    where there is nothing. moves, if given, is added the expected count of each transition within the chains.
    """
    length, lanes = place.shape
    factor = np.exp(emission - emission.max(1, keepdims=True))[place]
    factor[~valid] = 1
    go = np.exp(steps - steps.max())
    ahead = np.empty_like(factor)
    state = factor[0] if enter is None else factor[0] * enter
    state = state / state.sum(1, keepdims=True)
    ahead[0] = state
    for t in range(1, length):
        state = (state @ go) * factor[t]
        state /= state.sum(1, keepdims=True)
        ahead[t] = state
    end = np.ones((lanes, emission.shape[1]), factor.dtype) if leave is None else leave
    back = end.copy()
    for t in range(length - 1, -1, -1):
        if moves is not None and t:
            joint = ahead[t - 1][:, :, None] * go[None] * (factor[t] * back)[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            moves += joint[valid[t]].sum(0)
        ahead[t] *= back
        ahead[t] /= ahead[t].sum(1, keepdims=True)
        back = (back * factor[t]) @ go.T
        back /= back.sum(1, keepdims=True)
        back[~valid[t]] = end[~valid[t]]
    return ahead


def messages(emission: np.ndarray, steps: np.ndarray, place: np.ndarray, valid: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What enters and what leaves each block: lanes are the blocks of texts, end to end; first marks a text's first one."""
    lanes, labels = place.shape[1], emission.shape[1]
    enter, leave = np.ones((lanes, labels)), np.ones((lanes, labels))
    number = np.arange(lanes) - np.maximum.accumulate(np.where(first, np.arange(lanes), 0))
    rest = np.flatnonzero(~first)
    if not len(rest):
        return enter, leave
    # blocks of texts that have several, and the product of each one's steps
    several = np.unique(np.concatenate([rest, rest - 1]))
    go = np.exp(steps - steps.max()).astype(float)
    factor = np.exp(emission - emission.max(1, keepdims=True))
    product = np.eye(labels)[None] * factor[place[0, several]][:, None, :].astype(float)
    for t in range(1, place.shape[0]):
        there = valid[t, several]
        if not there.any():
            break
        step = (product[there] @ go) * factor[place[t, several[there]]][:, None, :]
        product[there] = step / step.sum((1, 2), keepdims=True)
    of = np.full(lanes, -1)
    of[several] = np.arange(len(several))
    by_number = np.argsort(number[rest], kind="stable")
    rest, cuts = rest[by_number], np.flatnonzero(np.diff(number[rest][by_number])) + 1
    runs = np.split(rest, cuts)
    for at in runs:
        message = np.einsum("li,lij->lj", enter[at - 1], product[of[at - 1]]) @ go
        enter[at] = message / message.sum(1, keepdims=True)
    for at in reversed(runs):
        message = np.einsum("lij,lj->li", product[of[at]], leave[at]) @ go.T
        leave[at - 1] = message / message.sum(1, keepdims=True)
    return enter, leave


def label_words(field: Field, emission: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's label probabilities, and their sums over each row."""
    n = len(row)
    if not n:
        return np.zeros((0, len(field.labels)), np.float32), np.zeros((rows, len(field.labels)))
    count = np.bincount(row, minlength=rows)
    blocks = -(-count // BLOCK)
    of = np.repeat(np.arange(rows), blocks)
    start, number = np.cumsum(count) - count, np.arange(len(of)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = start[of] + number * BLOCK
    end = np.minimum(begin + BLOCK, (start + count)[of])
    out = np.empty((n, len(field.labels)), np.float32)
    enter, leave = np.empty((len(of), len(field.labels))), np.empty((len(of), len(field.labels)))
    grid = lambda at: begin[None, at] + np.arange(int((end - begin)[at].max()))[:, None]
    whole = slice(None)
    place = grid(whole)
    enter, leave = messages(emission, field.steps, np.minimum(place, n - 1), place < end, number == 0)
    for lo in range(0, len(of), 4096):
        at = slice(lo, lo + 4096)
        place = grid(at)
        valid = place < end[at]
        p = marginals(emission, field.steps, np.minimum(place, n - 1), valid, enter[at], leave[at])
        out[place[valid]] = p[valid]
    return out, np.stack([np.bincount(row, out[:, k], minlength=rows) for k in range(out.shape[1])], axis=1)


def labelled(field: Field, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, each word's row, its label probabilities, their sums by row) for slices of whole rows; long texts are read part by part."""
    emissions, rows = [], []
    for lo, hi, data, offs, done in pieces(*buffers(flat(column)), 1 << 19):
        words = word_features(data, offs)
        emissions.append(field.emissions(words))
        rows.append(words.row)
        if done:
            row = np.concatenate(rows)
            yield lo, hi, row, *label_words(field, np.concatenate(emissions), row, hi - lo)
            emissions, rows = [], []


def fit(texts: pa.Array, langs: list[str]) -> Field | None:
    labels = sorted(set(langs))
    if not labels:
        return None
    number = np.array([labels.index(x) for x in langs])
    # the words of all texts first, and then the features of those in chosen runs
    hashes, row = [], []
    for lo, _, data, offs, _ in pieces(*buffers(flat(texts)), 1 << 19):
        words = word_hashes(data, offs)
        hashes.append(words[0])
        row.append(words[1] + lo)
    hashes, row = np.concatenate(hashes), np.concatenate(row)
    label, total = number[row], len(row)
    if not total:
        return None
    # lexicons: each language's most frequent words that are mostly its own
    known, which = np.unique(hashes, return_inverse=True)
    seen = np.stack([np.bincount(which[label == k], minlength=len(known)) for k in range(len(labels))])
    owner, most = seen.argmax(0), seen.max(0)
    own = (most >= 3) & (most >= 0.7 * seen.sum(0))
    keep = np.concatenate([np.flatnonzero(own & (owner == k))[np.argsort(-most[own & (owner == k)], kind="stable")[:LEXICON]] for k in range(len(labels))])
    keep.sort()
    field = Field(labels, np.zeros((BUCKETS, len(labels)), np.float32), known[keep], owner[keep], np.zeros((len(labels) + 1, len(labels)), np.float32), np.zeros((len(labels), len(labels)), np.float32))
    # runs of words of a text, in a seeded order, end to end: sequences that switch
    rng = np.random.default_rng(SEED)
    runs, at = [], 0
    lengths = rng.integers(*RUN_WORDS, total)
    for size in lengths.tolist():
        if at >= total:
            break
        end = min(at + size, int(np.searchsorted(row, row[at], "right")))
        runs.append((at, end))
        at = end
    order = [runs[i] for i in rng.permutation(len(runs))]
    sequence = np.concatenate([np.arange(a, b) for a, b in order])[:SAMPLE_WORDS]
    sequence = sequence[: len(sequence) // SEQUENCE * SEQUENCE].reshape(-1, SEQUENCE) if len(sequence) >= SEQUENCE else sequence[None, :]
    chosen = np.zeros(total, bool)
    chosen[sequence.reshape(-1)] = True
    pair_word, pair_bucket, before = [], [], 0
    for _, _, data, offs, _ in pieces(*buffers(flat(texts)), 1 << 19):
        words = word_features(data, offs)
        for word, bucket in words.pairs:
            word = np.arange(len(words.row)) if word is None else word
            use = chosen[before + word]
            pair_word.append(before + word[use])
            pair_bucket.append(bucket[use].astype(np.int32))
        before += len(words.row)
    pair_word, pair_bucket = np.concatenate(pair_word), np.concatenate(pair_bucket)
    by_word = np.argsort(pair_word, kind="stable")
    pair_word, pair_bucket = pair_word[by_word], pair_bucket[by_word]
    first = np.searchsorted(pair_word, np.arange(total + 1))
    member = field.member(hashes)
    sums = [np.full(x.shape, 1e-4, np.float32) for x in (field.weights, field.lexicon, field.steps)]
    for _ in range(EPOCHS):
        for lo in range(0, len(sequence), BATCH):
            batch = sequence[lo : lo + BATCH]
            word = batch.reshape(-1)
            count = first[word + 1] - first[word]
            spot = np.repeat(np.arange(len(word)), count)
            bucket = pair_bucket[np.repeat(first[word], count) + np.arange(len(spot)) - np.repeat(np.cumsum(count) - count, count)]
            emission = field.lexicon[member[word]].copy()
            for k in range(len(labels)):
                emission[:, k] += np.bincount(spot, field.weights[bucket, k], minlength=len(word))
            place = np.arange(len(word)).reshape(batch.shape).T
            # expected transitions, against the ones there are
            moves = np.zeros((len(labels), len(labels)))
            p = marginals(emission, field.steps, place, np.ones(place.shape, bool), moves=moves).transpose(1, 0, 2).reshape(len(word), -1)
            truth = label[word]
            grad = p.copy()
            grad[np.arange(len(word)), truth] -= 1
            truths = truth.reshape(batch.shape)
            np.subtract.at(moves, (truths[:, :-1].reshape(-1), truths[:, 1:].reshape(-1)), 1)
            touched, which = np.unique(bucket, return_inverse=True)
            own = np.stack([np.bincount(which, grad[spot, k], minlength=len(touched)) for k in range(len(labels))], axis=1).astype(np.float32)
            own += SHRINK * len(word) * field.weights[touched]
            sums[0][touched] += own * own
            field.weights[touched] -= RATE * own / np.sqrt(sums[0][touched])
            for k, (values, g) in enumerate(((field.lexicon, np.stack([np.bincount(member[word], grad[:, j], minlength=len(labels) + 1) for j in range(len(labels))], axis=1)), (field.steps, moves)), 1):
                g = g.astype(np.float32)
                sums[k] += g * g
                values -= RATE * g / np.sqrt(sums[k])
    return field


def sample(documents: DataFrame) -> tuple[pa.Array, list[str]]:
    """Texts and languages of about SAMPLE_DOCS documents of each language and SAMPLE_ALL of all, by a hash of the id."""
    known = documents.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = known.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    each = min(SAMPLE_DOCS, SAMPLE_ALL / max(1, languages))
    share = counts.select("lang", (F.least(F.lit(1.0), F.lit(float(each)) / F.col("n")) * 1_000_000).cast("long").alias("share"))
    # a row a language: broadcast where they are few, joined by a shuffle beyond
    share = F.broadcast(share) if languages <= FEW_LANGUAGES else share
    rows = known.withColumn("draw", F.expr(f"pmod(xxhash64(doc_id, {SEED}), 1000000)")).join(share, "lang").filter("draw < share")
    found = rows.select("doc_id", "text", "lang").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    texts = found.column("text").combine_chunks()
    return texts, found.column("lang").to_pylist()


PREDICT_SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"
SPAN_SCHEMA = "doc_id long, spans array<struct<lang:string,words:int>>"


def predict(documents: DataFrame) -> DataFrame:
    """Every document's fold, language and the share of its words' probability that the language holds."""
    known = documents.sparkSession.sparkContext.broadcast(fit(*sample(documents)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = known.value
        for batch in batches:
            column = batch.column(2)
            # whether a text has an ASCII letter; the others are looked at one by one
            letters = pc.fill_null(pc.match_substring_regex(column, "[A-Za-z]"), False).to_numpy(zero_copy_only=False)
            if field is None:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n))], names=["doc_id", "held_out", "lang_pred", "score"])
                continue
            for lo, hi, _, _, sums in labelled(field, column):
                total = sums.sum(1)
                bare = ~letters[lo:hi]
                for r in np.flatnonzero(bare & (total > 0)).tolist():
                    bare[r] = not any(c.isalpha() for c in column[lo + r].as_py())
                lang = [UNKNOWN if b else field.labels[k] for b, k in zip(bare.tolist(), sums.argmax(1).tolist(), strict=True)]
                score = np.where(bare, 1.0, sums.max(1) / np.maximum(total, 1e-12))
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(1)[lo:hi], pa.array(lang), pa.array(np.clip(score, 0, 1))], names=["doc_id", "held_out", "lang_pred", "score"])

    ids = documents["doc_id"].cast("long")
    return documents.select(ids.alias("doc_id"), F.coalesce(held_out(ids), F.lit(False)).alias("held_out"), "text").mapInArrow(run, PREDICT_SCHEMA)


def language_spans(documents: DataFrame) -> DataFrame:
    """Every document's runs of words of one language, in order."""
    known = documents.sparkSession.sparkContext.broadcast(fit(*sample(documents)))
    kind = pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = known.value
        for batch in batches:
            if field is None:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[]] * batch.num_rows, kind)], names=["doc_id", "spans"])
                continue
            for lo, hi, row, p, _ in labelled(field, batch.column(1)):
                spans: list[list[dict]] = [[] for _ in range(hi - lo)]
                best = p.argmax(1)
                edge = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1]), [True]])) if len(best) else np.zeros(1, int)
                for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                    spans[row[a]].append({"lang": field.labels[best[a]], "words": b - a})
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(spans, kind)], names=["doc_id", "spans"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPAN_SCHEMA)
