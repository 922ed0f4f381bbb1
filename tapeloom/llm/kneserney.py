"""LM scoring by an interpolated modified Kneser-Ney bigram model.

Words are counted in Spark and written as hash arrays, sorted within shards by the top bits of the hash; a
word's place in the whole order is its number. Pairs of numbers are counted in Spark as well, and written the
same way under a scrambled pair key, in shards by context (those of frequent contexts are spread by pair).
What a context or a word needs besides, follows from the pairs and is kept in arrays by word number. All of these
lie in the shared folder, a file for each shard that one task writes whole, and workers memory-map them to score
texts; no worker loads or receives the model. There are as many shards and tasks as the bytes of text ask for.

    p(w | v) = (n(v w) - D(n)) / n(v) + gamma(v) p(w)
    p(w)     = (t(w) - D'(t)) / T + gamma' / (V + 1)

n counts pairs, t(w) the different words before w, T all different pairs; D depends on the count (1, 2, 3 or
more). A context outside the model scores by p(w) alone, and a word outside it has gamma' / (V + 1).

Defined results: a null text is empty, and an empty text has one token, its end; with nothing to learn from,
every probability is 1 / (V + 1) = 1; repeated rows count and are scored one by one. Columns other than the id
and the text are ignored.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.shared import mapped_dir, materialise
from tapeloom.llm.textbuf import LOWER, buffers, flat, mix64, pieces, span_hashes, words

END = np.uint64(0x5851F42D4C957F2D)
#: Contexts with more than one in so many tokens are spread over shards by pair: there are fewer than this of them.
SPREAD = 4096
#: Pairs that a task holds before it passes their counts on.
HELD = 2_000_000
SLICE = 2 << 20
#: Bytes of text behind a shard, about; a task has two of them.
SHARD_BYTES = 16 << 20


def tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of runs of rows (first, end): the word hashes of each text with END after it, end to end, and where each text's tokens begin.

    A long text is read part by part.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for lo, hi, data, offs, done in pieces(*buffers(flat(column)), SLICE):
        small = LOWER[data]
        starts, ends, row = words(small, offs)
        held.append((span_hashes(small, starts, ends), row))
        if done:
            hashed, row = (np.concatenate(x) for x in zip(*held, strict=True))
            held = []
            count = np.bincount(row, minlength=hi - lo) + 1
            begin = np.concatenate([[0], np.cumsum(count)])
            out = np.empty(begin[-1], np.uint64)
            out[np.arange(len(row)) + row] = hashed
            out[begin[1:] - 1] = END
            yield lo, hi, out, begin


def tally(values: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different values in order, and how often each is there."""
    order = np.argsort(values)
    values = values[order]
    first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    if counts is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


class Held:
    """Counts that wait until there are enough of them to be worth passing on."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.n = 0

    def add(self, values: np.ndarray) -> bool:
        self.parts.append(tally(values))
        self.n += len(self.parts[-1][0])
        return self.n >= HELD

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        out = tally(*(np.concatenate(x) for x in zip(*self.parts, strict=True))) if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.parts, self.n = [], 0
        return out


def save(path: str, array: np.ndarray) -> None:
    """Write whole or not at all, and the same again if the task is run again."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as out:
        np.save(out, array)
    os.replace(part, path)


def narrow(counts: np.ndarray) -> np.ndarray:
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


class Shards:
    """Sorted hash arrays, part by part, memory-mapped when first needed."""

    def __init__(self, folder: str, name: str, bits: int):
        self.folder, self.name, self.bits = folder, name, bits
        self.open: dict[tuple[int, str], np.ndarray | None] = {}

    def part(self, shard: int, what: str) -> np.ndarray | None:
        if (shard, what) not in self.open:
            path = f"{self.folder}/{self.name}-{shard:06d}-{what}.npy"
            self.open[shard, what] = np.load(path, mmap_mode="r") if os.path.exists(path) else None
        return self.open[shard, what]

    def write(self, hashes: np.ndarray, counts: np.ndarray, shard: np.ndarray) -> list[tuple[int, int, int]]:
        """(shard, keys, sum of counts) of each part written."""
        order = np.lexsort((hashes, shard))
        hashes, counts, shard = hashes[order], counts[order], shard[order]
        edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, int)
        out = []
        for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            k = int(shard[a])
            save(f"{self.folder}/{self.name}-{k:06d}-keys.npy", hashes[a:b])
            save(f"{self.folder}/{self.name}-{k:06d}-counts.npy", narrow(counts[a:b]))
            out.append((k, b - a, int(counts[a:b].sum())))
        return out

    def find(self, hashes: np.ndarray, shard: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, queries found in it, their places in it); queries come sorted by shard and hash."""
        edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, int)
        for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            keys = self.part(int(shard[a]), "keys")
            if keys is not None:
                at = np.searchsorted(keys, hashes[a:b])
                hit = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == hashes[a:b])
                yield int(shard[a]), a + hit, at[hit]


def top(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)


@dataclass(frozen=True)
class Layout:
    """Where the arrays are, and the numbers that go with them. vocabulary: words; each shard's first number is in a file."""

    folder: str
    bits: int
    vocabulary: int = 0
    total: int = 0
    texts: int = 0
    pair_discounts: tuple[float, float, float] = (0.0, 0.0, 0.0)
    unseen: float = 1.0

    @property
    def start(self) -> int:
        """The number of the context that begins a text; it follows those of the words."""
        return self.vocabulary


class Reader:
    """One worker's view of the arrays."""

    _open: dict[str, Reader] = {}

    def __init__(self, layout: Layout):
        self.layout = layout
        self.words, self.pairs = Shards(layout.folder, "words", layout.bits), Shards(layout.folder, "pairs", layout.bits)
        self.first = np.load(f"{layout.folder}/first.npy")
        self.hot = max(1, layout.total // SPREAD)

    @classmethod
    def of(cls, layout: Layout) -> Reader:
        if layout.folder not in cls._open or cls._open[layout.folder].layout != layout:
            cls._open[layout.folder] = cls(layout)
        return cls._open[layout.folder]

    def facts(self, number: np.ndarray, *names: str) -> list[np.ndarray]:
        """Values by word number, 0 where there are none: counts, p, gamma. The start of texts has a count and a gamma."""
        known, which = np.unique(number, return_inverse=True)
        out = [np.zeros(len(known)) for _ in names]
        lo, hi = np.searchsorted(known, [0, self.layout.vocabulary])
        shard = np.searchsorted(self.first, known[lo:hi], "right") - 1
        edge = lo + np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if hi > lo else np.array([lo])
        for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            k = int(shard[a - lo])
            for values, name in zip(out, names, strict=True):
                array = self.words.part(k, name)
                if array is not None:
                    values[a:b] = array[known[a:b] - self.first[k]]
        if hi < len(known):
            for values, name in zip(out, names, strict=True):
                array = self.words.part(1 << self.layout.bits, name)
                if name == "counts":
                    values[hi] = self.layout.texts
                elif array is not None:
                    values[hi] = array[0]
        return [values[which.reshape(-1)] for values in out]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for words outside the vocabulary."""
        known, which = np.unique(hashes, return_inverse=True)
        out = np.full(len(known), -1, np.int64)
        for shard, at, place in self.words.find(known, top(known, self.layout.bits)):
            out[at] = self.first[shard] + place
        return out[which.reshape(-1)]

    def contexts(self, number: np.ndarray, begin: np.ndarray) -> np.ndarray:
        out = np.empty_like(number)
        out[1:] = number[:-1]
        out[begin[:-1]] = self.layout.start
        return out

    def pair_shards(self, pair: np.ndarray) -> np.ndarray:
        before = pair >> 32
        hot = self.facts(before, "counts")[0] > self.hot
        return top(mix64(np.where(hot, pair, before).view(np.uint64) + np.uint64(1)), self.layout.bits)

    def pair_counts(self, pair: np.ndarray) -> np.ndarray:
        known, which = np.unique(pair, return_inverse=True)
        shard, hashed = self.pair_shards(known), mix64(known.view(np.uint64))
        order = np.lexsort((hashed, shard))
        found = np.zeros(len(known), np.int64)
        for k, at, place in self.pairs.find(hashed[order], shard[order]):
            found[order[at]] = self.pairs.part(k, "counts")[place]
        return found[which.reshape(-1)]


def _batch(names: str, kinds: tuple, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names.split())


def _count_words(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()

        def out():
            value, n = held.flush()
            return _batch("shard word n", (pa.int32(), pa.int64(), pa.int64()), top(value, bits).astype(np.int32), value.view(np.int64), n)

        for batch in batches:
            for _, _, hashed, _ in tokens(batch.column(0)):
                if held.add(hashed):
                    yield out()
        if held.n:
            yield out()

    return run


def _count_pairs(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, held = Reader.of(layout), Held()

        def out():
            value, n = held.flush()
            return _batch("shard pair n", (pa.int32(), pa.int64(), pa.int64()), reader.pair_shards(value).astype(np.int32), value, n)

        for batch in batches:
            for _, _, hashed, begin in tokens(batch.column(0)):
                number = reader.numbers(hashed)
                if held.add((reader.contexts(number, begin) << 32) | number):
                    yield out()
        if held.n:
            yield out()

    return run


def _gather(batches: Iterator[pa.RecordBatch], columns: int) -> list[np.ndarray]:
    parts = list(zip(*[[b.column(i).to_numpy() for i in range(columns)] for b in batches], strict=True))
    return [np.concatenate(p) for p in parts] if parts else [np.zeros(0, np.int64)] * columns


def _write_words(folder: str, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, word, n = _gather(batches, 3)
        rows = Shards(folder, "words", bits).write(word.view(np.uint64), n, shard)
        yield _batch("shard n total", (pa.int32(), pa.int64(), pa.int64()), *(zip(*rows, strict=True) if rows else ([], [], [])))

    return run


#: What pairs give, by the shard and number of a word: the pairs that it begins with a count of 1, 2 and more, and the
#: words before it. COUNTS in place of the shard: how many pairs have a count of 1, 2, 3 and 4, and how many there are.
COUNTS = -1
FACTS = "shard int, id long, x1 long, x2 long, x3 long, t long"


def _write_pairs(layout: Layout):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, pair, n = _gather(batches, 3)
        Shards(layout.folder, "pairs", layout.bits).write(mix64(pair.view(np.uint64)), n, shard)
        first = Reader.of(layout).first
        names, kinds = "shard id x1 x2 x3 t", (pa.int32(), *[pa.int64()] * 5)
        # the start of texts comes after all words, and has a shard of its own
        at = lambda number: np.where(number == layout.start, 1 << layout.bits, np.searchsorted(first, number, "right") - 1)
        none = lambda k: np.zeros(k, np.int64)
        context, which = np.unique(pair >> 32, return_inverse=True)
        by = [np.bincount(which[m], minlength=len(context)) for m in (n == 1, n == 2, n >= 3)]
        yield _batch(names, kinds, at(context), context, *by, none(len(context)))
        word, t = tally(pair & 0xFFFFFFFF)
        yield _batch(names, kinds, at(word), word, *[none(len(word))] * 3, t)
        yield _batch(names, kinds, np.full(5, COUNTS), np.arange(1, 6), [int((n == k).sum()) for k in (1, 2, 3, 4)] + [len(n)], *[none(5)] * 3)

    return run


def discounts(n1: float, n2: float, n3: float, n4: float) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts; where a count of counts is missing, one half of each count."""
    if not n1 or not n2:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(float(min(max(x, 0.0), k)) for k, x in enumerate(d, 1))


def _write_facts(layout: Layout, word_discounts: tuple[float, float, float], types: int):
    """p and gamma of the words of each shard, a file each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader.of(layout)
        d, e = layout.pair_discounts, np.array([0.0, *word_discounts])
        shard, at, x1, x2, x3, t = _gather(batches, 6)
        order = np.argsort(shard, kind="stable")
        shard, at, x1, x2, x3, t = (x[order] for x in (shard, at, x1, x2, x3, t))
        edge = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1], [True]])) if len(shard) else np.zeros(1, int)
        for a, b in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            k = int(shard[a])
            begin = k == 1 << layout.bits
            count = np.array([layout.texts]) if begin else reader.words.part(k, "counts")
            spot = at[a:b] - (layout.start if begin else reader.first[k])
            p, gamma = np.zeros(len(count)), np.zeros(len(count))
            gamma[spot] = (d[0] * x1[a:b] + d[1] * x2[a:b] + d[2] * x3[a:b]) / count[spot]
            own = t[a:b]
            p[spot] = np.where(own > 0, (own - e[np.minimum(own, 3)]) / types + layout.unseen, 0)
            for name, values in (("p", p), ("gamma", gamma)):
                save(f"{layout.folder}/words-{k:06d}-{name}.npy", values)
        yield _batch("done", (pa.int64(),), [len(at)])

    return run


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def train(texts: DataFrame) -> Layout:
    """Count and write a model of the texts (a column `text`)."""
    spark = texts.sparkSession
    folder = mapped_dir(spark, "kneser-ney")
    os.makedirs(folder)
    size = texts.agg(F.count("*").alias("texts"), F.sum(F.octet_length("text")).alias("bytes")).first()
    bits = max(4, int((size.bytes or 0) // SHARD_BYTES).bit_length())
    parts = 1 << bits >> 1
    counted = texts.select("text").mapInArrow(_count_words(bits), "shard int, word long, n long")
    summed = counted.repartition(parts, "shard").groupBy("shard", "word").agg(F.sum("n").alias("n"))
    sizes = {r.shard: r for r in summed.mapInArrow(_write_words(folder, bits), "shard int, n long, total long").collect()}  # a row a shard
    count = [sizes[k].n if k in sizes else 0 for k in range(1 << bits)]
    save(f"{folder}/first.npy", np.cumsum([0, *count])[:-1])
    layout = Layout(folder, bits, sum(count), sum(r.total for r in sizes.values()), size.texts)
    if layout.vocabulary >= 1 << 31:
        raise ValueError("pair keys hold word numbers of up to 31 bits")
    if not layout.texts:
        return layout
    counted = texts.select("text").mapInArrow(_count_pairs(layout), "shard int, pair long, n long")
    summed = counted.repartition(parts, "shard").groupBy("shard", "pair").agg(F.sum("n").alias("n"))
    facts = summed.mapInArrow(_write_pairs(layout), FACTS).groupBy("shard", "id").agg(*(F.sum(x).alias(x) for x in ("x1", "x2", "x3", "t")))
    facts = materialise(facts, "kneser-ney-facts")
    of = {r.id: r.x1 for r in facts.filter(F.col("shard") == COUNTS).collect()}
    own = facts.filter(F.col("shard") != COUNTS)
    t = own.agg(*(F.count_if(F.col("t") == k).alias(f"n{k}") for k in (1, 2, 3, 4)), F.count_if(F.col("t") >= 3).alias("more")).first()
    e = discounts(t.n1, t.n2, t.n3, t.n4)
    unseen = (e[0] * t.n1 + e[1] * t.n2 + e[2] * t.more) / of[5] / (layout.vocabulary + 1)
    layout = replace(layout, pair_discounts=discounts(of[1], of[2], of[3], of[4]), unseen=unseen)
    own.repartition(parts, "shard").mapInArrow(_write_facts(layout, e, of[5]), "done long").agg(F.sum("done")).collect()
    return layout


SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_texts(reader: Reader, hashed: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Tokens, known tokens, base score and score of each text."""
    layout = reader.layout
    number = reader.numbers(hashed)
    before = reader.contexts(number, begin)
    known = number >= 0
    # numbers and contexts together, in one pass over the shards
    count, one, gamma = (x.reshape(2, -1) for x in reader.facts(np.concatenate([number, before]), "counts", "p", "gamma"))
    count, times, one, gamma = count[0], np.maximum(count[1], 1), one[0], gamma[1]
    base = np.log10((count + 1) / (layout.total + layout.vocabulary + 1))
    p = np.where(known, one, layout.unseen)
    inside = before >= 0
    at = np.flatnonzero(inside & known)
    n = np.zeros(len(number), np.int64)
    n[at] = reader.pair_counts((before[at] << 32) | number[at])
    d = np.array([0.0, *layout.pair_discounts])[np.minimum(n, 3)]
    if layout.texts:
        p = np.where(inside, (n - d) / times + gamma * p, p)
    sums = lambda x: np.add.reduceat(x, begin[:-1])
    return [np.diff(begin), sums(known.astype(np.int64)), sums(base), sums(np.log10(p))]


def score(documents: DataFrame) -> DataFrame:
    """Every document's fold, tokens, base score and score under a model of those outside the fold."""
    texts = documents.select("doc_id", "text", held_out().alias("held_out"))
    layout = train(texts.filter(~F.col("held_out")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader.of(layout)
        for batch in batches:
            for lo, hi, hashed, begin in tokens(batch.column(1)):
                n, known, base, own = score_texts(reader, hashed, begin)
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], batch.column(2)[lo:hi], pa.array(n), pa.array(known), pa.array(np.full(hi - lo, layout.total)), pa.array(base), pa.array(own)], names=[x.split()[0] for x in SCORE_SCHEMA.split(", ")])

    return texts.withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SCORE_SCHEMA)
