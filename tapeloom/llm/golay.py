"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits: segments A and B of 23 and C of 18, itself two halves of 9. The binary Golay code
puts each 23-bit word within 3 of just one codeword. A word's own index is that codeword's; its fuzzy indices
are those of all codewords that a word one bit away may have, which are 1 (at a distance under 3) or 6. So of
two words one bit apart, the own index of either is among the fuzzy indices of the other.

Up to 3 errors fall on (A, B, C) in one of these ways, and each has a key of 30 bits or more:

    C without error, so one of A and B has at most one     C and fuzzy A; C and fuzzy B
    A without error, B at most one (or the other way)      A and fuzzy B; B and fuzzy A
    A without error, B two, C one (or the other way)       A and a half of C; B and a half of C
    one in each                                            fuzzy A and fuzzy B and a half of C

Distinct fingerprints are dealt by key; those that share one are compared exactly. Where many share a key, the
comparison yields links that span the same components instead of all pairs, and where too many do for a task,
they are compared in pairs of blocks.

Defined results: a null or blank text has fingerprint zero, linked like any other; rows of equal text or of
equal id are all returned; an empty table gives an empty result. Columns other than the id and the text are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.components import components
from tapeloom.llm.shared import materialise
from tapeloom.llm.textbuf import buffers, flat, mix64, pieces

SEED = 42
WORDS = 3
MAX_BITS = 3
#: The Golay code's generator polynomial.
GENERATOR = 0b101011100011
#: Rows of a key that are compared pair by pair; above, links span components.
FEW = 64
#: Rows of a key in one block of a task.
MANY = 4096
COUNTERS = 1 << 16
#: Keys of a task, about; there are as many tasks as the keys ask for, and no fewer than the session's partitions.
TASK_ROWS = 2_000_000


def _remainder(words: np.ndarray) -> np.ndarray:
    r = words.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (GENERATOR << (bit - 11)), r)
    return r


def _patterns() -> np.ndarray:
    """By syndrome: 6 error patterns that lead to codewords, the nearest first; unused places repeat it."""
    out = np.full((2048, 6), -1, np.int64)
    for weight in range(5):
        errors = np.array([sum(1 << i for i in c) for c in combinations(range(23), weight)], np.int64)
        for e, s in zip(errors.tolist(), _remainder(errors).tolist(), strict=True):
            if weight < 4:
                out[s, 0] = e
            elif int(out[s, 0]).bit_count() == 3:
                out[s, int(np.argmax(out[s] < 0))] = e
    return np.where(out < 0, out[:, :1], out)


PATTERNS = _patterns()
#: The syndrome is linear: that of a word is that of its low 12 bits plus that of its high 11.
LOW_SYNDROME, HIGH_SYNDROME = _remainder(np.arange(1 << 12)), _remainder(np.arange(1 << 11) << 12)


def indices(words: np.ndarray) -> np.ndarray:
    """The 12-bit codeword indices of 23-bit words, 6 each: the own one first, repeated where there is no other."""
    return (words[:, None] ^ PATTERNS[LOW_SYNDROME[words & 4095] ^ HIGH_SYNDROME[words >> 12]]) >> 11


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, role): any two prints within 3 bits have a key in common, one with role 1 set and the other with 2."""
    p = prints.view(np.uint64)
    a, b, c = ((p >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18)))
    fuzzy_a, fuzzy_b = indices(a), indices(b)
    low, high = c & 511, c >> 9
    row, key, role = [], [], []
    one = np.arange(len(p))

    def add(kind: int, values: np.ndarray, role_own: int, role_rest: int) -> None:
        """values: a column per index, the own one first; repeats of it are left out."""
        values = values if values.ndim == 2 else values[:, None]
        use = np.ones(values.shape, bool)
        use[:, 1:] = values[:, 1:] != values[:, :1]
        r, k = np.nonzero(use)
        row.append(one[r])
        key.append((kind << 58) | values[r, k])
        role.append(np.where(k == 0, role_own, role_rest).astype(np.int8))

    add(0, (c[:, None] << 12) | fuzzy_a, 3, 2)
    add(1, (c[:, None] << 12) | fuzzy_b, 3, 2)
    add(2, (a[:, None] << 12) | fuzzy_b, 3, 2)
    add(3, (b[:, None] << 12) | fuzzy_a, 3, 2)
    for kind, half in ((4, low), (5, high)):
        add(kind, (a << 9) | half, 3, 3)
        add(kind + 2, (b << 9) | half, 3, 3)
        # own index of A with fuzzy ones of B, against fuzzy ones of A with the own index of B
        add(kind + 4, (fuzzy_a[:, :1] << 21) | (fuzzy_b << 9) | half[:, None], 3, 1)
        add(kind + 4, (fuzzy_a << 21) | (fuzzy_b[:, :1] << 9) | half[:, None], 3, 2)
    return np.concatenate(row), np.concatenate(key), np.concatenate(role)


def _shingles(column: pa.Array, words: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of runs of rows: the hashes of their lower-cased texts' word shingles, repeats included, and how many each row has.

    A long text is split part by part, each with the last words of the one before it; its hashes come together.
    """
    digest = xxhash.xxh64_intdigest
    held: list[np.ndarray] = []
    tail: list[bytes] = []
    some = False
    for lo, hi, data, offs, done in pieces(*buffers(flat(column))):
        blob, hashes, counts = data.tobytes().lower(), [], []
        bounds = offs.tolist()
        for a, b in zip(bounds, bounds[1:], strict=False):
            parts = tail + blob[a:b].split()
            n = len(parts)
            if n >= words:
                joined = b" ".join(parts)
                begin = np.zeros(n + 1, np.int64)
                np.cumsum([len(x) + 1 for x in parts], out=begin[1:])
                begin = begin.tolist()
                hashes += [digest(joined[s : e - 1], seed) for s, e in zip(begin, begin[words:], strict=False)]
                counts.append(n - words + 1)
                tail, some = parts[n - words + 1 :], True
            else:
                tail = parts
                if done and n and not some:
                    hashes.append(digest(b" ".join(parts), seed))
                counts.append(int(done and n > 0 and not some))
            if done:
                tail, some = [], False
        held.append(np.array(hashes, "<u8"))
        if done:
            found = np.concatenate(held)
            # of a text in parts, the last count stands for all of it
            yield found, np.array(counts if len(held) == 1 else [len(found)], np.int64)
            held = []


#: Hashes whose bits are laid out at once.
UNPACKED = 1 << 17


def fingerprint_column(column: pa.Array, words: int = WORDS, seed: int = SEED) -> Iterator[np.ndarray]:
    """The fingerprints of runs of rows: a bit is set if it is in over half of the shingles' hashes."""
    for hashed, count in _shingles(column, words, seed):
        yield majority(hashed, count)


def majority(hashed: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The fingerprint of each row's hashes, of which it has `count`."""
    sums, row = np.zeros((len(count), 64), np.int64), np.repeat(np.arange(len(count)), count)
    for lo in range(0, len(hashed), UNPACKED):
        bits = np.unpackbits(hashed[lo : lo + UNPACKED].view(np.uint8), bitorder="little").reshape(-1, 64)
        own = row[lo : lo + UNPACKED]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        sums[own[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    return np.packbits(2 * sums > count[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id and print: the 64-bit SimHash of the lower-cased text's word shingles, repeats included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for prints in fingerprint_column(batch.column(1), words, seed):
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(prints)], pa.array(prints.view(np.int64))], names=["doc_id", "print"])
                at += len(prints)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text")).mapInArrow(run, "doc_id long, print long")


def _counter(key: np.ndarray) -> np.ndarray:
    return (mix64(key.view(np.uint64)) >> np.uint64(48)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for lo in range(0, batch.num_rows, 20_000):
            _, key, _ = keys(batch.column(0)[lo : lo + 20_000].to_numpy())
            total += np.bincount(_counter(key), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["counter", "n"])


def _deal(blocks: np.ndarray):
    """Rows (deal, print, role); where a key's counter has several blocks, a row goes to each pair with its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 20_000):
                prints = batch.column(0)[lo : lo + 20_000].to_numpy()
                row, key, role = keys(prints)
                deal = mix64(key.view(np.uint64))
                n = blocks[_counter(key)]
                own = (mix64(prints.view(np.uint64)[row]) % n.astype(np.uint64)).astype(np.int64)
                copy = np.repeat(np.arange(len(row)), n)
                other = np.arange(len(copy)) - np.repeat(np.cumsum(n) - n, n)
                first, second = np.minimum(own[copy], other), np.maximum(own[copy], other)
                deal = np.where(n[copy] > 1, mix64(deal[copy] + (first * 1_000_003 + second + 1).astype(np.uint64)), deal[copy])
                yield pa.RecordBatch.from_arrays([pa.array(deal.view(np.int64)), pa.array(prints[row[copy]]), pa.array(role[copy])], names=["deal", "print", "role"])

    return run


def _spanning(prints: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links from a first print to all others of its component within these prints, whatever their roles."""
    left = np.unique(prints)
    ends_a, ends_b = [], []
    while len(left) > 1:
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for lo in range(0, len(front), 64):
                rest = np.flatnonzero(~hit)
                hit[rest] = (np.bitwise_count(front[lo : lo + 64, None] ^ left[None, rest]) <= max_bits).any(0)
            front, left = left[hit], left[~hit]
            ends_a.append(np.full(len(front), root, np.uint64))
            ends_b.append(front)
    none = np.zeros(0, np.uint64)
    return np.concatenate(ends_a or [none]), np.concatenate(ends_b or [none])


def _links(max_bits: int):
    def of_runs(deal: np.ndarray, prints: np.ndarray, role: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        edge = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1], [True]]))
        size = np.diff(edge)
        out_a, out_b = [], []
        for k in np.flatnonzero(size > FEW).tolist():
            a, b = _spanning(prints[edge[k] : edge[k + 1]], max_bits)
            out_a.append(a)
            out_b.append(b)
        few = np.repeat((size > 1) & (size <= FEW), size)
        end = np.repeat(edge[1:], size)
        for ahead in range(1, FEW):
            i = np.flatnonzero(few[: len(deal) - ahead] & (np.arange(len(deal) - ahead) + ahead < end[: len(deal) - ahead]))
            if not len(i):
                break
            j = i + ahead
            met = (((role[i] & 1) > 0) & ((role[j] & 2) > 0)) | (((role[i] & 2) > 0) & ((role[j] & 1) > 0))
            met &= (np.bitwise_count(prints[i] ^ prints[j]) <= max_bits) & (prints[i] != prints[j])
            out_a.append(prints[i[met]])
            out_b.append(prints[j[met]])
        return np.concatenate(out_a or [np.zeros(0, np.uint64)]), np.concatenate(out_b or [np.zeros(0, np.uint64)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in _ended(batches):
            if batch is not None:
                fresh = [batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()]
                held = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh, strict=True)]
                cut = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
            else:
                cut = len(held[0]) if held is not None else 0
            if not cut:
                continue
            a, b = of_runs(*(x[:cut] for x in held))
            held = [x[cut:] for x in held]
            low, high = np.minimum(a, b).view(np.int64), np.maximum(a, b).view(np.int64)
            pairs = np.unique(np.column_stack([low, high]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct prints -> pairs (a, b) within max_bits that connect all prints that are connected by such pairs.

    max_bits is 3 at most: that is what the keys make sure of.
    """
    if max_bits > 3:
        raise ValueError("keys find pairs of up to 3 differing bits")
    spark = prints.sparkSession
    counts = prints.mapInArrow(_count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    mean = counts.agg(F.sum("n") / COUNTERS).first()[0] or 0
    blocks = np.ones(COUNTERS, np.int64)
    for r in counts.filter(F.col("n") > mean + MANY).collect():  # COUNTERS rows at most
        blocks[r.counter] = -(-int(r.n - mean) // MANY) + (int(r.n - mean) > MANY)
    dealt = prints.mapInArrow(_deal(blocks), "deal long, print long, role byte")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(mean * COUNTERS) // TASK_ROWS))
    return dealt.repartition(parts, "deal").sortWithinPartitions("deal").mapInArrow(_links(max_bits), "a long, b long").distinct()


def groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, print -> those and component_id, the least doc_id that links lead to."""
    least = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("least")), "golay-prints")
    found = components(links(least.select("print"), max_bits))
    rooted = least.join(found.withColumnRenamed("node", "print"), "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(component, "root").select("print", "component_id")
    return prints.join(ids, "print").select("doc_id", "print", "component_id")


def simhash_query(documents: DataFrame) -> DataFrame:
    prints = materialise(fingerprints(documents), "golay-documents")
    return groups(prints).select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


# Near-duplicates by likeness: texts alike in four fifths of their distinct five-word shingles, by the exact count.
# Those whose SimHash of the shingles differs in 3 bits at most are found by the Golay keys, all of them. Texts at
# four fifths differ in more bits than the code corrects, so the rest is looked for by least hashes of the
# shingles: a text has a key for each of 25 bands of 5, and two texts that share four fifths have one in common
# but for a chance of 5 in 100,000. What may be alike by either gathers in clusters (by least hashes: by two bits of
# each); in a cluster all pairs are held against each other by their shingles, and only links that hold are thinned.
LIKE_WORDS = 5
BANDS, BAND = 25, 5
#: Least hashes of a text; each leaves two bits in the sketch.
LEAST = 128
SKETCH = LEAST // 32
#: Differing pairs of bits, of 128: 19 are due where four fifths are shared, with a deviation of 4.
APART = 36
#: Shingles of a cluster in one block of a task.
CROWD = 1 << 20
#: Rows of (cluster, blocks) that are broadcast, 16 bytes each; more are joined by a shuffle.
FEW_CROWDED = 500_000
_PAIRS = np.uint64(0x5555555555555555)
_XOR, _TIMES = (np.random.default_rng(SEED).integers(0, 1 << 32, (2, LEAST), dtype=np.uint64) | np.array([[0], [1]], np.uint64)).astype(np.uint32)


def _sets(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of slices of rows: each row's distinct shingle hashes in order, how many they are, and a hash of all of them."""
    for hashed, count in _shingles(column, LIKE_WORDS, SEED):
        row = np.repeat(np.arange(len(count)), count)
        order = np.lexsort((hashed, row))
        hashed, row = hashed[order], row[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (hashed[1:] != hashed[:-1])
        hashed, count = hashed[new], np.bincount(row[new], minlength=len(count))
        node, full = np.zeros(len(count), np.uint64), count > 0
        if len(hashed):
            node[full] = mix64(np.add.reduceat(mix64(hashed ^ np.uint64(SEED)), (np.cumsum(count) - count)[full]) + count[full].astype(np.uint64))
        yield hashed, count, node


_NAMES = ["doc_id", "node", "size", "print", *(f"s{k}" for k in range(SKETCH)), *(f"b{k}" for k in range(BANDS))]


def sketches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node (a hash of the set of shingles), size (how many), print (their SimHash), the sketch s0 .. s3, the band keys b0 .. b24 and said, a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for hashed, count, node in _sets(batch.column(1)):
                full, least = count > 0, np.zeros((LEAST, len(count)), np.uint32)
                if len(hashed):
                    short, first = (hashed >> np.uint64(32)).astype(np.uint32), (np.cumsum(count) - count)[full]
                    for k in range(LEAST):
                        least[k, full] = np.minimum.reduceat((short ^ _XOR[k]) * _TIMES[k], first)
                wide = mix64(least.astype(np.uint64))
                bits = (wide & np.uint64(3)).reshape(SKETCH, 32, -1) << np.arange(0, 64, 2, dtype=np.uint64)[None, :, None]
                sketch = np.bitwise_or.reduce(bits, axis=1)
                bands = []
                for k in range(BANDS):
                    own = np.full(len(count), k, np.uint64)
                    for x in wide[k * BAND : (k + 1) * BAND]:
                        own = mix64(own * np.uint64(0x9E3779B97F4A7C15) + x)
                    bands.append(own)
                columns = (pa.array(x.view(np.int64)) for x in (node, count, majority(hashed, count), *sketch, *bands))
                yield pa.RecordBatch.from_arrays([batch.column(0)[at : at + len(node)], *columns, batch.column(2)[at : at + len(node)]], names=[*_NAMES, "said"])
                at += len(node)

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].alias("text"), F.xxhash64(df[text_col]).alias("said")).mapInArrow(run, ", ".join(f"{x} long" for x in [*_NAMES, "said"]))


def _like_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(COUNTERS, np.int64)
    for batch in batches:
        for deal in batch.columns[1 + SKETCH :]:
            total += np.bincount(_counter(deal.to_numpy()), minlength=COUNTERS)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["counter", "n"])


def _like_keys(blocks: np.ndarray):
    """Rows (deal, node, s0 .. s3), one for each band of a text; where a key's counter has several blocks, one for each pair with the text's own."""
    names = ["deal", "node", *(f"s{k}" for k in range(SKETCH))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, *sketch = (c.to_numpy() for c in batch.columns[: 1 + SKETCH])
            for column in batch.columns[1 + SKETCH :]:
                key = column.to_numpy()
                row, deal = _in_blocks(key, mix64(node.view(np.uint64)), blocks[_counter(key)])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (deal, node[row], *(c[row] for c in sketch))], names=names)

    return run


def _in_blocks(key: np.ndarray, salt: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, deal): of n blocks of a key, a row is in the one that its salt names, and goes to each pair of it with another."""
    own = (salt % n.astype(np.uint64)).astype(np.int64)
    row = np.repeat(np.arange(len(key)), n)
    other = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    row, other = (x[(n[row] == 1) | (other != own[row])] for x in (row, other))
    first, second = np.minimum(own[row], other), np.maximum(own[row], other)
    deal = mix64(key.view(np.uint64)[row])
    deal = np.where(n[row] > 1, mix64(deal + (first * 1_000_003 + second + 1).astype(np.uint64)), deal)
    return row, deal.view(np.int64)


def _near(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether sketches, in rows, may be of texts that are alike."""
    d = x ^ y
    return np.bitwise_count((d | d >> np.uint64(1)) & _PAIRS).sum(-1, dtype=np.int64) <= APART


def _like_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of their key and node: of all pairs that may be alike, those that span the same clusters."""
    held = None
    for batch in _ended(batches):
        if batch is not None:
            fresh = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.column_stack([c.to_numpy().view(np.uint64) for c in batch.columns[2:]])]
            held = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
        else:
            cut = len(held[0]) if held is not None else 0
        if not cut:
            continue
        deal, node, glances = (x[:cut] for x in held)
        held = [x[cut:] for x in held]
        edge = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1], [True]]))
        size = np.diff(edge)
        few, end, at = np.repeat(size <= FEW, size), np.repeat(edge[1:], size), np.arange(len(deal))
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for ahead in range(1, FEW):
            i = np.flatnonzero((at + ahead < end) & few)
            if not len(i):
                break
            i = i[_near(glances[i], glances[i + ahead])]
            left.append(i)
            right.append(i + ahead)
        i, j = _forest(np.concatenate(left), np.concatenate(right))
        left, right = [i], [j]
        for k in np.flatnonzero(size > FEW).tolist():
            i, j = _tree(glances[edge[k] : edge[k + 1]])
            left.append(edge[k] + i)
            right.append(edge[k] + j)
        i, j = np.concatenate(left), np.concatenate(right)
        met = node[i] != node[j]
        pairs = np.unique(np.column_stack([np.minimum(node[i], node[j])[met], np.maximum(node[i], node[j])[met]]), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _forest(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the pairs, in order, that join what was apart: a row's own run only, as pairs are of one run."""
    order = np.lexsort((j, i))
    up: dict[int, int] = {}
    keep = []
    for n, x, y in zip(order.tolist(), i[order].tolist(), j[order].tolist(), strict=True):
        while x in up:
            x = up[x]
        while y in up:
            y = up[y]
        if x != y:
            up[max(x, y)] = min(x, y)
            keep.append(n)
    return i[keep], j[keep]


def _tree(glances: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what pairs that may be alike connect: from each row, in order, to all that none before it reached."""
    parent, child = [], []
    rest = np.arange(len(glances))
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            x = front.pop(0)
            near = _near(glances[x], glances[rest])
            front += rest[near].tolist()
            parent.append(np.full(int(near.sum()), x))
            child.append(rest[near])
            rest = rest[~near]
    return (np.concatenate(parent), np.concatenate(child)) if parent else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _alike(hashed: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that span what pairs of sets alike in four fifths connect: from each set, in order, to all that none before it reached."""
    short = np.unique(hashed, return_inverse=True)[1]
    first = np.cumsum(count) - count
    marked, left = np.zeros(len(hashed), bool), np.ones(len(count), bool)
    parent, child = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for root in range(len(count)):
        if not left[root]:
            continue
        left[root] = False
        front = [root]
        while front and left.any():
            x = front.pop(0)
            own = short[first[x] : first[x] + count[x]]
            marked[own] = True
            both = np.add.reduceat(marked[short], first, dtype=np.int64)
            marked[own] = False
            # both / (either) of 4/5 or more
            near = np.flatnonzero(left & (9 * both >= 4 * (count + count[x])))
            left[near] = False
            front += near.tolist()
            parent.append(np.full(len(near), x))
            child.append(near)
    return np.concatenate(parent), np.concatenate(child)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (deal, node, text), in order of deal and node -> links between nodes of a deal that are alike by their shingles."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)]
    for batch in _ended(batches):
        if batch is not None:
            parts = list(_sets(batch.column(2)))
            if not parts:
                continue
            hashed, count, found = (np.concatenate(x) for x in zip(*parts, strict=True))
            deal, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            # other texts of the same id, and repeats, aren't the node's
            use = (found.view(np.int64) == node) & (count > 0)
            use[1:] &= (deal[1:] != deal[:-1]) | (node[1:] != node[:-1])
            fresh = [deal[use], node[use], count[use], hashed[np.repeat(use, count)]]
            held = [np.concatenate(x) for x in zip(held, fresh, strict=True)]
            cut = int(np.searchsorted(held[0], held[0][-1], "left")) if len(held[0]) else 0
        else:
            cut = len(held[0])
        if not cut:
            continue
        deal, node, count = (x[:cut] for x in held[:3])
        till = int(count.sum())
        hashed, held = held[3][:till], [*(x[cut:] for x in held[:3]), held[3][till:]]
        edge = np.flatnonzero(np.concatenate([[True], deal[1:] != deal[:-1], [True]]))
        at = np.concatenate([[0], np.cumsum(count)])
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            if hi - lo > 1:
                i, j = _alike(hashed[at[lo] : at[hi]], count[lo:hi])
                left.append(node[lo + i])
                right.append(node[lo + j])
        a, b = np.concatenate(left), np.concatenate(right)
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _cluster_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, least, said, root, blocks) -> (node, least, said, deal)."""
    for batch in batches:
        node, root, blocks = (batch.column(i).to_numpy() for i in (0, 3, 4))
        row, deal = _in_blocks(root, mix64(node.view(np.uint64)), blocks)
        yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(row)) for i in range(3)), pa.array(deal)], names=["node", "least", "said", "deal"])


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (deal, node, text) without those that a task has passed on before: repeated rows of a document."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        pairs = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        fresh = [not (p in seen or seen.add(p)) for p in pairs]
        yield batch if all(fresh) else batch.filter(pa.array(fresh))


def golay_pairs(nodes: DataFrame) -> DataFrame:
    """node, print -> pairs (a, b) of nodes that connect all whose prints are connected by pairs of 3 differing bits at most.

    The least node of a print stands for it in links between prints, and is linked to the print's other nodes.
    """
    firsts = materialise(nodes.groupBy("print").agg(F.min("node").alias("first"), F.count("*").alias("n")), "golay-firsts")
    stand = lambda print_, node: firsts.select(F.col("print").alias(print_), F.col("first").alias(node))
    between = links(firsts.select("print")).join(stand("a", "x"), "a").join(stand("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    within = nodes.select("node", "print").join(firsts.filter("n > 1"), "print").filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return between.union(within)


def like_groups(documents: DataFrame) -> DataFrame:
    """doc_id and component_id, the least id that links lead to: texts alike in four fifths of their five-word shingles.

    Texts that may be alike, by the Golay keys of their prints or by least hashes, are gathered in clusters by a forest of their pairs, which no link is read from: all pairs
    of a cluster are then held against each other by their shingles, and of those that hold, a forest is passed on.

    Equal sets of shingles are one node, for which one text stands: that of the least id, and of several texts under this id
    that of the least hash. It is found again by both, so that neither repeated ids nor rows without an id multiply.
    """
    spark = documents.sparkSession
    sketch = materialise(sketches(documents), "like-sketches")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), F.col("doc_id").alias("least"), "said")).alias("first")
    nodes = sketch.groupBy("node").agg(first, *(F.first(c).alias(c) for c in _NAMES[2:]))
    nodes = materialise(nodes.select("node", "first.least", "first.said", *_NAMES[2:]), "like-nodes")
    schema = ", ".join(f"{x} long" for x in ("deal", "node", *(f"s{k}" for k in range(SKETCH))))
    keyed = nodes.filter("size > 0").select("node", *_NAMES[4:])
    counts = keyed.mapInArrow(_like_count, "counter long, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    mean = counts.agg(F.sum("n") / COUNTERS).first()[0] or 0
    blocks = np.ones(COUNTERS, np.int64)
    for r in counts.filter(F.col("n") > mean + MANY).collect():  # COUNTERS rows at most
        blocks[r.counter] = -(-int(r.n - mean) // MANY) + 1
    rows = keyed.mapInArrow(_like_keys(blocks), schema)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(mean * COUNTERS) // TASK_ROWS))
    pairs = rows.repartition(parts, "deal").sortWithinPartitions("deal", "node").mapInArrow(_like_pairs, "a long, b long").distinct()
    pairs = materialise(pairs.unionByName(golay_pairs(nodes.filter("size > 0"))), "like-pairs")
    joined = components(pairs).join(nodes.select("node", "least", "said", "size"), "node")
    clusters = materialise(joined.select("node", "least", "said", "root", "size"), "like-clusters")
    # a row for each CROWD shingles at most
    crowded = clusters.groupBy("root").agg(F.sum("size").alias("n")).filter(F.col("n") > CROWD).select("root", (F.ceil(F.col("n") / CROWD) + 1).alias("blocks"))
    crowded = materialise(crowded, "like-crowded")
    crowded = F.broadcast(crowded) if crowded.count() <= FEW_CROWDED else crowded
    dealt = clusters.join(crowded, "root", "left").select("node", "least", "said", "root", F.coalesce("blocks", F.lit(1)).cast("long").alias("blocks"))
    clusters = dealt.mapInArrow(_cluster_blocks, "node long, least long, said long, deal long")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("own"))
    dealt = texts.join(clusters, (texts.own == clusters.said) & texts.doc_id.eqNullSafe(clusters.least)).select("deal", "node", "text")
    dealt = dealt.mapInArrow(_once, "deal long, node long, text string")
    edges = materialise(dealt.repartition(parts, "deal").sortWithinPartitions("deal", "node").mapInArrow(_verified, "a long, b long"), "likeness")
    found = components(edges)
    rooted = nodes.select("node", "least").join(found, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    component = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = rooted.join(component, "root").select("node", "component_id")
    return sketch.select("doc_id", "node").join(ids, "node").select("doc_id", "component_id")


def without_copies(documents: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id, and one row of each id, as it is.

    Of several rows of an id that stays, that of the least hash of all its columns is kept. Documents without an id can't stand
    for a group, nor be told from others by it: they stay, and take no part in the search.
    """
    known = documents.filter(F.col("doc_id").isNotNull())
    keep = like_groups(known).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("golay_kept")).distinct()
    kept = known.join(keep, F.col("doc_id") == F.col("golay_kept"), "left_semi")
    plain = [f.name for f in documents.schema if "map<" not in f.dataType.simpleString()]
    one = kept.groupBy(F.col("doc_id").alias("golay_id")).agg(F.min_by(F.struct(*kept.columns), F.xxhash64(*plain)).alias("golay_row")).select("golay_row.*")
    return one.unionByName(documents.filter(F.col("doc_id").isNull()))
