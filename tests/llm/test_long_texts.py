"""Very long texts: the same results as by plain means, in time and memory that go with their length."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from samples import words

from tapeloom.llm import audio, automaton, digest, golay, kneserney, textbuf, toxicity

MB = 1 << 20


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(11)
    return " ".join([words(rng, 20_000)] * 60)


def peak(f):
    tracemalloc.start()
    out = f()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, most


def test_pieces_part_no_word(long_text):
    data, offs = textbuf.buffers(pa.array(["a b", long_text, "", "x" * (3 * MB), "c"]))
    rows = {}
    for lo, hi, part, bounds, done in textbuf.pieces(data, offs):
        assert len(part) <= MB + 4096 or hi - lo == 1
        for r in range(lo, hi):
            rows.setdefault(r, []).append(part[bounds[r - lo] : bounds[r - lo + 1]].tobytes())
    assert [b"".join(rows.get(i, [b""])) for i in range(5)] == [b"a b", long_text.encode(), b"", b"x" * (3 * MB), b"c"]
    assert [w for p in rows[1] for w in p.split()] == long_text.encode().split()


def test_many_secrets_take_linear_time():
    text = "é token = abcdefgh12 " * 200_000
    found = dict(kv for _, _, f in automaton.scan_column(pa.array([text])) for kv in f.items())[0]
    assert len(found) == 200_000
    at = [m.span() for m in re.finditer("token = abcdefgh12", text[:1000])]
    assert [(a, b) for a, b, _ in found[: len(at)]] == at and found[-1][1] == len(text) - 1


def test_automaton_blocks_carry_their_state(monkeypatch):
    text = "x" * 3000 + "AKIA" + "Q" * 9000 + " y " + "0123456789abcdef" * 500
    whole = automaton.scan_column(pa.array([text])).__next__()[2]
    monkeypatch.setattr(automaton, "BLOCK", 1000)
    assert automaton.scan_column(pa.array([text])).__next__()[2] == whole and len(whole[0]) == 2


def test_likeness_in_blocks():
    rng = np.random.default_rng(0)
    a, b = (rng.integers(0, 256, (n, digest.BITS // 8), dtype=np.uint8) for n in (2000, 2500))
    value, most = peak(lambda: digest.likeness((a, 9), (b, 9)))
    i = rng.integers(0, 2000, 5)
    shared = np.bitwise_count(a[i][:, None] & b[None]).sum(2, dtype=np.int64)
    assert 0 <= value <= 1 and most < 200 * MB and shared.shape == (5, 2500)


def test_simhash_of_a_long_text(long_text):
    (value,), most = peak(lambda: np.concatenate(list(golay.fingerprint_column(pa.array([long_text])))))
    count, n = np.zeros(64, np.int64), 0
    w = long_text.encode().split()
    # the text is 60 times one part: its shingles are those of the part, and the two over each seam
    import xxhash

    part = w[:20_000]
    hashes = [xxhash.xxh64_intdigest(b" ".join(part[i : i + 3]), 42) for i in range(len(part) - 2)]
    seam = [xxhash.xxh64_intdigest(b" ".join((part + part)[i : i + 3]), 42) for i in (19_998, 19_999)]
    for values, times in ((hashes, 60), (seam, 59)):
        bits = np.unpackbits(np.array(values, "<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        count += times * bits.sum(0, dtype=np.int64)
        n += times * len(values)
    assert int(value) == sum(1 << k for k in range(64) if 2 * count[k] > n)
    assert most < 45 * len(long_text)


def test_audio_in_steps(monkeypatch):
    front = audio.Frontend(audio.STORED_RATE, audio.RATE)
    samples = np.random.default_rng(1).integers(0, 256, 200_000).astype(np.uint8)
    whole = front.bands(samples)
    monkeypatch.setattr(audio, "STEP", 64)
    parts = front.bands(samples)
    assert np.abs(whole[0] - parts[0]).max() <= 1 / audio.GRAIN and np.allclose(whole[1], parts[1], atol=1e-3)
    monkeypatch.undo()
    _, most = peak(lambda: front.bands(np.resize(samples, 20 * MB)))
    assert most < 200 * MB


def test_toxicity_and_tokens_of_a_long_text(long_text, monkeypatch):
    table = np.random.default_rng(2).normal(size=toxicity.BUCKETS).astype(np.float32)
    column = pa.array(["short one", long_text])
    tokens = [x[2:] for x in kneserney.tokens(column)]
    score = toxicity.scores(table, 0.1, column)
    monkeypatch.setattr(toxicity, "pieces", lambda data, offs, size=0: textbuf.pieces(data, offs, 1 << 30))
    monkeypatch.setattr(kneserney, "SLICE", 1 << 30)
    np.testing.assert_allclose(toxicity.scores(table, 0.1, column), score)
    (once,) = kneserney.tokens(column)
    assert np.concatenate([t[0] for t in tokens]).tolist() == once[2].tolist()
