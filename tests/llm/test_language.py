"""Language identification: marginals against enumeration, and held-out accuracy."""

import itertools
import random
import zlib

import numpy as np
from samples import words

from tapeloom.llm import language

SYLLABLES = {"en": ("the", "ing", "and", "wh", "sh"), "de": ("ung", "sch", "keit", "der", "ver"), "fr": ("eau", "ment", "que", "oi", "les")}


def test_marginals_are_those_of_enumeration():
    rng = np.random.default_rng(0)
    emission, steps = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    got = language.marginals(emission, steps, np.arange(5)[:, None], np.ones((5, 1), bool))[:, 0]
    want = np.zeros((5, 3))
    for path in itertools.product(range(3), repeat=5):
        weight = np.exp(sum(emission[i, k] for i, k in enumerate(path)) + sum(steps[a, b] for a, b in itertools.pairwise(path)))
        for i, k in enumerate(path):
            want[i, k] += weight
    np.testing.assert_allclose(got, want / want.sum(1, keepdims=True), atol=1e-9)


def chain(rng, n, k):
    return rng.normal(size=(n, k)), rng.normal(size=(k, k))


def test_expected_transitions_are_those_of_enumeration():
    """And so is the gradient of the logarithm of all paths' weight, by differences."""
    emission, steps = chain(np.random.default_rng(5), 6, 3)
    moves = np.zeros((3, 3))
    language.marginals(emission, steps, np.arange(6)[:, None], np.ones((6, 1), bool), moves=moves)
    weigh = lambda s: {p: np.exp(sum(emission[i, k] for i, k in enumerate(p)) + sum(s[a, b] for a, b in itertools.pairwise(p))) for p in itertools.product(range(3), repeat=6)}
    want, weights = np.zeros((3, 3)), weigh(steps)
    for path, weight in weights.items():
        for a, b in itertools.pairwise(path):
            want[a, b] += weight
    np.testing.assert_allclose(moves, want / sum(weights.values()), atol=1e-9)
    for a, b in ((0, 2), (2, 2)):
        more = steps.copy()
        more[a, b] += 1e-5
        slope = (np.log(sum(weigh(more).values())) - np.log(sum(weights.values()))) / 1e-5
        assert abs(slope - moves[a, b]) < 1e-3


def test_blocks_do_not_change_the_marginals(monkeypatch):
    rng = np.random.default_rng(6)
    size = [700, 0, 3, 128, 129, 300, 1]
    emission, steps = chain(rng, sum(size), 4)
    row = np.repeat(np.arange(len(size)), size)
    field = language.Field(list("abcd"), None, None, None, None, steps)
    results = []
    for block in (1, 7, 128, 1000):
        monkeypatch.setattr(language, "BLOCK", block)
        results.append(language.label_words(field, emission, row, len(size))[0])
    for other in results[:-1]:
        np.testing.assert_allclose(other, results[-1], atol=1e-6)


def test_long_texts_are_those_of_their_parts(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, 50, SYLLABLES[lang]), lang) for i, lang in enumerate(["en", "de"] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = language.fit(*language.sample(docs))
    text = words(rng, 300_000, SYLLABLES["en"])
    assert len(text) > 1 << 20
    (_, _, row, p, sums), = language.labelled(field, language.pa.array([text]))
    assert len(row) == 300_000 and sums[0].argmax() == field.labels.index("en") and np.allclose(p.sum(1), 1, atol=1e-4)


def test_held_out_accuracy_and_switches(spark):
    rng = random.Random(2)
    rows = [(i, words(rng, rng.randint(5, 400), SYLLABLES[lang]), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(400))]
    rows += [(1000, words(rng, 60, SYLLABLES["en"]) + " " + words(rng, 60, SYLLABLES["de"]), None), (1001, "123 456", None), (1002, None, "en"), (1003, "漢字", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in language.predict(docs).collect()}
    held = [(i, lang) for i, _, lang in rows if i < 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(out[i].held_out for i, _ in held)
    assert np.mean([out[i].lang_pred == lang for i, lang in held]) > 0.97
    assert out[1001].lang_pred == out[1002].lang_pred == "und" and out[1003].lang_pred in SYLLABLES
    spans = {r.doc_id: r.spans for r in language.language_spans(docs).collect()}[1000]
    top = sorted(spans, key=lambda s: -s["words"])[:2]
    assert {s["lang"] for s in top} == {"en", "de"} and sum(s["words"] for s in top) > 100
