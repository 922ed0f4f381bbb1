"""Every operator over nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

from tapeloom.llm import audio, automaton, digest, golay, kneserney, language, mixing, packing, template, toxicity


def labels(spark):
    return spark.createDataFrame([(20 + i, 0, i % 2) for i in range(40)] + [(1, None, None), (2, 1, 1), (2, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


RUNS = {
    "mix": lambda s, d: mixing.mix_query(d),
    "digest": lambda s, d: digest.edit_query(d, 20),
    "secrets": lambda s, d: automaton.scan_digest(d),
    "spans": lambda s, d: automaton.scan(d),
    "language": lambda s, d: language.predict(d),
    "language_spans": lambda s, d: language.language_spans(d),
    "simhash": lambda s, d: golay.simhash_query(d),
    "like": lambda s, d: golay.like_groups(d),
    "audio": lambda s, d: audio.text_audio(d),
    "packing": lambda s, d: packing.pack_query(d),
    "toxicity": lambda s, d: toxicity.score(d, labels(s)),
    "kneser_ney": lambda s, d: kneserney.score(d),
    "fingerprints": lambda s, d: digest.fingerprints(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_for_each_document(spark, edge_docs, name):
    out = RUNS[name](spark, edge_docs)
    assert out.count() == edge_docs.count()
    assert len(set(out.columns)) == len(out.columns)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, no_docs, name):
    assert RUNS[name](spark, no_docs).collect() == []


@pytest.mark.parametrize("stage", ["redact", "without_toxic", "without_copies", "mixed"])
def test_stages_keep_the_columns(spark, edge_docs, no_docs, stage):
    run = {"redact": automaton.redact, "without_toxic": lambda d: toxicity.without_toxic(d, labels(spark)), "without_copies": golay.without_copies, "mixed": mixing.mixed_documents}[stage]
    for docs in (edge_docs, no_docs):
        out = run(docs)
        assert out.columns == docs.columns
        out.collect()


def test_equal_texts_have_equal_results(spark, edge_docs):
    same = lambda df, c: {r[c] for r in df.filter(F.col("doc_id").isin(1, 2)).collect()}
    assert len(same(digest.edit_query(edge_docs), "fingerprint")) == 1
    assert len(same(audio.text_audio(edge_docs), "feature")) == 1
    assert len(same(golay.simhash_query(edge_docs), "component_id")) == 1


def test_pages(spark):
    rows = [(1, None, None), (2, "not a url", ""), (3, "http://h.example/a", "<p>x"), (3, "http://h.example/a", "<p>x"), (None, "http://h.example/b", "<article><p>y &lt; z"), (5, "http://h.example/c", "<" * 50 + "a" * 100_000)]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    out = {(r.page_id, r.url): r.text for r in template.extract(pages).collect()}
    assert out[1, None] == "" and out[2, "not a url"] == "" and out[3, "http://h.example/a"] == "x" and out[None, "http://h.example/b"] == "y < z"
    assert template.extract(pages).count() == len(rows)
    assert template.extract(pages.limit(0)).collect() == []


def test_documents_without_an_id_stay(spark, edge_docs):
    for out in (golay.without_copies(edge_docs), automaton.redact(edge_docs)):
        assert out.filter(F.col("doc_id").isNull()).count() == 1


def test_repeated_rows_and_copies_leave_one(spark, edge_docs):
    kept = [r.doc_id for r in golay.without_copies(edge_docs).collect()]
    assert 1 in kept and 2 not in kept and len(kept) == len(set(kept))
