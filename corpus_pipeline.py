"""A training corpus from raw documents, stage by stage; each stage's result is written and read again by the next.

toxicity      rejects documents that the subword model scores as toxic
near_dedup    keeps one document of each group of near-duplicates
secrets       replaces secrets in what is left
mixing        brings sources to their target weights: documents are left out or repeated
packing       puts every document into a length bucket and a batch

Defined results: documents with null columns, empty or very long texts pass like any other, but for what a stage is there
for: documents without words take no part in a mix, and of rows with one id the deduplication keeps one. Documents
without an id stay. Extra columns pass through all stages but the last, whose rows are doc_id, length, bucket,
padded_length, batch and slot. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import automaton, golay, mixing, packing, toxicity
from tapeloom.llm.shared import discard, fresh_path, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return golay.without_copies(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return automaton.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_query(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models, component search and seeded selection are beyond SQL; tests take the operators of the stages one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = fresh_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        # the stage is written whole, so the one before it is not needed any more
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
