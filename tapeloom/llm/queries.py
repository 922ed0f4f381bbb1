"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm.audio import text_audio
from tapeloom.llm.automaton import scan_digest
from tapeloom.llm.digest import edit_query
from tapeloom.llm import kneserney, maxsketch, toxicity, vafile
from tapeloom.llm.golay import simhash_query
from tapeloom.llm.language import predict
from tapeloom.llm.mixing import mix_query
from tapeloom.llm.packing import pack_query
from tapeloom.llm.reshard import reshard_query
from tapeloom.llm.shared import table
from tapeloom.llm.template import extract


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_query(table(spark, sf_dir, "documents"))


def op2_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_query(table(spark, sf_dir, "documents"))


def op3_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_digest(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_query(table(spark, sf_dir, "documents"))


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_audio(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_query(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneserney.score(table(spark, sf_dir, "documents"))


def op11_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshard_query(table(spark, sf_dir, "documents"))


def op12_max_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxsketch.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vafile.cluster(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_digest": op2_digest,
    "op3_template": op3_template,
    "op4_secrets": op4_secrets,
    "op5_language": op5_language,
    "op6_simhash": op6_simhash,
    "op7_audio": op7_audio,
    "op8_packing": op8_packing,
    "op9_toxicity": op9_toxicity,
    "op10_kneser_ney": op10_kneser_ney,
    "op11_reshard": op11_reshard,
    "op12_max_sketch": op12_max_sketch,
    "op13_va_file": op13_va_file,
}

ORACLES: dict[str, str] = {"op12_max_sketch": maxsketch.ORACLE, "op13_va_file": vafile.ORACLE}
