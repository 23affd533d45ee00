"""The queries of this subpackage: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from leafgate.llm import alignment, fertility, htmltext, langid, lloyd, maxent, mixing, neardup, pii, sharding, substring, suffixes
from leafgate.llm.decontaminate import contamination
from leafgate.llm.oracles import ORACLES
from leafgate.llm.tables import table


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file; the folder is a parameter of the environment."""
    return f"{os.environ.get('TOKENIZERS_DIR', '/opt/tokenizers')}/{name}"


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs.where(~langid.held_out(F.col("doc_id")))))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.quality(table(spark, sf_dir, "documents"), [vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_multi_50k.tiktoken")])


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extracted(table(spark, sf_dir, "pages"))


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.scores(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.substring_dedup(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.suffix_dedup(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignments(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_html_text, op2_lm_score, op3_near_dedup, op4_decontaminate, op5_quality, op6_substring_dedup, op7_suffix_dedup, op8_language_id, op9_personal_data, op10_mix_sources, op11_token_alignment, op12_sharding, op13_centroid_clusters)
}
__all__ = ["ORACLES", "QUERIES"]
