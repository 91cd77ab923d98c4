"""The registered queries of the corpus operators; each runs over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import conversations, infill, language, language_model, licenses, media, mixing, pieces, quality, secrets, simhash, token_counts, toxicity
from .common import documents


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(documents(spark, sf_dir))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation(quality.ledger(documents(spark, sf_dir), "doc_id"))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(documents(spark, sf_dir))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.scores(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predicted(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trips(documents(spark, sf_dir))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(documents(spark, sf_dir))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(documents(spark, sf_dir))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(documents(spark, sf_dir))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts(documents(spark, sf_dir))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audits(conversations.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


QUERIES = {
    "op1_secret_scans": op1_secret_scans,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_toxicity": op3_toxicity,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_license_scans": op5_license_scans,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op8_language_id": op8_language_id,
    "op9_mixing": op9_mixing,
    "op10_media_columns": op10_media_columns,
    "op7_quality_rules": op7_quality_rules,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_repair": op13_conversation_repair,
    "quality_ablation": quality_ablation,
}
ORACLE_SQL = {
    "op1_secret_scans": secrets.oracle(),
    "op5_license_scans": licenses.ORACLE,
    "op7_quality_rules": quality.ORACLE,
    "op11_fill_in_middle": infill.oracle(),
    "op13_conversation_repair": conversations.oracle(),
    "quality_ablation": quality.ABLATION,
}
