"""The registered queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from swaymeter.llm import conversations, decontaminate, jaccard, langid, mixing, quality, quality_model, secrets, simhash, spelling, token_counts, toxicity, warc
from swaymeter.llm.common import table
from swaymeter.llm.oracle import SQL


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op1_warc(table(spark, sf_dir, "pages"))


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op2_secret_scans(table(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3_quality_rules(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op4_simhash(table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op5_decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.op6_token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(token_counts.VOCABULARY))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.op7_language_id(table(spark, sf_dir, "documents"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.op8_quality_classifier(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op9_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op10_mixing(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.op11_conversation_repair(table(spark, sf_dir, "conversations"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.op12_spelling(table(spark, sf_dir, "documents"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.op13_jaccard(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc, op2_secret_scans, op3_quality_rules, op4_simhash, op5_decontamination, op6_token_counts, op7_language_id,
        op8_quality_classifier, op9_toxicity, op10_mixing, op11_conversation_repair, op12_spelling, op13_jaccard,
    )
}
ORACLE: dict[str, str] = SQL
