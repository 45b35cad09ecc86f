"""Queries of the training-data operators, under the names that ``__spark_entry__`` registers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import classifier, language, neighbours, quality_rules, scoring, secrets, substrings
from .bpe import round_trip
from .common import read
from .packing import pack
from .simhash import near_duplicates


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """``ledger`` names a folder that is read and appended to; without one, every scan starts from an empty ledger."""
    return secrets.digest(read(spark, sf_dir, "documents"), path=ledger)


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(read(spark, sf_dir, "documents"))


def op8_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.judge(read(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read(spark, sf_dir, "documents"))


def op10_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_byte_bpe": op2_byte_bpe,
        "op3_quality_rules": op3_quality_rules,
        "op4_simhash": op4_simhash,
        "op5_secrets": op5_secrets,
        "op6_neighbours": op6_neighbours,
        "op7_substrings": op7_substrings,
        "op8_scoring": op8_scoring,
        "op9_language": op9_language,
        "op10_classifier": op10_classifier,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": quality_rules.ORACLE_SQL, "op5_secrets": secrets.oracle_sql(), "op7_substrings": substrings.ORACLE_SQL}
