"""A corpus pipeline of five of the training-data operators.

Each stage is (name, function); a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written
and read again as the next stage's ``docs``. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import classifier, secrets, similar, substrings
from keystrata.llm.common import read, stage
from keystrata.llm.packing import pack


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. It learns from the labelled ones among ``docs``."""
    return classifier.keep(docs, classifier.fit_quality(docs, read(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of smallest doc_id: texts whose sets of five-word
    shingles are similar to 0.8 or more, found by SimHash fingerprints and shared shingles."""
    return similar.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more that a document of smaller doc_id has are cut out of the text."""
    return _counted(substrings.remove_repeats(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the text give way to a marker."""
    return _counted(secrets.redact(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and places."""
    return pack(docs)


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scans", secret_scan),
    ("packing", packing),
]

#: Model fits, hash tables and best-fit packing are not SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = function(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs, name.replace(" ", "-"))
    return docs
