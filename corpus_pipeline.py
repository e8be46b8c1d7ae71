"""Corpus pipeline: from documents to a mix of good, distinct, uncontaminated texts without secrets.

Each stage works on what the one before kept and returns the columns of documents; the last adds what the mix takes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkflow.llm.common import cut, table
from inkflow.llm.decontaminate import clean_documents
from inkflow.llm.mixing import mixed_documents
from inkflow.llm.quality import good_documents
from inkflow.llm.secrets import redact
from inkflow.llm.shingles import shingle_groups
from inkflow.llm.simhash import one_of_each_group


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the least doc_id: SimHash groups of 5-word shingles, completed to similarity 0.8."""
    return one_of_each_group(docs, shingle_groups)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret in a text is masked; n_chars follows."""
    return redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the mix takes nothing go; the others carry the target of their source and the words taken."""
    return mixed_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secrets),
    ("source mixing", mixing),
]

#: The perplexities and shingle groups of the first stages are no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
