"""A corpus pipeline: quality filter, near-duplicate removal, decontamination, masking, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import decontaminate, near_copies, packing, pii, quality
from lattica.llm.common import shared_dir, table
from lattica.llm.queries import tokenizer_files


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingle sets with a similarity of 0.8 or more."""
    return near_copies.keep_one(docs)


def benchmark_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of the benchmark occurs."""
    return decontaminate.clean_only(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.mask(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of related documents' tokens."""
    return packing.pack(docs, *tokenizer_files())


STAGES = [
    ("quality", quality_filter),
    ("near_copies", near_duplicate_filter),
    ("decontamination", benchmark_filter),
    ("pii", mask_personal_data),
    ("packing", pack_windows),
]

#: SQL can't express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
