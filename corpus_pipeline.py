"""A training corpus from raw documents: filter by quality, keep one of each near copy, redact secrets, mix sources, pack.

Every stage reads what the stage before it wrote. All but the last return rows of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from voxmill.llm import common, mixing, near_join, packing, quality, secrets

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, common.read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: five-word shingles, a Jaccard similarity of 0.8 or more."""
    return near_join.keep_one(docs, width=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target proportions: documents are left out, taken in part or taken twice."""
    return mixing.copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the windows of 4096 tokens."""
    return packing.pack(docs, packing.public_tokenizer())


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_filter),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mix", source_mix),
    ("packing", pack),
]

#: Neither the classifier nor the tokenizer can be stated in SQL; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: each writes a Parquet table in the shared folder, which the next one reads."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = common.scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
