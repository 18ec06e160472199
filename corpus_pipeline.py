"""From raw documents to packed training sequences, in five stages over what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strikeplane.llm import langid, mixing, packing, secrets, simhash
from strikeplane.llm.queries import tokenizer_path
from strikeplane.llm.shared import materialize


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is undetermined or ambiguous."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark in the place of each secret."""
    return secrets.redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of sources wants it."""
    return mixing.take(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents' tokens into sequences; rows hold their token ids."""
    return packing.pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("mixture", mixture), ("packed", packed)]

#: The first stage learns a classifier, which SQL can't; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
