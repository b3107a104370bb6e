"""A corpus pipeline of five stages over `documents`: each works on all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paneflow.llm.languages import keep_identified
from paneflow.llm.minhash import keep_one_of_each
from paneflow.llm.mixing import mix
from paneflow.llm.packing import pack_documents, tokenizer_path
from paneflow.llm.secrets import mask_secrets


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is mostly in one of the learned languages; those without a letter go."""
    return keep_identified(docs, least=0.4)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five-word shingles are linked at 0.8."""
    return keep_one_of_each(docs, words=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return mask_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture of the sources takes it."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, by sequence; its workers have held the other stages' memory, so they keep fewer ids."""
    return pack_documents(docs, tokenizer_path(), known=50_000)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("secret_scan", secret_scan), ("mixing", mixing), ("packing", packing)]
#: A learned model and a tokenizer are beyond SQL; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
