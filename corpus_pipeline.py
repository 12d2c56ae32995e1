"""A training corpus from raw documents: toxic documents go, near copies go, personal data is replaced, sources are mixed, texts become ids."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stretto.llm import bpe, common, mixing, pii, simhash, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not call toxic; it learns from the labels beside the documents."""
    return toxicity.kept_documents(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is alike in four fifths of its five-word shingles."""
    return simhash.kept_documents(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted_documents(docs, pii.train(docs))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' targets ask for."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document."""
    return bpe.digests(bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN))


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_copies),
    ("personal_data", without_personal_data),
    ("mixing", mixed),
    ("encoding", encoded),
]

#: The trained stages have no SQL; tests/llm/test_pipeline.py holds the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = [functools.partial(f, spark) for _, f in STAGES]
    for f in stages[:-1]:
        docs = common.written(f(docs, sf_dir), "stage")
    return stages[-1](docs, sf_dir)
