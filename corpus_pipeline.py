"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, tokens.

Every stage takes the documents that its predecessor kept, is written as Parquet into the shared folder and read again.
All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillstore.llm import bpe, decontaminate, near_dedup, secrets, toxicity
from rillstore.llm.runtime import materialize


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return toxicity.reject(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the least doc_id."""
    return near_dedup.keep_one(docs)


def leaked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of the secret scan is replaced by a mark; n_chars follows. All documents stay."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and the digests of ids and decoded text of every document."""
    keep = ["doc_id", "lang", "source"]
    return bpe.encode(docs, keep).select(*keep, "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [("toxicity", toxic), ("near duplicates", near), ("decontamination", leaked), ("secrets", secret), ("bpe", tokens)]

#: Learned scores, signatures and merges have no SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
