"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, licenses, near_dedup, oracle, quality_model, quality_rules, secrets, substring_dedup, token_files, toxicity

from .runtime import remainder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"), ["doc_id"])
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.text_of(F.col("base")), 256).alias("base_sha256"), secrets.text_of(F.col("spans")).alias("spans"), "n_owned", "n_copied", "most_owners", "most_repos")


def op2_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_gear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with repeated passages; spans and the parts to cut as start:end in code points."""
    found = substring_dedup.passages(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["at"].cast("string"), s["end"].cast("string"))), ",")
    chars = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["at"])
    return found.select("doc_id", F.size("spans").alias("n_passages"), chars("spans").alias("repeated_chars"), chars("cut").alias("cut_chars"), text("spans").alias("spans"), text("cut").alias("cut"))


def op4_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), ["doc_id"], with_ids=False)


def op5_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.count_documents(table(spark, sf_dir, "documents"))


def op7_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rules(table(spark, sf_dir, "documents"))


def op8_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op9_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def op10_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 1).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_ownership, op2_license_dice, op3_gear_chunks, op4_bpe_lexicon, op5_ordinal_quality,
        op6_separator_scan, op7_repetition_rules, op8_bagminhash, op9_cgk_decontamination, op10_compression_toxicity,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_secret_ownership": oracle.OP1}
