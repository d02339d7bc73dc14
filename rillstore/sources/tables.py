"""The driver's tables as key-value entries and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kv, streams


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with overwrites: the values of each user."""
    return kv.entries(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


def event_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with distinct keys."""
    return kv.entries(table(spark, sf_dir, "events").withColumn("seq", F.col("event_id")), "event_id", "seq", "value")


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the users' streams in arrival order, without ordinals."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("stream"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), F.col("props").alias("data"), "value")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users' streams with their ordinals."""
    return streams.append(arriving(spark, sf_dir))
