"""Reads of versioned key-value entries: a DataFrame of (key, seq, value), any orderable key type.

Recency is the greatest seq. Filters on the key come before the latest version is chosen and reach the Parquet
scan; filters on the value have to come after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ordinals import numbered


def entries(df: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    return df.select(F.col(key).alias("key"), F.col(seq).alias("seq"), F.col(value).alias("value"))


def binary_key(n: Column) -> Column:
    """A non-negative integer as eight big-endian bytes, so that byte order is numeric order."""
    return F.unhex(F.lpad(F.hex(n), 16, "0"))


def latest(kv: DataFrame) -> DataFrame:
    """One row per key: value and seq of its latest version, and how many versions it has."""
    return kv.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"), F.count(F.lit(1)).alias("versions"))


def get(kv: DataFrame, key: object) -> DataFrame:
    """Exactly one row: key, found, value (null on a miss). A miss is an answer, not an error."""
    hit = kv.where(F.col("key") == F.lit(key)).agg(F.max_by("value", "seq").alias("value"), F.count(F.lit(1)).alias("n"))
    return hit.select(F.lit(key).alias("key"), (F.col("n") > 0).alias("found"), "value")


def multi_get(kv: DataFrame, probes: DataFrame) -> DataFrame:
    """One row per distinct probe: key, found, value. The planner broadcasts the probes if their size allows."""
    wanted = probes.select("key").distinct()
    own = latest(kv.join(wanted, "key", "left_semi"))
    return wanted.join(own, "key", "left").select("key", F.col("versions").isNotNull().alias("found"), "value")


def between(kv: DataFrame, low: Column, high: Column) -> DataFrame:
    """Latest versions of the keys in [low, high], both ends included; none if low > high."""
    return latest(kv.where(F.col("key").between(low, high)))


def ordered(kv: DataFrame, *columns: str) -> DataFrame:
    """Rows in key order carry their place: rn from 1."""
    return numbered(kv.select("key", *columns), ["key"])


def next_prefix(prefix: bytes) -> bytes | None:
    """The least byte string above all that start with the prefix; None if there is none."""
    head = prefix.rstrip(b"\xff")
    return head[:-1] + bytes([head[-1] + 1]) if head else None


def with_prefix(kv: DataFrame, prefix: str | bytes) -> DataFrame:
    """Latest versions of the keys with a prefix; a range on binary keys, startswith on strings, and both are pushed down."""
    if isinstance(prefix, str):
        return latest(kv.where(F.col("key").startswith(prefix)))
    end = next_prefix(prefix)
    own = kv.where(F.col("key") >= F.lit(prefix))
    return latest(own if end is None else own.where(F.col("key") < F.lit(end)))


def seek(kv: DataFrame, key: Column, n: int = 1) -> DataFrame:
    """The first n keys at or after a key, in order, with their places; a top-n, so no full sort."""
    first = latest(kv.where(F.col("key") >= key)).orderBy("key").limit(n)
    return first.withColumn("rn", F.row_number().over(W.orderBy("key")).cast("long"))


def all_versions(kv: DataFrame) -> DataFrame:
    """Every version: age 1 is a key's latest."""
    return kv.withColumn("_back", -F.col("seq")).transform(lambda d: numbered(d, ["_back"], ["key"], "age")).drop("_back")


def merge_runs(*runs: DataFrame) -> DataFrame:
    """The ordered bag union of runs: key order, newest first within a key; every version stays."""
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return numbered(out.withColumn("_back", -F.col("seq")), ["key", "_back"]).drop("_back")


def oldest_run_wins(kv: DataFrame, run: Column) -> DataFrame:
    """The value of the newest version within the oldest run that has the key: a store that probes flushed runs from the oldest on."""
    by_run = kv.withColumn("run", run).groupBy("key", "run").agg(F.max_by("value", "seq").alias("value"))
    return by_run.groupBy("key").agg(F.min_by("value", "run").alias("value"), F.min("run").alias("run"))


def probe_misses(kv: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: how many expected (key, value) pairs were looked up, and how many are missing or differ."""
    own = latest(kv.join(expected.select("key").distinct(), "key", "left_semi")).select("key", F.col("value").alias("found"))
    both = expected.join(own, "key", "left")
    return both.agg(F.count(F.lit(1)).alias("probes"), F.count_if(~F.col("value").eqNullSafe(F.col("found"))).alias("misses"))
