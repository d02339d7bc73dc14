"""Append-only event streams: rows (stream, n, seq, type, data), n dense from 0 within each stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordinals import numbered


def append(arriving: DataFrame, history: DataFrame | None = None, ends: DataFrame | None = None, stream: str = "stream", seq: str = "seq") -> DataFrame:
    """Arriving records with their ordinals, by seq, after what their streams already hold.

    That is known from the history's records, or from ends (stream, length), which is far smaller where it is kept.
    """
    fresh = numbered(arriving, [seq], [stream], "n", start=0)
    if history is not None:
        have = history.join(arriving.select(stream).distinct(), stream, "left_semi")
        ends = have.groupBy(stream).agg((F.max("n") + 1).alias("length"))
    if ends is None:
        return fresh
    before = ends.select(stream, F.col("length").alias("_end"))
    return fresh.join(before, stream, "left").withColumn("n", F.col("n") + F.coalesce("_end", F.lit(0))).drop("_end")


def read(log: DataFrame, stream: object, first: int = 0, last: int | None = None) -> DataFrame:
    """Records of one stream from ordinal first on, to last included; streams are compared whole, never by prefix."""
    own = log.where((F.col("stream") == F.lit(stream)) & (F.col("n") >= first))
    return own if last is None else own.where(F.col("n") <= last)


def exists(log: DataFrame, names: DataFrame) -> DataFrame:
    """Each asked name with exists: true iff the stream has a record."""
    there = log.join(names, "stream", "left_semi").select("stream").distinct().withColumn("_there", F.lit(True))
    return names.distinct().join(there, "stream", "left").select("stream", F.col("_there").isNotNull().alias("exists"))


def lengths(log: DataFrame) -> DataFrame:
    """Each stream with its length, the greatest ordinal + 1."""
    return log.groupBy("stream").agg((F.max("n") + 1).alias("length"))


def everything(log: DataFrame, seq: str = "seq") -> DataFrame:
    """All records of all streams in arrival order, with their global place from 0."""
    return numbered(log, [seq], name="place", start=0)


def payload(data: Column, schema: str) -> Column:
    """A JSON payload by a schema that the reader chooses."""
    return F.from_json(data, schema)


def serialize(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def fold(log: DataFrame, **parts: Column) -> DataFrame:
    """The state of every stream from its records: named aggregates, combined before the shuffle."""
    return log.groupBy("stream").agg(*[c.alias(k) for k, c in parts.items()])
