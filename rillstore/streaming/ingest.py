"""Structured Streaming ingest of events into a log of streams with dense ordinals.

Each micro-batch gets the ordinals that follow what the log holds of its streams and is written as one run; the manifest's
tag, the query's name and batch number, makes a batch that is retried after a crash count once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import streams
from ..plans.manifest import Manifest

SCHEMA = "stream string, n bigint, seq bigint, type string, data string"
ENDS = "stream string, length bigint"
#: Tables of stream lengths that an append merges into one.
MERGE_ENDS = 16


class EventLog:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 8):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.manifest = Manifest(spark, f"{self.path}/_log")

    def _files(self, known: dict[str, dict], kind: str) -> list[str]:
        return sorted(f for f, a in known.items() if a["kind"] == kind)

    def _read(self, files: list[str], schema: str) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in files])

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self._files(self.manifest.state(version)[1], "records"), SCHEMA)

    def ends(self, known: dict[str, dict]) -> DataFrame:
        """The length of every stream, from the small tables that appends leave beside the records."""
        return self._read(self._files(known, "ends"), ENDS).groupBy("stream").agg(F.max("length").alias("length"))

    def append(self, batch: DataFrame, tag: str) -> None:
        """Records (stream, seq, type, data) in order of seq; nothing happens if the tag is committed already."""
        if self.manifest.seen(tag):
            return
        known = self.manifest.state()[1]
        ends = self.ends(known)
        out = streams.append(batch.select("stream", "seq", "type", "data"), ends=ends).select("stream", "n", "seq", "type", "data")
        records, lengths = f"records-{uuid.uuid4().hex}", f"ends-{uuid.uuid4().hex}"
        # By ranges of stream and ordinal: files prune reads of a stream, and a hot stream takes several.
        out.repartitionByRange(self.buckets, "stream", "n").sortWithinPartitions("stream", "n").write.parquet(f"{self.path}/{records}")
        own = self._read([records], SCHEMA).groupBy("stream").agg((F.max("n") + 1).alias("length"))
        old = self._files(known, "ends")
        merge = len(old) >= MERGE_ENDS
        (own.unionByName(ends).groupBy("stream").agg(F.max("length").alias("length")) if merge else own).write.parquet(f"{self.path}/{lengths}")

        def add(now: dict[str, dict]) -> list[dict]:
            # Ordinals were given on top of these lengths; another append since then would make them clash.
            if self._files(now, "ends") != old:
                raise ValueError("another writer has appended; append again")
            gone = [{"action": "remove", "file": f} for f in old] if merge else []
            return [*gone, {"action": "add", "file": records, "kind": "records", "tag": tag}, {"action": "add", "file": lengths, "kind": "ends"}]

        self.manifest.commit(add)


    def merge(self, buckets: int | None = None) -> None:
        """Merge all record files into one run in order of stream and ordinal; records that arrive meanwhile stay beside it."""
        seen = self._files(self.manifest.state()[1], "records")
        if len(seen) < 2:
            return
        name = f"records-{uuid.uuid4().hex}"
        by = ["stream", "n"]
        own = self._read(seen, SCHEMA)
        (own.repartitionByRange(*by) if buckets is None else own.repartitionByRange(buckets, *by)).sortWithinPartitions(*by).write.parquet(f"{self.path}/{name}")

        def swap(now: dict[str, dict]) -> list[dict]:
            if not set(seen) <= set(now):
                raise ValueError("the merged records are gone; another merge was first")
            return [{"action": "remove", "file": f} for f in seen] + [{"action": "add", "file": name, "kind": "records"}]

        self.manifest.commit(swap)


def ingest(events: DataFrame, log: EventLog, checkpoint: str, name: str = "ingest"):
    """Start a query that appends a streaming DataFrame (stream, seq, type, data) to the log, as much as there is now."""
    def one(batch: DataFrame, number: int) -> None:
        log.append(batch, f"{name}-{number}")

    return events.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lengths_by_window(events: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Records of each stream in each window of event time; rows later than the watermark are left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), "stream").agg(F.count(F.lit(1)).alias("records"))
