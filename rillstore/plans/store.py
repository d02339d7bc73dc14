"""A key-value store of Parquet runs: batches are appended as sorted runs, a manifest says which runs count.

Every run is range-partitioned and sorted by key, so footers and page indexes prune ranges; Parquet bloom filters on the
key prune point reads; the manifest has the first and last key of every run, so that a read opens only runs that may hold its keys.
Nothing written is changed; readers see the files of one version. A store opens at its last version, whatever a writer
that died has left beside it; vacuum removes such files.

Recency: the rows of a batch are numbered from 0 in its run, and the run's base, above all numbers of the runs before,
is set by the commit itself. Two writers that meet can't get the same numbers, as the one that loses is numbered anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kv
from .manifest import Manifest


def _plain(key: object) -> object:
    """A key as the manifest keeps it, in the same order: bytes as hex text."""
    return bytes(key).hex() if isinstance(key, bytes | bytearray) else key


class Store:
    def __init__(self, spark: SparkSession, path: str, schema: str = "key binary, seq bigint, value binary", expected_keys: int = 1_000_000):
        self.spark, self.path, self.schema, self.expected = spark, path.rstrip("/"), schema, expected_keys
        self.manifest = Manifest(spark, f"{self.path}/_log")
        self.closed = False

    def _open(self) -> None:
        if self.closed:
            raise ValueError("the store is closed")

    def _write(self, df: DataFrame, files: int | None) -> str:
        """A run of as many files as asked for; by default of as many as the session shuffles to, fewer where it coalesces small ones."""
        name = f"run-{uuid.uuid4().hex}"
        dealt = df.repartitionByRange("key") if files is None else df.repartitionByRange(files, "key")
        writer = dealt.sortWithinPartitions("key", "seq").write
        writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.expected.ndv#key", str(self.expected)).parquet(f"{self.path}/{name}")
        return name

    def _bounds(self, name: str) -> dict:
        """What the manifest says of a run: rows, greatest sequence number in it, first and last key."""
        own = self.spark.read.schema(self.schema).parquet(f"{self.path}/{name}").agg(F.count(F.lit(1)).alias("rows"), F.max("seq").alias("seq"), F.min("key").alias("first"), F.max("key").alias("last")).first()
        return {"rows": own.rows, "top": -1 if own.seq is None else own.seq, "first": _plain(own["first"]), "last": _plain(own["last"])}

    def set_all(self, batch: DataFrame, tag: str | None = None, files: int | None = None) -> int:
        """Append a batch of (key, value) or (key, seq, value) as one run and commit it; returns the version.

        Without seq the rows of a batch get one sequence number each, above all before. A tag, writer-number, that was
        committed already makes this do nothing, so that a retried batch counts once.
        """
        self._open()
        if self.manifest.seen(tag):
            return self.manifest.state()[0]
        numbered = "seq" in batch.columns
        name = self._write(batch.select("key", "seq", "value") if numbered else batch.select("key", F.monotonically_increasing_id().alias("seq"), "value"), files)
        said = self._bounds(name)

        def add(known: dict[str, dict]) -> list[dict]:
            if self.manifest.seen(tag):
                return []
            base = 0 if numbered else max((f["base"] + f["top"] for f in known.values()), default=-1) + 1
            return [{"action": "add", "file": name, "base": base, "tag": tag, **said}]

        return self.manifest.commit(add)

    def _read(self, files: dict[str, dict]) -> DataFrame:
        own = self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{f}" for f in sorted(files)])
        bases = [F.lit(x) for f in sorted(files) if files[f]["base"] for x in (f, files[f]["base"])]
        if not bases:
            return own
        run = F.regexp_extract(F.col("_metadata.file_path"), "(run-[0-9a-f]{32})/[^/]*$", 1)
        base = F.coalesce(F.create_map(*bases)[run], F.lit(0))
        return own.select("key", (F.col("seq") + base).alias("seq"), "value")

    def entries(self, version: int | None = None, low: object = None, high: object = None) -> DataFrame:
        """All versions of all entries of the store's current, or an earlier, version; with bounds, of the runs that may hold keys within."""
        self._open()
        _, files = self.manifest.state(version)
        low, high = _plain(low), _plain(high)
        files = {f: a for f, a in files.items() if a["rows"] and (low is None or a["last"] >= low) and (high is None or a["first"] <= high)}
        return self._read(files) if files else self.spark.createDataFrame([], self.schema)

    def get(self, key: object) -> DataFrame:
        return kv.get(self.entries(low=key, high=key), key)

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return kv.multi_get(self.entries(), probes)

    def range(self, low: object, high: object) -> DataFrame:
        """Bounds as plain values, by which runs are pruned, or as Columns."""
        if isinstance(low, Column) or isinstance(high, Column):
            return kv.between(self.entries(), low, high)
        return kv.between(self.entries(low=low, high=high), F.lit(low), F.lit(high))

    def scan(self, version: int | None = None) -> DataFrame:
        return kv.latest(self.entries(version))

    def compact(self, files: int | None = None) -> int:
        """Merge all current runs into one that holds the latest version of each key; runs that came meanwhile stay."""
        self._open()
        _, seen = self.manifest.state()
        if len(seen) < 2:
            return self.manifest.state()[0]
        last = self._read(seen).groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
        name = self._write(last, files)
        # Without rows, or with fewer numbers than the merged runs had, later batches still come above.
        said = self._bounds(name) | {"top": max(f["base"] + f["top"] for f in seen.values())}

        def swap(known: dict[str, dict]) -> list[dict]:
            if not set(seen) <= set(known):
                raise ValueError("the merged runs are gone; another compaction was first")
            return [{"action": "remove", "file": f} for f in seen] + [{"action": "add", "file": name, "base": 0, "tag": None, **said}]

        return self.manifest.commit(swap)

    def vacuum(self) -> list[str]:
        """Delete run folders that the current version doesn't use; earlier versions can't be read afterwards. Returns their names."""
        self._open()
        _, files = self.manifest.state()
        fs, path = self.manifest.fs, self.manifest._path
        there = [s.getPath().getName() for s in fs.listStatus(path(self.path))] if fs.exists(path(self.path)) else []
        gone = [n for n in there if n.startswith("run-") and n not in files]
        for n in gone:
            fs.delete(path(f"{self.path}/{n}"), True)
        return gone

    def close(self) -> None:
        """Every batch is committed when set_all returns, so nothing is left to flush."""
        self.closed = True
