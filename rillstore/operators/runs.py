"""Sorted runs: how writes are cut into runs and blocks, what is known of each, and how runs are merged.

A buffer takes an entry unless its size is already over the capacity, so it overshoots by one entry; then the next run
begins. A block closes when its encoded size reaches the limit after an entry. With entries of one size both have a
closed form; with sizes that vary they are folds with a reset, which run shard by shard over a sorted stream of
sizes in constant memory.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordinals import numbered

#: Bytes of a write buffer and of a data block.
CAPACITY, BLOCK = 16_384, 4_096


def entries_a_run(size: int, capacity: int = CAPACITY) -> int:
    return capacity // size + 1


def entries_a_block(encoded: int, block: int = BLOCK) -> int:
    return math.ceil(block / encoded)


def cut_evenly(df: DataFrame, order: list[str], entries: int, name: str) -> DataFrame:
    """df with the number, from 0, of the run or block of each row, for entries of one size."""
    return numbered(df, order, name="_rn").withColumn(name, F.expr(f"(_rn - 1) div {entries}")).drop("_rn")


def fold_runs(sizes: DataFrame, capacity: int = CAPACITY, over: bool = True) -> DataFrame:
    """Of (shard, seq, size), all BIGINT: with the run of each row, from 0, within its shard.

    over: a run ends with the entry that takes it past the capacity (write buffers); else with the one that reaches it
    (blocks).
    """
    def fold(batches):
        shard, run, held = None, 0, 0
        for batch in batches:
            runs = []
            for s, size in zip(batch.column("shard").to_pylist(), batch.column("size").to_pylist(), strict=True):
                if s != shard:
                    shard, run, held = s, 0, 0
                elif held > capacity or (not over and held >= capacity):
                    run, held = run + 1, 0
                runs.append(run)
                held += size
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(runs, pa.int64())], names=["shard", "seq", "size", "run"])

    own = sizes.select(*[F.col(c).cast("long").alias(c) for c in ("shard", "seq", "size")])
    return own.repartition("shard").sortWithinPartitions("shard", "seq").mapInArrow(fold, "shard long, seq long, size long, run long")


def zone_maps(kv: DataFrame, size: Column, run: str = "run") -> DataFrame:
    """First key, last key, entries and bytes of each run."""
    return kv.groupBy(run).agg(F.min("key").alias("first_key"), F.max("key").alias("last_key"), F.count(F.lit(1)).alias("entries"), F.sum(size).alias("bytes"))


def sparse_index(kv: DataFrame, entries: int) -> DataFrame:
    """The last key of every block of an ordered run."""
    return cut_evenly(kv.select("key"), ["key"], entries, "block").groupBy("block").agg(F.max("key").alias("last_key"), F.count(F.lit(1)).alias("entries"))


def compact(kv: DataFrame, entries: int) -> DataFrame:
    """The latest version of each key over all runs, in key order, cut into new runs."""
    last = kv.groupBy("key").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    return cut_evenly(last, ["key"], entries, "run")
