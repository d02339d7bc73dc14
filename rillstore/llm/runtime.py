"""What the operators share: written tables and Arrow batches of bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import folder, ship

#: Bytes of text that a Python task handles at a time, unless one text alone is longer.
SLICE_BYTES = 2_000_000
#: Characters that a labelled text may have to take part in a fit; longer ones are left out of the sample, whose size is so bounded.
TRAIN_LENGTH = 100_000


def materialize(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def named(name: str) -> Column:
    """A column by its whole name, dots and quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, keep: list[str], results: Iterable[str] = (), text: str = "text") -> DataFrame:
    """(kept, text): the columns of `keep` in one struct, so that no name can clash with an operator's own.

    A kept column with the name of a result is called kept_<name>.
    """
    own = [named(c).alias(f"kept_{c}" if c in set(results) else c) for c in keep]
    return docs.select(F.struct(*(own or [F.lit(None).cast("string").alias("kept_nothing")])).alias("kept"), named(text).alias("text"))


def unpacked(df: DataFrame, keep: list[str], *results: str) -> DataFrame:
    """The kept columns, then the results."""
    return df.select(*(["kept.*"] if keep else []), *results)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int, length: int = TRAIN_LENGTH, held_out: int | None = 1) -> DataFrame:
    """(text, label) of at most `most` labelled documents, in order of a hash of the id; none whose remainder is held_out.

    The ids are chosen among labels that have a document with a text of at most `length` characters, so that absent
    documents and long ones don't shrink the sample.
    """
    allowed = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias(label))
    if held_out is not None:
        allowed = allowed.where(remainder(F.col("doc_id")) != held_out)
    by_hash = (F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id"), F.col(label))
    own = docs.select("doc_id", "text").where(F.char_length("text") <= length)
    # Two numbers of at most `most` rows, so small enough to broadcast at any size of the corpus.
    chosen = allowed.join(own.select("doc_id"), "doc_id", "left_semi").orderBy(*by_hash).limit(most)
    return own.join(F.broadcast(chosen), "doc_id").orderBy(*by_hash, F.xxhash64("text")).limit(most).select("text", label)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds about `most` bytes of the column (one long value may exceed it)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if start < batch.num_rows:
            yield batch.slice(start)


_KEPT: dict[str, dict] = {}


def kept(name: str) -> dict:
    """What this worker keeps between the tasks of an operator, until a task of another begins."""
    return _KEPT.setdefault(name, {})


def release(but: str | None = None) -> None:
    """Give the memory of what this worker keeps for other operators, and what allocators hold unused, back to the system."""
    for name, held in _KEPT.items():
        if name != but:
            held.clear()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema, column: str = "text", most: int = SLICE_BYTES, keeps: str | None = None) -> DataFrame:
    """mapInArrow with a function of one bounded batch. keeps: the name of what fn keeps in its worker."""
    ship(df.sparkSession)

    def run(batches):
        release(keeps)
        try:
            for piece in slices(batches, column, most):
                yield fn(piece)
        finally:
            release(keeps)

    return df.mapInArrow(run, schema)
