"""Readers of the flat table, write-log and manifest files of an embedded store.

Files are found and read by Spark's binaryFile source, so any store that Spark reads will do; each file is decoded in
one task, as its index lies at its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import ship

# The file kinds by number.
KINDS = {1: "manifest", 2: "log", 3: "table"}
#: Entries of a batch.
ENTRIES = 10_000


def varint(raw: bytes, at: int) -> tuple[int, int]:
    """(value, place after it)."""
    value = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise ValueError("a varint is cut off")
        byte = raw[at]
        value |= (byte & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if byte < 0x80:
            return value, at


def string(raw: bytes, at: int) -> tuple[bytes, int]:
    """(bytes with a varint length before them, place after them)."""
    n, at = varint(raw, at)
    if at + n > len(raw):
        raise ValueError("a byte string is cut off")
    return raw[at : at + n], at + n


def pairs(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 0
    while at < len(raw):
        key, at = string(raw, at)
        value, at = string(raw, at)
        yield key, value


def table_entries(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Entries of a table file: its last four bytes give the footer's length; the footer leads to the index, and that to the blocks."""
    size = int.from_bytes(raw[-4:], "little")
    footer = raw[len(raw) - 4 - size : len(raw) - 4]
    at = 0
    for _ in range(3):  # filter, first key, last key
        _, at = string(footer, at)
    start, length = int.from_bytes(footer[at : at + 8], "little"), int.from_bytes(footer[at + 8 : at + 16], "little")
    for _, handle in pairs(raw[start : start + length]):
        block = int.from_bytes(handle[:8], "little")
        yield from pairs(raw[block : block + int.from_bytes(handle[8:], "little")])


def log_entries(raw: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Entries of a write log, one frame each; a frame that a crash has cut off ends it."""
    at = 0
    while at < len(raw):
        try:
            frame, at = string(raw, at)
        except ValueError:
            return
        yield from pairs(frame)


def manifest_edits(raw: bytes) -> Iterator[tuple[int, bool, str, int]]:
    """(frame, is_add, kind, number): each frame lists removed tables, removed logs, added tables, added logs."""
    at = frame = 0
    while at < len(raw):
        body, at = string(raw, at)
        place = 0
        for adds in (False, False, True, True):
            n, place = varint(body, place)
            for _ in range(n):
                kind, place = varint(body, place)
                number, place = varint(body, place)
                yield frame, adds, KINDS.get(kind, "none"), number
        frame += 1


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.regexp_extract("path", r"([0-9]+)\.\w+$", 1).cast("long").alias("number"), "content")


def read_entries(spark: SparkSession, path: str, kind: str = "table") -> DataFrame:
    """(number, place, key, value) of all table or log files under a path; number is the file's, and a later one is newer."""
    decode = table_entries if kind == "table" else log_entries

    def run(batches):
        for batch in batches:
            for number, raw in zip(batch.column("number").to_pylist(), batch.column("content"), strict=True):
                entries, at = decode(raw.as_py()), 0
                while found := list(islice(entries, ENTRIES)):
                    yield pa.RecordBatch.from_arrays([pa.array([number] * len(found), pa.int64()), pa.array(range(at, at + len(found)), pa.int64()), pa.array([k for k, _ in found], pa.binary()), pa.array([v for _, v in found], pa.binary())], names=["number", "place", "key", "value"])
                    at += len(found)

    return _files(spark, path, "*.olog" if kind == "table" else "*.ulog").mapInArrow(run, "number long, place long, key binary, value binary")


def read_manifests(spark: SparkSession, path: str, highest: bool = True) -> DataFrame:
    """(number, version, is_add, kind, file) of the edits of the highest manifest under a path, the one that counts, or of all."""
    def run(batches):
        for batch in batches:
            for number, raw in zip(batch.column("number").to_pylist(), batch.column("content"), strict=True):
                found = list(manifest_edits(raw.as_py()))
                arrays = [pa.array([number] * len(found), pa.int64()), *(pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.bool_(), pa.string(), pa.int64())))]
                yield pa.RecordBatch.from_arrays(arrays, names=["number", "version", "is_add", "kind", "file"])

    files = _files(spark, path, "*.manifest")
    if highest:
        # Names only: contents aren't read for this.
        files = files.join(F.broadcast(files.agg(F.max("number").alias("number"))), "number")
    return files.select("number", "content").mapInArrow(run, "number long, version long, is_add boolean, kind string, file long")
