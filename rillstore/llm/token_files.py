"""Token counts by separator scan over flat token files.

A flat file is a run of fixed-width ids without an index; an end-of-document id closes every document. Files of any size are
read in blocks, by byte ranges; each block is searched at once for the separator, and documents that cross block borders are
stitched by a prefix scan over the blocks' summaries: how many separators came before, and how many tokens stand open. The scan
has two levels, within groups of `GROUP` blocks and over the groups of a file, so no task gets all blocks of a large file.

Flat files are opened with pyarrow's file systems (local and mounted folders, hdfs, s3, gcs), as Spark's own binary reader
takes a file as one row of 2 GB at most.

Defined cases: a null text is a document of no tokens; tokens after a file's last separator form an unterminated document;
a file without separators is one unterminated document, an empty file none, and bytes after the last whole id are ignored; a
document of any length, over many blocks, is one row; repeated rows are separate documents; extra columns are ignored; an empty
table gives an empty result. An end-of-document marker inside a text is ordinary text.
"""

from __future__ import annotations

import uuid
from array import array
from urllib.parse import quote

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.shared import folder
from .bpe import Encoder, Vocabulary
from .lexicon import compile_words, mapped
from .runtime import materialize, ship, slices

#: Bytes of a block, and blocks of a group.
BLOCK, GROUP = 1 << 17, 64
#: Bytes of an id, and the separator of the vocabulary.
WIDTH, SEPARATOR = 2, 50256


class FlatEncoder(Encoder):
    """Pieces to the bytes of their 16-bit ids."""

    def made(self, ids: list[int], ends: list[int]) -> list[bytes]:
        raw = array("H", ids).tobytes()
        return [raw[WIDTH * a : WIDTH * b] for a, b in zip([0, *ends], ends, strict=False)]

    def flat(self, texts: list[str | None]) -> list[bytes]:
        cut = [self.vocabulary.pieces(t or "") for t in texts]
        own = self.learn(set().union(*cut))
        return [b"".join([own[p] for p in pieces]) for pieces in cut]


_ENCODERS: dict[str, FlatEncoder] = {}


def _encoder(name: str) -> FlatEncoder:
    """This worker's encoder; its lexicon holds the vocabulary's own words."""
    if name not in _ENCODERS:
        v = Vocabulary(public_tokenizers.path(name))
        words = ((b, (i,)) for b, i in v.id_of.items() if b.isascii() and b.strip().isalpha() and v.pieces(b.decode()) == [b.decode()])
        own = [(b, i) for b, i in words if v.merge(b) == list(i)]
        _ENCODERS[name] = FlatEncoder(v, mapped(compile_words(own)))
    return _ENCODERS[name]


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system and path of a URI as Spark writes it."""
    scheme, _, rest = uri.partition(":")
    return fs.FileSystem.from_uri(f"file://{quote('/' + rest.lstrip('/'))}" if scheme == "file" else uri)


def write(docs: DataFrame, name: str = "byte_bpe_50k.json", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Flat token files, one for each attempt of a partition: (files: file, length; ids: file, ordinal, doc_id), both written tables.

    Only files whose task has ended well are listed; what a failed or repeated attempt leaves beside them is never read.
    """
    spark = docs.sparkSession
    ship(spark)
    base = path or folder(spark)
    place, local = opened(base)
    place.create_dir(local, recursive=True)

    def run(batches):
        own, file, end = _encoder(name), f"{base}/{uuid.uuid4().hex}.ids", array("H", [SEPARATOR]).tobytes()
        made = lambda length, first, ids: pa.RecordBatch.from_arrays([
            pa.array([file]), pa.array([length], pa.int64()), pa.array([first], pa.int64()), pa.array([ids], pa.list_(pa.int64()))], names=["file", "length", "first", "ids"])
        ordinal = size = 0
        system, at = opened(file)
        with system.open_output_stream(at) as out:
            for batch in slices(batches):
                flat = b"".join(t + end for t in own.flat(batch.column("text").to_pylist()))
                out.write(flat)
                yield made(None, ordinal, batch.column("doc_id").to_pylist())
                ordinal, size = ordinal + batch.num_rows, size + len(flat)
        yield made(size, None, None)

    made = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "file string, length long, first long, ids array<long>"))
    ids = made.where("length IS NULL").select("file", "first", F.posexplode("ids").alias("n", "doc_id"))
    return made.where("length > 0").select("file", "length"), ids.select("file", (F.col("first") + F.col("n")).alias("ordinal"), "doc_id")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(file, length) of the files under a path, empty ones left out."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select(F.col("path").alias("file"), "length").where("length > 0")


def ranges(files: DataFrame, block: int = BLOCK, width: int = WIDTH) -> DataFrame:
    """(file, block, start, size): the byte ranges of the blocks of files (file, length), dealt out over the tasks."""
    whole = F.col("length") - F.col("length") % width
    each = files.where(whole > 0).select("file", whole.alias("length"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((whole - 1) / block).cast("long"))).alias("block"))
    start = F.col("block") * block
    return each.select("file", "block", start.alias("start"), F.least(F.lit(block), F.col("length") - start).alias("size"))


SUMMARY = "file string, block long, size long, seps long, head long, tail long, inner array<long>, starts array<long>"


def _scanned(width: int, separator: int):
    def run(batches):
        at_file, source = None, None
        for batch in batches:
            size, seps, head, tail, inner, starts = [], [], [], [], [], []
            for file, start, n in zip(*(batch.column(c).to_pylist() for c in ("file", "start", "size")), strict=True):
                if file != at_file:
                    if source:
                        source.close()
                    system, path = opened(file)
                    at_file, source = file, system.open_input_file(path)
                a = np.frombuffer(source.read_at(n, start), f"<u{width}")
                at = np.flatnonzero(a == separator)
                size.append(len(a))
                seps.append(len(at))
                head.append(int(at[0]) if len(at) else len(a))
                tail.append(len(a) - 1 - int(at[-1]) if len(at) else len(a))
                inner.append((np.diff(at) - 1).astype(np.int64))
                starts.append((at[:-1] + 1).astype(np.int64))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (inner, starts)]
            numbers = [pa.array(x, pa.int64()) for x in (size, seps, head, tail)]
            yield pa.RecordBatch.from_arrays([batch.column("file"), batch.column("block"), *numbers, *lists], schema=arrow)
        if source:
            source.close()

    longs = ("block", "size", "seps", "head", "tail")
    arrow = pa.schema([("file", pa.string()), *((c, pa.int64()) for c in longs), ("inner", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))])
    return run


def count(files: DataFrame, width: int = WIDTH, separator: int = SEPARATOR, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """One row per document of the files (file, length): file, ordinal, start (token of its file), n_tokens, terminated."""
    spark = files.sparkSession
    ship(spark)
    # Blocks are dealt by number, so that all tasks read all parts of a large file.
    dealt = ranges(files, block, width).repartition(F.col("file"), F.floor(F.col("block") / group))
    found = materialize(dealt.mapInArrow(_scanned(width, separator), SUMMARY)).withColumn("part", F.floor(F.col("block") / group))
    in_part = W.partitionBy("file", "part").orderBy("block")
    before = in_part.rowsBetween(W.unboundedPreceding, -1)
    placed = found.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    placed = placed.withColumn("closed", F.when(F.col("seps") > 0, F.col("offset") + F.col("size") - F.col("tail")))
    placed = placed.select("*", F.max("closed").over(before).alias("open_at"), F.coalesce(F.sum("seps").over(before), F.lit(0)).alias("ordinal"))
    # One row a group of blocks: 8 MB of a file.
    slim = found.select("file", "part", "block", "size", "seps", "tail")
    sizes = slim.withColumn("offset", F.coalesce(F.sum("size").over(before), F.lit(0)))
    parts = sizes.groupBy("file", "part").agg(F.sum("size").alias("size"), F.sum("seps").alias("seps"), F.max(F.when(F.col("seps") > 0, F.col("offset") + F.col("size") - F.col("tail"))).alias("closed"))
    by_file = W.partitionBy("file").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("size").over(by_file), F.lit(0)))
    parts = parts.withColumn("end", F.col("base") + F.col("closed"))
    parts = parts.select("file", "part", "base", "size", "end", "seps", F.coalesce(F.max("end").over(by_file), F.lit(0)).alias("base_open"), F.coalesce(F.sum("seps").over(by_file), F.lit(0)).alias("base_seps"))
    parts = materialize(parts)

    bases = parts.select("file", "part", "base", "base_open", "base_seps")
    whole = placed.where("seps > 0").join(bases, ["file", "part"])
    open_at = F.coalesce(F.col("base") + F.col("open_at"), F.col("base_open"))
    offset = F.col("base") + F.col("offset")
    starts = F.concat(F.array(open_at), F.transform("starts", lambda x: x + offset))
    lengths = F.concat(F.array(offset - open_at + F.col("head")), "inner")
    closed = whole.select("file", (F.col("base_seps") + F.col("ordinal")).alias("first"), F.posexplode(F.arrays_zip(lengths.alias("n_tokens"), starts.alias("start"))).alias("n", "doc"))
    closed = closed.select("file", (F.col("first") + F.col("n")).alias("ordinal"), "doc.start", "doc.n_tokens", F.lit(True).alias("terminated"))
    ends = parts.groupBy("file").agg(F.sum("size").alias("size"), F.sum("seps").alias("ordinal"), F.coalesce(F.max("end"), F.lit(0)).alias("start"))
    rest = ends.select("file", "ordinal", "start", (F.col("size") - F.col("start")).alias("n_tokens"), F.lit(False).alias("terminated"))
    return closed.unionAll(rest.where("n_tokens > 0"))


def count_documents(docs: DataFrame) -> DataFrame:
    """Documents written to flat files and counted by the scan: doc_id, n_tokens, ordinal (in its file)."""
    files, ids = write(docs)
    return count(files, block=BLOCK).join(ids, ["file", "ordinal"]).select("doc_id", "n_tokens", "ordinal")
