"""Substring deduplication by content-defined chunks.

A gear rolling hash over the UTF-8 bytes cuts a text wherever some bits of the hash are zero; the hash depends on the
last 16 bytes only, so an insertion moves no cut but those near it. From every chunk on, the chunks that reach
`LEAST_SPAN` characters together are a window, the least that counts as a passage. Windows are compared by 128-bit digest
over the whole corpus. Each has a partner, its first occurrence elsewhere (for the first one the last); neighbouring windows
whose partners lie side by side in one document too join to a span, so a span occurs there as a whole, word for word. Of each
window the first occurrence (least row, then place) is the one to keep.

Parts of a passage outside whole chunks, less than a chunk at either end, are not in its span; test_substring_dedup.py measures how
many passages are missed for that.

Defined cases: null and empty texts, and those below `LEAST_SPAN` characters, have no windows; windows that only one row repeats
count if `within` is asked for; repeated rows repeat each other, and the first keeps its text; a very long text has as many
windows as chunks, which meet in one task; doc_id need not be unique; extra columns travel in a struct, whatever their names;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import map_slices, materialize, packed

#: Bytes of a chunk: at least, at most; a cut about every 32 bytes beyond the least.
LEAST, MOST = 16, 256
#: Bits of the 16-bit hash that must be zero at a cut.
MASK = np.uint16(0x1F << 11)
#: Characters of a window, the least repeated passage.
LEAST_SPAN = 56

GEAR = np.random.default_rng(1).integers(0, 1 << 16, 256).astype(np.uint16)


def gear(raw: np.ndarray) -> np.ndarray:
    """h[i] = (h[i-1] << 1) + GEAR[raw[i]] in 16 bits, for all places at once: sums of 2, 4, 8 and 16 terms."""
    h = GEAR[raw]
    for k in (1, 2, 4, 8):
        h[k:] = h[k:] + (h[:-k] << np.uint16(k))
    return h


def cuts(raw: bytes) -> list[int]:
    """The ends of a text's chunks, all between characters."""
    a = np.frombuffer(raw, np.uint8)
    out, last = [], 0
    inner = (a & 0xC0) == 0x80  # bytes within a character
    for c in [*(np.flatnonzero((gear(a) & MASK) == 0) + 1).tolist(), len(a)]:
        while c - last > MOST:
            last += MOST
            while inner[last]:
                last -= 1
            out.append(last)
        if c - last >= LEAST:
            while c < len(a) and inner[c]:
                c += 1
            out.append(c)
            last = c
    if last < len(a):
        out.append(len(a))
    return out


def windows(ends: list[int], chars: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """First chunk and last chunk of every window. chars: characters before the end of each chunk."""
    before = np.r_[0, chars[:-1]]
    last = np.searchsorted(chars, before + least)
    first = np.flatnonzero(last < len(ends))
    return first, last[first]


def _windowed(batch: pa.RecordBatch, least: int) -> pa.RecordBatch:
    digests, rows, source, at, end = [], [], [], [], []
    for n, (row, text) in enumerate(zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True)):
        if not text or len(text) < least:
            continue
        raw = text.encode()
        ends = cuts(raw)
        chars = np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)[np.array(ends) - 1]
        first, last = windows(ends, chars, least)
        starts = [0, *ends]
        digests += [xxhash.xxh3_128_digest(raw[starts[i] : ends[j]]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
        rows.append(np.full(len(first), row))
        source.append(np.full(len(first), n))
        at.append(np.r_[0, chars][first])
        end.append(chars[last])
    whole = lambda x, kind: pa.array(np.concatenate([np.zeros(0, np.int64), *x]).astype(kind))
    halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), whole(rows, np.int64), whole(at, np.int32), whole(end, np.int32), batch.column("doc_id").take(whole(source, np.int64))], names=["hi", "lo", "row", "at", "end", "doc_id"])


def merged(parts: list[tuple[int, int]]) -> list[dict]:
    """The union of (start, end) sorted by start."""
    out: list[dict] = []
    for at, end in parts:
        if out and at <= out[-1]["end"]:
            out[-1]["end"] = max(end, out[-1]["end"])
        else:
            out.append({"at": at, "end": end})
    return out


def spans(parts: list[dict]) -> list[dict]:
    """Windows (at, end, other row, place there) sorted by place, joined where they lie side by side here and there."""
    out: list[dict] = []
    last = None
    for p in parts:
        where = p["other"]["row"], p["other"]["at"] - p["at"]
        if where == last and p["at"] <= out[-1]["end"]:
            out[-1]["end"] = max(p["end"], out[-1]["end"])
        else:
            out.append({"at": p["at"], "end": p["end"]})
        last = where
    return out


def _joined(batch: pa.RecordBatch) -> pa.RecordBatch:
    parts = batch.column("parts").to_pylist()
    kind = pa.list_(pa.struct([("at", pa.int32()), ("end", pa.int32())]))
    cut = [merged([(p["at"], p["end"]) for p in own if not p["first"]]) for own in parts]
    return pa.RecordBatch.from_arrays([batch.column("row"), pa.array(list(map(spans, parts)), kind), pa.array(cut, kind)], names=["row", "spans", "cut"])


def window_table(texts: DataFrame, least: int = LEAST_SPAN) -> DataFrame:
    """The windows of texts (row, doc_id, text): hi, lo, row, at, end, doc_id; a written table, so row numbers stay."""
    own = texts.select("row", F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(map_slices(own, lambda batch: _windowed(batch, least), "hi long, lo long, row long, at int, end int, doc_id long"))


def repeated(own: DataFrame, within: bool = False) -> DataFrame:
    """The rows with repeated passages: row, spans, cut (arrays of at, end in characters). Spans with different partners may overlap."""
    place = F.struct("row", "at")
    ends = own.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # Written, so that the join has exchanges of its own and a passage in a third of all documents is split among tasks.
    shared = materialize(ends.where("first < last" if within else "first.row < last.row"))
    hits = own.join(shared, ["hi", "lo"])
    is_first = place == F.col("first")
    part = F.struct("at", "end", F.when(is_first, F.col("last")).otherwise(F.col("first")).alias("other"), is_first.alias("first"))
    parts = hits.select("row", part.alias("part")).groupBy("row").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    kind = "array<struct<at:int,end:int>>"
    return parts.mapInArrow(lambda batches: map(_joined, batches), f"row long, spans {kind}, cut {kind}")


def passages(docs: DataFrame, doc_id: str = "doc_id", within: bool = False) -> DataFrame:
    """One row per row of docs with repeated passages: doc_id, spans, cut. Texts are read once and not kept."""
    own = window_table(packed(docs, [doc_id]).select(F.col("kept").getField(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("row"), "text"))
    names = own.where("at = 0").select("row", "doc_id")
    return repeated(own, within).join(names, "row").select("doc_id", "spans", "cut")


def deduplicate(docs: DataFrame, within: bool = False) -> DataFrame:
    """docs with all but the first occurrence of every repeated passage cut from the texts; rows and columns stay."""
    cols = docs.columns
    numbered = materialize(packed(docs, cols).withColumn("row", F.monotonically_increasing_id()))
    found = repeated(window_table(numbered.select("row", F.lit(None).alias("doc_id"), "text")), within)
    joined = numbered.join(found.select("row", "cut"), "row", "left")

    def shorten(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for text, cut in zip(batch.column("text").to_pylist(), batch.column("cut").to_pylist(), strict=True):
            if cut:
                edges = [0, *(x for c in cut for x in (c["at"], c["end"])), len(text)]
                text = "".join(text[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))
            texts.append(text)
        return pa.RecordBatch.from_arrays([batch.column("kept"), pa.array(texts, pa.string())], names=["kept", "text"])

    left = map_slices(joined.select("kept", "text", "cut"), shorten, numbered.select("kept", "text").schema)
    return left.select(*[(F.col("text") if c == "text" else F.col("kept").getField(c)).alias(c) for c in cols])
