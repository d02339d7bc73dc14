"""Benchmark decontamination: edit-distance search by CGK embedding and bit-sampling LSH.

Texts and items are normalised (lower case, runs of other characters than letters and digits become one space).
A document leaks an item if some window that starts at a word is within `EDITS` x the item's length of it in edit
distance. Candidate windows come from CGK random walks: a walk reads a string byte by byte and at each step either
stays or advances, by a shared random function of step and byte; near strings give walks that agree in most steps.
Each repetition has its own walk and samples a few steps of it as a hash; windows that share a hash with an item of
their size class are verified exactly. Windows are first thinned without loss: k edits spoil at most k * GRAM of an
item's GRAM-grams, so a matching window holds at least n - GRAM + 1 - k * GRAM of them. Items for which that asks for no
gram, those below 20 bytes, have size classes of their own, for which no window is thinned.

Walks sample more steps near their start, where fewer edits lie behind; test_decontaminate.py measures the recall up to the
radius itself.

Defined cases: null and empty texts and items match nothing; equal items are all reported, each with its least edits and, of
ties, the first window; a text of any length is searched whole; repeated rows give repeated results; a null doc_id is carried
along; a kept column with the name of a result is called kept_<name>, others are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .runtime import map_slices, packed, ship, unpacked

#: Edits that a match may have, as a share of the item's length; the gram of the lossless thinning.
EDITS, GRAM = 0.06, 10
#: Repetitions of the walk, hashes of each, and sampled steps of a hash.
WALKS, HASHES, SAMPLED = 4, 4, 5
#: Normalised bytes of items in one block; a larger benchmark is searched in several blocks.
BLOCK_BYTES = 4_000_000

OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> bytes:
    return OTHER.sub(" ", (text or "").lower()).strip().encode()


def _grams(a: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes at each place, by doubling."""
    n = len(a) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    m = np.uint64(0x9E3779B97F4A7C15)
    two = a[:-1].astype(np.uint64) << np.uint64(8) | a[1:]
    four = two[:-2] << np.uint64(16) | two[2:]
    eight = four[:-4] << np.uint64(32) | four[4:]
    out = (eight[:n] * m) ^ (two[8 : 8 + n] * np.uint64(0xD6E8FEB86659FD93))
    return out ^ (out >> np.uint64(29))


def edits_within(item: bytes, text: bytes, most: int) -> int | None:
    """The least edit distance of the item to a beginning of the text, if it is `most` at most (bit-parallel)."""
    if text.startswith(item):
        return 0
    n, masks = len(item), {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, n
    for c in text[: n + most]:
        eq = masks.get(c, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        hp, hn = minus | (full & ~(d0 | plus)), plus & d0
        score += bool(hp & top) - bool(hn & top)
        hp, hn = (hp << 1 | 1) & full, (hn << 1) & full
        plus, minus = hn | (full & ~(d0 | hp)), hp & d0
        best = min(best, score)
    return best if best <= most else None


class Index:
    """The items of one block with their size classes, grams and hashed walks."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        found = [(i, normal(t)) for i, t in items]
        self.items = [(i, t) for i, t in found if len(t) > 0]
        sizes = np.array([len(t) for _, t in self.items], np.int64)
        self.seen = np.zeros(1 << 22, bool)
        for _, t in self.items:
            self.seen[(_grams(np.frombuffer(t, np.uint8)) >> np.uint64(42)).astype(np.int64)] = True
        self.most = [int(EDITS * n) for n in sizes]
        # Size classes are 1.2 apart; each walk of a class reads about four fifths of its smallest item.
        # An item that can lose all its grams is in a class of its own kind, so that it doesn't weaken others.
        self.classes: dict[tuple[int, bool], list[int]] = {}
        for at, n in enumerate(sizes.tolist()):
            self.classes.setdefault((int(np.log(n) / np.log(1.2)), self.grams_left(n) > 0), []).append(at)
        draw = np.random.default_rng(20)
        self.plan = []
        for members in self.classes.values():
            # Bytes that a match of this class spans at most, and grams that it holds at least.
            longest = max(len(self.items[m][1]) + self.most[m] for m in members)
            needed = max(0, min(self.grams_left(len(self.items[m][1])) for m in members))
            steps = max(1, int(1.6 * min(len(self.items[m][1]) for m in members)))
            picks = (draw.random((WALKS, HASHES, SAMPLED)) ** 1.5 * steps).astype(np.int64)
            self.plan.append((members, picks, longest, needed))
        self.steps = max((int(p.max()) + 1 for _, p, _, _ in self.plan), default=0)
        self.advance = [draw.integers(0, 2, (self.steps, 257)).astype(np.int64) for _ in range(WALKS)]
        self.tables: list[dict[bytes, list[int]]] = []
        for members, picks, _, _ in self.plan:
            rows = self._walks([self.items[m][1] for m in members])
            table: dict[bytes, list[int]] = {}
            for r in range(WALKS):
                for h in range(HASHES):
                    for m, row in zip(members, rows[r][:, picks[r, h]], strict=True):
                        table.setdefault(bytes((r, h)) + row.tobytes(), []).append(m)
            self.tables.append(table)

    @staticmethod
    def grams_left(n: int) -> int:
        """Grams of an item of n bytes that as many edits as it may have leave at least; 0 or less: none for sure."""
        return n - GRAM + 1 - int(EDITS * n) * GRAM

    def _walks(self, texts: list[bytes]) -> list[np.ndarray]:
        flat = np.frombuffer(b"".join(texts), np.uint8)
        size = np.array([len(t) for t in texts], np.int64)
        return self.walks(flat, np.cumsum(size) - size, np.cumsum(size))

    def walks(self, flat: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """What each walk reads at each step from each start; 256 past the end."""
        out, padded = [], np.r_[flat.astype(np.uint16), np.uint16(256)]
        for advance in self.advance:
            at, read = start.copy(), np.empty((self.steps, len(start)), np.uint16)
            for j in range(self.steps):
                c = padded[np.where(at < end, at, len(flat))]
                read[j] = c
                at += advance[j][c]
            out.append(read.T)
        return out

    def starts(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word starts whose window holds enough grams of items for some size class, and for which; the lossless thinning."""
        words = np.flatnonzero(np.r_[True, flat[:-1] == 32]) if len(flat) else np.zeros(0, np.int64)
        hit = self.seen[(_grams(flat) >> np.uint64(42)).astype(np.int64)]
        total = np.r_[0, np.cumsum(hit)]
        if not self.plan or int(total[-1]) < min(needed for *_, needed in self.plan):
            return words[:0], np.zeros((0, len(self.plan)), bool)
        first = total[np.minimum(words, len(hit))]
        fits = np.stack([total[np.minimum(words + longest, len(hit))] - first >= needed for *_, longest, needed in self.plan], 1)
        some = fits.any(1)
        return words[some], fits[some]

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(text's number, item's number, least edits, byte of the normalised text where that window starts)."""
        raws, starts, owner, fits = [normal(t) for t in texts], [], [], []
        base = 0
        for n, raw in enumerate(raws):
            found, fit = self.starts(np.frombuffer(raw, np.uint8))
            fits.append(fit)
            starts.append(found + base)
            owner.append(np.full(len(found), n))
            base += len(raw)
        flat, at, doc = np.frombuffer(b"".join(raws), np.uint8), np.concatenate([np.zeros(0, np.int64), *starts]), np.concatenate([np.zeros(0, np.int64), *owner])
        fit = np.concatenate([np.zeros((0, len(self.plan)), bool), *fits])
        ends = np.cumsum([len(r) for r in raws])
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for lo in range(0, len(at), 4096):
            some, own = at[lo : lo + 4096], doc[lo : lo + 4096]
            rows = self.walks(flat, some, ends[own])
            tried: set[tuple[int, int]] = set()
            for c, ((_, picks, _, _), table) in enumerate(zip(self.plan, self.tables, strict=True)):
                fitting = np.flatnonzero(fit[lo : lo + 4096, c])
                for r in range(WALKS):
                    for h in range(HASHES):
                        keys = np.ascontiguousarray(rows[r][fitting[:, None], picks[r, h]])
                        raw, width, lead = keys.tobytes(), SAMPLED * 2, bytes((r, h))
                        for w, at_w in enumerate(fitting.tolist()):
                            if members := table.get(lead + raw[w * width : (w + 1) * width]):
                                tried.update((at_w, m) for m in members)
            for w, m in sorted(tried):
                n, place = int(own[w]), int(some[w] - (ends[own[w]] - len(raws[own[w]])))
                if (known := best.get((n, m))) and known[0] == 0:
                    continue
                item, most = self.items[m][1], self.most[m]
                d = edits_within(item, raws[n][place : place + len(item) + most], most)
                if d is not None and (known is None or d < known[0]):
                    best[n, m] = d, place
        return [(n, m, d, p) for (n, m), (d, p) in sorted(best.items())]


def blocks(items: DataFrame, most: int) -> list[list[tuple]]:
    """The items (item_id, text) in blocks of about `most` bytes; each is gathered by itself."""
    size = items.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // most) or 1
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        yield [tuple(r) for r in items.select("item_id", "text").where(F.col("text").isNotNull() & (part == b)).collect()]


_INDEXES: dict[str, Index] = {}


def _index(key: str, shared: Broadcast) -> Index:
    """This worker's index of a block; it keeps one at a time."""
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(shared.value)
    return _INDEXES[key]


def _searched(docs: DataFrame, items: DataFrame, most: int, schema: T.StructType, pick) -> DataFrame:
    """docs through one search after the other, one for each block of items; pick makes a batch's result of its matches."""
    ship(docs.sparkSession)
    for block in blocks(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), most):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # at most about `most` bytes
        key = hashlib.sha256(repr(block).encode()).hexdigest()

        def run(batch: pa.RecordBatch, shared=shared, key=key) -> pa.RecordBatch:
            index = _index(key, shared)
            return pick(batch, index, index.search(batch.column("text").to_pylist()))

        yield lambda df, run=run: map_slices(df, run, schema)


def leaks(docs: DataFrame, items: DataFrame, keep: list[str], most: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs and item that it leaks: the columns of `keep`, item_id, edits, place (in the normalised text)."""
    results = T.StructType.fromDDL("item_id long, edits int, place int")
    taken = packed(docs, keep, results.names)

    def pick(batch: pa.RecordBatch, index: Index, found: list[tuple]) -> pa.RecordBatch:
        kept = batch.column("kept").take(pa.array([n for n, *_ in found], pa.int64()))
        arrays = [kept, pa.array([index.items[m][0] for _, m, _, _ in found], pa.int64())]
        arrays += [pa.array([d for _, _, d, _ in found], pa.int32()), pa.array([p for *_, p in found], pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=["kept", *results.names])

    out = None
    for search in _searched(docs, items, most, T.StructType([taken.schema["kept"], *results]), pick):
        found = search(taken)
        out = found if out is None else out.unionAll(found)
    return unpacked(out, keep, *results.names)


def clean(docs: DataFrame, items: DataFrame, most: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, that leak no item."""
    taken = packed(docs, docs.columns)

    def pick(batch: pa.RecordBatch, index: Index, found: list[tuple]) -> pa.RecordBatch:
        bad = {n for n, *_ in found}
        return batch.filter(pa.array([i not in bad for i in range(batch.num_rows)], pa.bool_()))

    for search in _searched(docs, items, most, taken.schema, pick):
        taken = search(taken)
    return taken.select("kept.*")
