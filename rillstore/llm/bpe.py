"""Byte-level BPE encoding and decoding with a lexicon automaton.

The corpus's frequent words are counted over all documents, encoded once, and compiled into a minimal acyclic
transducer (lexicon.py) with their ids as outputs. Every task maps that file into memory and looks words up in it;
words that it lacks are merged exactly by the vocabulary's ranks. Decoding turns ids into bytes and reads them as
UTF-8. Ids equal those of the tokenizers library with add_special_tokens=False, special tokens in a text included.

Defined cases: a null text is encoded as an empty one (no ids, empty decoded text); repeated rows are encoded
alike; a text, and a word, of any length is encoded whole; words of equal count enter the lexicon together or not at all, so with
more than its limit of the same count it may be empty and all words are merged; a kept column with the name of a
result is called kept_<name>; an empty table gives an empty result and an empty lexicon.
"""

from __future__ import annotations

import hashlib
import heapq
import json

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import Lexicon, compile_words, mapped
from .runtime import kept, map_slices, materialize, packed, ship, unpacked

#: Words in the lexicon; the file then has a few MB, whatever the corpus's size.
LEXICON_WORDS = 120_000
#: Words that a worker remembers before it forgets those that aren't in the lexicon.
REMEMBERED = 150_000

#: The name of what a worker keeps between tasks.
KEPT = "bpe encoders"

NO_MERGE = 1 << 62

# Fixed value: the vocabulary's own pattern of pieces.
PATTERN = public_tokenizers.PATTERN


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE vocabulary of a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of = byte_alphabet()
        raw = lambda token: bytes(of[c] for c in token)
        self.id_of = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        # left id and right id as one integer -> rank and merged id as one integer, which sorts by rank
        self.merged = {}
        for n, (a, b) in enumerate(pairs):
            a, b = raw(a), raw(b)
            self.merged[self.id_of[a] << 17 | self.id_of[b]] = n << 17 | self.id_of[a + b]
        self.shift = 64 - max(1, 2 * len(self.merged)).bit_length()
        self.keys, self.values = self._table()
        self.byte_id = [self.id_of[bytes([b])] for b in range(256)]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: t.encode() for t, i in self.special.items()}
        self.csv_of = {i: str(i) for i in self.bytes_of}
        self.size_of = np.zeros(max(self.bytes_of) + 1, np.int64)
        self.size_of[list(self.bytes_of)] = list(map(len, self.bytes_of.values()))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN).findall

    def split(self, text: str) -> list[str]:
        """The pieces of a text; special tokens are pieces of their own."""
        if not self.special or not any(s in text for s in self.special):
            return self.pieces(text)
        out: list[str] = []
        for part in self.cut.split(text):
            out.extend([part] if part in self.special else self.pieces(part))
        return out

    def merge(self, word: bytes) -> list[int]:
        """The ids of one piece: the pair of the lowest rank is merged, the leftmost first, until none is left."""
        if len(word) > 200:
            return self._merge_long(word)
        byte_id, merged = self.byte_id, self.merged.get
        ids = [byte_id[b] for b in word]
        found = [merged(a << 17 | b, NO_MERGE) for a, b in zip(ids, ids[1:], strict=False)]
        while found and (best := min(found)) != NO_MERGE:
            i = found.index(best)
            ids[i] = best & 0x1FFFF
            del ids[i + 1], found[i]
            if i < len(found):
                found[i] = merged(ids[i] << 17 | ids[i + 1], NO_MERGE)
            if i:
                found[i - 1] = merged(ids[i - 1] << 17 | ids[i], NO_MERGE)
        return ids

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and values of `merged` by slot: a pair lies in its slot or one of those that follow without a gap; -1 is a free slot."""
        key, value = (np.fromiter(x, np.int64, len(self.merged)) for x in (self.merged.keys(), self.merged.values()))
        keys = np.full(1 << 64 - self.shift, -1, np.int64)
        values, at = np.full(len(keys), NO_MERGE, np.int64), self._slot(key)
        while len(key):
            free = keys[at] < 0
            keys[at[free]] = key[free]  # of several for one slot the last stays
            put = keys[at] == key
            values[at[put]] = value[put]
            key, value, at = key[~put], value[~put], (at[~put] + 1) % len(keys)
        return keys, values

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        shape, key = left.shape, (left << 17 | right).ravel()
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.values[at], NO_MERGE)
        left_over = np.flatnonzero((there != key) & (there >= 0))
        key, at = key[left_over], at[left_over]
        while len(left_over):
            at = (at + 1) % len(self.keys)
            there = self.keys[at]
            found, more = there == key, (there != key) & (there >= 0)
            out[left_over[found]] = self.values[at[found]]
            left_over, key, at = left_over[more], key[more], at[more]
        return out.reshape(shape)

    def merge_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of many words: all ids, and how many of each word; words of equal length go through their merges side by side."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by_size.setdefault(len(w), []).append(i)
        byte_id = np.array(self.byte_id, np.int64)
        for size, group in by_size.items():
            if size > 48 or len(group) < 16:
                done.extend((np.array([i]), np.array([self.merge(words[i])], np.int64)) for i in group)
                continue
            rows = np.array(group)
            ids = byte_id[np.frombuffer(b"".join([words[i] for i in group]), np.uint8).reshape(len(group), size)]
            found = self._pairs(ids[:, :-1], ids[:, 1:])
            while True:
                # Every row has the same number of parts here: each step merges one pair of each row that has any.
                each = np.arange(len(rows))
                at = found.argmin(1) if found.shape[1] else np.zeros(len(rows), np.int64)
                best = found[each, at] if found.shape[1] else np.full(len(rows), NO_MERGE)
                over = best == NO_MERGE
                done.append((rows[over], ids[over]))
                if over.all():
                    break
                rows, ids, found, at, best = rows[~over], ids[~over], found[~over], at[~over], best[~over]
                each, width = np.arange(len(rows)), ids.shape[1] - 1
                ids[each, at] = best & 0x1FFFF
                col = np.arange(width)
                ids = np.take_along_axis(ids, col + (col > at[:, None]), 1)
                col = col[:-1]
                found = np.take_along_axis(found, col + (col >= at[:, None]), 1)
                right = np.flatnonzero(at < width - 1)
                found[right, at[right]] = self._pairs(ids[right, at[right]], ids[right, at[right] + 1])
                left = np.flatnonzero(at > 0)
                found[left, at[left] - 1] = self._pairs(ids[left, at[left] - 1], ids[left, at[left]])
        sizes = np.zeros(len(words), np.int64)
        for rows, ids in done:
            sizes[rows] = ids.shape[1]
        out = np.zeros(sizes.sum(), np.int64)
        start = np.cumsum(sizes) - sizes
        for rows, ids in done:
            out[start[rows][:, None] + np.arange(ids.shape[1])] = ids
        return out, sizes

    def _merge_long(self, word: bytes) -> list[int]:
        """The same for a long piece, with a heap over a linked list: its time grows as n log n."""
        ids, n, merged = [self.byte_id[b] for b in word], len(word), self.merged.get
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merged(ids[i] << 17 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], after[i] = m & 0x1FFFF, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0 and (m := merged(ids[k] << 17 | ids[after[k]])) is not None:
                    heapq.heappush(heap, (m, k, ids[k], ids[after[k]]))
        return [ids[i] for i in range(n) if alive[i]]

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run of that size, one run after the other."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


class Encoder:
    """Pieces to ids: remembered, or in the lexicon, or merged."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        #: What is made of the ids of pieces in the lexicon, which stay, and of others, which are forgotten in time.
        self.known: dict[str, str] = {}
        self.rare: dict[str, str] = {}
        #: What pieces decode to that don't decode to themselves.
        self.odd: dict[str, str] = {}

    def made(self, ids: list[int], ends: list[int]) -> list:
        """The ids of each piece, joined by commas. ids: of all pieces; ends: where each piece's end."""
        text = list(map(self.vocabulary.csv_of.__getitem__, ids))
        return [",".join(text[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, pieces: set[str]) -> dict:
        """What is made of the ids of each of the pieces."""
        unknown = [p for p in pieces if p not in self.known]
        new = [p for p in unknown if p not in self.rare]
        if len(self.known) + len(self.rare) + len(new) > REMEMBERED:
            self.rare.clear()
            new = unknown
        v = self.vocabulary
        words = [p.encode() for p in new]
        ranks = self.lexicon.ranks(words)
        ranks[[i for i, p in enumerate(new) if p in v.special]] = -2
        listed, merged, own = (np.flatnonzero(x) for x in (ranks >= 0, ranks == -1, ranks == -2))
        parts = [(listed, *self.lexicon.many(ranks[listed])), (merged, *v.merge_many([words[i] for i in merged.tolist()]))]
        parts.append((own, np.array([v.special[new[i]] for i in own.tolist()], np.int64), np.ones(len(own), np.int64)))
        size = np.zeros(len(new), np.int64)
        for at, _, n in parts:
            size[at] = n
        ends, ids = np.cumsum(size), np.zeros(size.sum(), np.int64)
        for at, found, n in parts:
            ids[_runs((ends - size)[at], n)] = found
        flat = ids.tolist()
        self.decode(new, words, ids, flat, ends)
        found = list(zip(new, self.made(flat, ends.tolist()), strict=True))
        self.known.update(found[i] for i in listed.tolist())
        self.rare.update(found[i] for i in merged.tolist() + own.tolist())
        return self.known | {p: self.rare[p] for p in unknown if p in self.rare}

    def decode(self, pieces: list[str], words: list[bytes], ids: np.ndarray, flat: list[int], ends: np.ndarray) -> None:
        """Decodes the ids of the pieces side by side; odd gets the pieces whose ids decode to something else."""
        v = self.vocabulary
        raw = b"".join(map(v.bytes_of.__getitem__, flat))
        at = np.r_[0, np.cumsum(v.size_of[ids])][ends]
        if raw != b"".join(words) or not np.array_equal(at, np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))):
            for piece, start, end in zip(pieces, [0, *at.tolist()], at.tolist(), strict=False):
                if (text := raw[start:end].decode("utf-8", "replace")) != piece:
                    self.odd[piece] = text

    def batch(self, texts: list[str | None]) -> list[tuple[str, str]]:
        """Of each text: its ids joined by commas, and what they decode to."""
        cut = [self.vocabulary.split(t or "") for t in texts]
        csv, odd = self.learn(set().union(*cut)), self.odd
        # A piece is whole characters, so a text decodes piece by piece.
        return [(",".join([csv[p] for p in own]), "".join([odd.get(p, p) for p in own] if odd else own)) for own in cut]


def encoder(name: str, lexicon: Broadcast) -> Encoder:
    """This worker's encoder for a vocabulary and a lexicon."""
    blob = lexicon.value
    key, encoders = (name, hashlib.sha256(blob).hexdigest()), kept(KEPT)
    if key not in encoders:
        encoders.clear()
        encoders[key] = Encoder(Vocabulary(public_tokenizers.path(name)), mapped(blob))
    return encoders[key]


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[str]:
    """The most frequent pieces of a space and letters, counted over all whole texts, `most` at most; words of equal count come together or not at all."""
    words = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("w"))
    counts = words.where((F.octet_length("w") > 0) & (F.octet_length("w") <= 40)).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    letters = materialize(counts.where((F.col("n") > 1) & F.col("w").rlike(r"^\p{L}+$")))
    # The number of words of each count, from the top: the last count that still fits wholly, so that no task gathers `most` words.
    least, total = None, 0
    for r in letters.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).toLocalIterator():
        if total + r.words > most:
            break
        least, total = r.n, total + r.words
    return [] if least is None else [" " + r.w for r in letters.where(F.col("n") >= least).select("w").collect()]


def build_lexicon(docs: DataFrame, name: str, most: int = LEXICON_WORDS) -> Broadcast:
    """The compiled lexicon of a corpus, at most a few MB for `most` words."""
    vocabulary = Vocabulary(public_tokenizers.path(name))
    words = {w.encode() for w in frequent_words(docs, most)}
    return docs.sparkSession.sparkContext.broadcast(compile_words((w, tuple(vocabulary.merge(w))) for w in words))


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]), pa.int32()))


def encode(docs: DataFrame, keep: list[str], name: str = "byte_bpe_50k.json", lexicon: Broadcast | None = None, with_ids: bool = True) -> DataFrame:
    """The columns of `keep` and n_tokens, ids_sha256, decoded_sha256; with_ids adds ids and decoded."""
    ship(docs.sparkSession)
    lexicon = lexicon or build_lexicon(docs, name)
    results = T.StructType.fromDDL("n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))
    taken = packed(docs, keep, results.names)

    made: list[Encoder] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.append(encoder(name, lexicon))
        own = made[0]
        n, ids_sha, text_sha, ids, decoded = [], [], [], [], []
        for joined, text in own.batch(batch.column("text").to_pylist()):
            n.append(joined.count(",") + 1 if joined else 0)
            ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
            text_sha.append(hashlib.sha256(text.encode()).hexdigest())
            if with_ids:
                ids.append(np.fromstring(joined, np.int32, sep=","))
                decoded.append(text)
        arrays = [batch.column("kept"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
        arrays += [_lists(ids), pa.array(decoded, pa.string())] if with_ids else []
        return pa.RecordBatch.from_arrays(arrays, names=["kept", *results.names])

    return unpacked(map_slices(taken, run, T.StructType([taken.schema["kept"], *results]), keeps=KEPT), keep, *results.names)
