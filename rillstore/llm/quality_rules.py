"""Quality rules with repetition coverage.

Counts words, symbols and repeated lines of every whole text, then measures which share of its characters lies
inside word n-grams of several lengths that occur twice or more, and inside repeated lines.

Defined cases: a null or empty text has no words and fails; repeated rows are judged alike; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .runtime import map_slices

#: Share of the word characters that may lie in repeated n-grams of a length, and in repeated lines.
MOST = {5: 0.50, 7: 0.45, 10: 0.40}
MOST_LINES = 0.60

WORD = re.compile("[^\x20\x09-\x0d]+")
SYMBOLS = "#*$%&|<>"
STRIP = "\x20\x09\x0a\x0b\x0c\x0d"
MUL = np.uint64(0x9E3779B97F4A7C15)

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, " + ", ".join(f"cover_{n} double" for n in MOST) + ", cover_lines double"


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that sums of products of small ids spread over all bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def repeated(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more within their document."""
    if not len(keys):
        return np.zeros(0, bool)
    order = np.lexsort((keys, doc))
    k, d = keys[order], doc[order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    out = np.zeros(len(keys), bool)
    out[order] = np.r_[False, same] | np.r_[same, False]
    return out


def covered(hits: np.ndarray, n: int) -> np.ndarray:
    """Words inside any window of n words that starts at a hit; hits has one entry for each word."""
    edge = np.zeros(len(hits) + n, np.int32)
    at = np.flatnonzero(hits)
    edge[at] += 1
    edge[at + n] -= 1
    return np.cumsum(edge)[: len(hits)] > 0


def measure(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The counts and coverages of a batch of texts; words of all texts lie in one array."""
    ids: dict[str, int] = {}
    words, ends, n_words, line_dup, line_chars, symbols = [], [], [], [], [], []
    for t in texts:
        t = t or ""
        w = WORD.findall(t)
        words.extend(w)
        n_words.append(len(w))
        symbols.append(sum(map(t.count, SYMBOLS)))
        seen, dup, chars = set(), 0, 0
        for line in t.split("\n"):
            if line.strip(STRIP):
                if line in seen:
                    dup += 1
                    chars += sum(map(len, WORD.findall(line)))
                else:
                    seen.add(line)
        line_dup.append(dup)
        line_chars.append(chars)
    setdefault = ids.setdefault
    word = np.fromiter((setdefault(w, len(ids)) for w in words), np.uint64, len(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    n_words = np.array(n_words, np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), n_words)
    last = np.repeat(np.cumsum(n_words), n_words)  # where each word's document ends
    at = np.arange(len(words))

    def per_doc(flags: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        picked = doc[flags]
        return np.bincount(picked, None if weights is None else weights[flags], len(texts)).astype(np.int64)

    def windows(keys: np.ndarray, n: int) -> np.ndarray:
        """keys: of the windows of n words, by first word; the windows that cross an end don't count."""
        start = np.flatnonzero(at + n <= last)
        hits = np.zeros(len(words), bool)
        hits[start] = repeated(keys[start], doc[start])
        return covered(hits, n)

    # Windows of three words are compared exactly: pairs get ranks, then pairs of rank and word are one integer.
    pair = (word << np.uint64(32)) | np.r_[word[1:], np.zeros(min(1, len(word)), np.uint64)]
    rank = np.unique(pair, return_inverse=True)[1].astype(np.uint64)
    three = (rank << np.uint64(32)) | np.r_[word[2:], np.zeros(min(2, len(word)), np.uint64)]
    out = {"n_words": n_words, "word_chars": per_doc(np.ones(len(words), bool), size), "n_symbols": np.array(symbols, np.int64), "n_dup_lines": np.array(line_dup, np.int64), "n_repeat_words": per_doc(windows(three, 3))}
    rolled, spread, total = np.zeros(len(words), np.uint64), mixed((word + np.uint64(1)) * MUL), np.maximum(out["word_chars"], 1)
    for k in range(max(MOST)):
        later = np.zeros(len(words), np.uint64)
        later[: max(0, len(words) - k)] = spread[k:]
        rolled = rolled * MUL + later
        if k + 1 in MOST:
            out[f"cover_{k + 1}"] = per_doc(windows(rolled, k + 1), size) / total
    out["cover_lines"] = np.array(line_chars) / total
    out["base_failed"] = (n_words < 50) | (100 * out["n_repeat_words"] > 50 * n_words)
    bad = out["cover_lines"] > MOST_LINES
    for n, most in MOST.items():
        bad |= out[f"cover_{n}"] > most
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def rules(docs: DataFrame) -> DataFrame:
    """One row per document: counts, coverages, base_failed and kept."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = measure(batch.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(found[n]) for n in names[1:])], names=names)

    return map_slices(docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text"), judge, SCHEMA)
