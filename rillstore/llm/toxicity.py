"""Toxicity by compression distance.

Two zstandard dictionaries are trained on labelled text, one on ordinary and one on toxic text. Every window of a text is
compressed with the ordinary dictionary and with the toxic one put in front of it; the bytes that the toxic one
saves are the window's excess. A logistic curve, calibrated on labelled rows that neither dictionary has seen, turns
the excesses of a text into a score from 0 to 1.

What the dictionaries are trained on: the toxic one on the telling words of toxic documents, in their order, those words and
beginnings of words that toxic documents have far more often than ordinary ones; the ordinary one on all other words. A
toxic dictionary of whole windows also holds the ordinary words beside the telling ones, and these save bytes by chance:
the README has the figures of both. Ordinary words on which the toxic dictionary still saves bytes go into the ordinary
one, so that shared word parts cancel out. A window without any `GRAM` consecutive bytes of the toxic dictionary's content
can save a byte or two at most; its excess counts as 0 and it isn't compressed.

At most `TRAIN_ROWS` labelled rows of at most `TRAIN_LENGTH` characters are used for the fit, those with the least hashes of
doc_id; scores cover all rows and whole texts.

Defined cases: a null or empty text has no windows and gets the score of a text without excess; without labelled
rows of both kinds every score is 0; a very long text is scored whole, window by window; repeated rows score alike; of equal
hashes the lower doc_id comes first; a null label is no label; a null doc_id counts as an empty text when its remainder is
taken; a kept column with the name of a result is called kept_<name>; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .runtime import TRAIN_LENGTH, map_slices, packed, ship, training_rows, unpacked

#: The most labelled rows for the fit.
TRAIN_ROWS = 4_000
#: Words in a window, bytes of the dictionaries, and the compression level.
WINDOW, ORDINARY_BYTES, HARD_BYTES, TOXIC_BYTES, LEVEL, GRAM = 4, 8_192, 8_192, 4_096, 19, 6
#: The score from which a text counts as toxic.
THRESHOLD = 0.7

NOT_WORD = re.compile(r"[\W_]+")
PREFIXES = (5, 6, 7)


def words(text: str | None) -> list[str]:
    return NOT_WORD.sub(" ", (text or "").lower()).split()


def _hashed(raw: bytes) -> np.ndarray:
    """A 20-bit hash of the GRAM bytes at each place."""
    a = np.frombuffer(raw, np.uint8)
    n = len(a) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    out = a[:n].astype(np.uint32)
    for k in range(1, GRAM):
        out = out * np.uint32(0x01000193) + a[k : n + k]
    return (out * np.uint32(0x9E3779B1)) >> np.uint32(12)


def _grams(ws: list[str]) -> set[str]:
    own = set(ws)
    return own | {w[:n] + "*" for w in own for n in PREFIXES if len(w) > n}


def telling_words(toxic: list[list[str]], ordinary: list[list[str]]) -> set[str]:
    """Words and beginnings of words whose share of toxic documents is far above that of ordinary ones."""
    t, o = Counter(), Counter()
    for ws in toxic:
        t.update(_grams(ws))
    for ws in ordinary:
        o.update(_grams(ws))
    out = set()
    for g, a in t.items():
        b = o[g]
        p = (a + b) / (len(toxic) + len(ordinary))
        z = (a / len(toxic) - b / len(ordinary)) / np.sqrt(p * (1 - p) * (1 / len(toxic) + 1 / len(ordinary)) + 1e-12)
        ratio = (a / len(toxic)) / ((b + 0.5) / len(ordinary))
        if a >= max(min(5, len(toxic)), len(toxic) / 100) and z > 6 and ratio > (20 if g.endswith("*") else 8):
            out.add(g)
    return out


def _train(samples: list[bytes], size: int) -> bytes:
    """The content of a trained dictionary; the samples themselves where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size + 256 :]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(LEVEL, format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False)
    if len(content) < 16:
        return zstandard.ZstdCompressor(compression_params=how)
    book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    book.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=book, compression_params=how)


@dataclass
class Model:
    ordinary: bytes  # dictionary contents
    toxic: bytes
    least: int  # bytes of excess from which a window counts
    weights: tuple[float, ...]

    def __post_init__(self):
        self._tools = None

    def __getstate__(self):
        return self.__dict__ | {"_tools": None}

    def excess(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves on each window."""
        return self.windows(text)[0]

    def windows(self, text: str | None) -> tuple[np.ndarray, dict[int, bytes]]:
        """The excess of each window, and those windows that were compressed."""
        if self._tools is None:
            seen = np.zeros(1 << 20, bool)
            seen[_hashed(self.toxic)] = True
            self._tools = seen, _compressor(self.ordinary).compress, _compressor(self.toxic + self.ordinary).compress
        seen, plain, toxic = self._tools
        ws = words(text)
        if not ws:
            return np.zeros(0, np.int64), {}
        raw = (" " + " ".join(ws) + " ").encode()
        edges = np.r_[np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)[:-1:WINDOW], len(raw) - 1]
        out, tried = np.zeros(len(edges) - 1, np.int64), {}
        # A hit belongs to every window that holds some of its bytes.
        hits = np.flatnonzero(seen[_hashed(raw)])
        for i in np.unique(np.searchsorted(edges, np.r_[hits, hits + GRAM - 1], "right") - 1).tolist():
            if i < len(out):
                tried[i] = w = raw[edges[i] : edges[i + 1] + 1]
                out[i] = len(plain(w)) - len(toxic(w))
        return out, tried

    def score(self, text: str | None) -> float:
        if not self.weights:
            return 0.0
        x = float(np.dot(features(self.excess(text), self.least), self.weights))
        return 1 / (1 + float(np.exp(-np.clip(x, -30, 30))))


def features(excess: np.ndarray, least: int) -> np.ndarray:
    over = excess[excess >= least]
    n = max(1, len(excess))
    return np.array([1.0, np.log1p(over.sum()), min(8, excess.max(initial=0)) / 4, np.log1p(100 * len(over) / n), np.log1p(n) / 4])


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton's method with a small penalty on all weights but the first."""
    w = np.zeros(x.shape[1])
    shrink = np.diag([1e-6] + [penalty] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + shrink, x.T @ (y - p) - shrink @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_rows(rows: list[tuple[str | None, int]]) -> Model:
    """Every third row calibrates; the others train the dictionaries."""
    none = Model(b"", b"", 1, ())
    train, held = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    toxic, ordinary = ([words(t) for t, y in train if y == k] for k in (1, 0))
    if not toxic or not ordinary or len({y for _, y in held}) < 2:
        return none
    telling = telling_words(toxic, ordinary)
    marked = lambda w: w in telling or any(len(w) > n and w[:n] + "*" in telling for n in PREFIXES)
    plain = [[w for w in ws if not marked(w)] for ws in toxic + ordinary]
    samples = [(" " + " ".join(ws[i : i + 30])).encode() for ws in plain for i in range(0, len(ws), 30)]
    found = [w for ws in toxic for w in ws if marked(w)]
    bad = [(" " + " ".join(found[i : i + 10]) + " ").encode() for i in range(0, len(found), 10)]
    usual, model = _train(samples, ORDINARY_BYTES), Model(b"", _train(bad, TOXIC_BYTES), 1, ())
    hard: Counter[str] = Counter()
    for _ in range(2):
        model = Model(b" ".join(w.encode() for w, _ in reversed(hard.most_common(HARD_BYTES // 10)))[-HARD_BYTES:] + b" " + usual, model.toxic, 1, ())
        for ws in plain[len(toxic) :]:
            excess, tried = model.windows(" ".join(ws))
            hard.update(w for i, raw in tried.items() if excess[i] > 0 for w in raw.decode().split())
    excess, y = [model.excess(t) for t, _ in held], np.array([k for _, k in held], float)
    best = None
    for least in (1, 2, 3, 4):
        x = np.array([features(e, least) for e in excess])
        w = _logistic(x, y)
        p = np.clip(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))), 1e-6, 1 - 1e-6)
        loss = -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))
        if best is None or loss < best[0]:
            best = loss, least, w
    model.least, model.weights = best[1], tuple(map(float, best[2]))
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS, length: int = TRAIN_LENGTH) -> Model:
    """Fit on at most `most` labelled rows whose crc32 remainder isn't 1: a bounded sample by hash, gathered at the driver."""
    return fit_rows([(r.text, int(r.toxic > 0)) for r in training_rows(docs, labels, "toxic", most, length).toLocalIterator()])


SCHEMA = "score double, predicted int"


def _score(docs: DataFrame, model: Model, keep: list[str], results: tuple[str, ...] = ()) -> DataFrame:
    ship(docs.sparkSession)
    taken = packed(docs, keep, results)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([taken.schema["kept"], *T.StructType.fromDDL(SCHEMA)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = list(map(shared.value.score, batch.column("text").to_pylist()))
        arrays = [batch.column("kept"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, names=["kept", "score", "predicted"])

    return map_slices(taken, run, schema)


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns of `keep` with score and predicted. The model has a few ten KB."""
    results = ("score", "predicted")
    return unpacked(_score(docs, model, keep, results), keep, *results)


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs, all columns, that don't count as toxic."""
    return _score(docs, model, docs.columns).where("predicted = 0").select("kept.*")
