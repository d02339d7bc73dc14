"""A minimal acyclic automaton over byte strings that numbers its words.

Words are added in sorted order and equal suffixes are shared as soon as they are complete. Every state knows
how many words end below it, so that a walk through the automaton also yields the word's rank in sorted order; the
rank indexes the outputs (lists of ids). The arrays lie in one flat file that readers map into memory.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterable

import numpy as np

ARRAYS = ("keys", "target", "skipped", "final", "offsets", "outputs")


def compile_words(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file for distinct words with their ids."""
    ordered = sorted(words)
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []

    def state(final: bool, arcs: list[tuple[int, int]]) -> int:
        known = (final, tuple(arcs))
        if known not in register:
            register[known] = len(states)
            states.append(known)
        return register[known]

    # The states along the last word that may still get arcs: [final, arcs, byte that leads to the next].
    path: list[list] = [[False, [], None]]

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, arcs, _ = path.pop()
            path[-1][1].append((path[-1][2], state(final, arcs)))

    before = b""
    for word, _ in ordered:
        shared = len(os.path.commonprefix([before, word]))
        close(shared)
        for byte in word[shared:]:
            path[-1][2] = byte
            path.append([False, [], None])
        path[-1][0] = True
        before = word
    close(0)
    root = state(path[0][0], path[0][1])

    below = np.zeros(len(states), np.int64)  # targets come before their sources
    keys, target, skipped = [], [], []
    for s, (final, arcs) in enumerate(states):
        count = int(final)
        for byte, to in arcs:
            keys.append(s << 8 | byte)
            target.append(to)
            skipped.append(count)  # words that sort before those along this arc
            count += int(below[to])
        below[s] = count
    ids = [i for _, i in ordered]
    arrays = {
        "keys": np.array(keys, np.uint32), "target": np.array(target, np.uint32), "skipped": np.array(skipped, np.uint32),
        "final": np.array([f for f, _ in states], np.uint32),
        "offsets": np.cumsum([0, *map(len, ids)]).astype(np.uint32), "outputs": np.array([x for i in ids for x in i], np.uint32)}
    head = json.dumps({"root": root, "longest": max((len(w) for w, _ in ordered), default=0), "sizes": [len(arrays[n]) for n in ARRAYS]}).encode()
    return len(head).to_bytes(4, "little") + head + b" " * (-(4 + len(head)) % 4) + b"".join(arrays[n].tobytes() for n in ARRAYS)


class Lexicon:
    """A compiled file, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(raw[:4].tobytes(), "little")
        head = json.loads(raw[4 : 4 + n].tobytes())
        at = 4 + n + -(4 + n) % 4
        for name, size in zip(ARRAYS, head["sizes"], strict=True):
            setattr(self, name, raw[at : at + 4 * size].view(np.uint32).view(np.ndarray))
            at += 4 * size
        self.root, self.longest = head["root"], head["longest"]

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 if it isn't in the lexicon. All words advance by one byte at a time."""
        out = np.full(len(words), -1, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        live = np.flatnonzero((size > 0) & (size <= self.longest))
        if not len(live) or not len(self.keys):
            return out
        flat = np.frombuffer(b"".join(words), np.uint8)
        start = np.cumsum(size) - size
        at, rank, depth = np.full(len(live), self.root, np.uint32), np.zeros(len(live), np.int64), 0
        while len(live):
            ended = size[live] == depth
            whole = ended & (self.final[at] == 1)
            out[live[whole]] = rank[whole]
            live, at, rank = live[~ended], at[~ended], rank[~ended]
            key = at << np.uint32(8) | flat[start[live] + depth]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[arc] == key
            live, arc = live[known], arc[known]
            at, rank, depth = self.target[arc], rank[known] + self.skipped[arc], depth + 1
        return out

    def ids(self, rank: int) -> list[int]:
        return self.outputs[self.offsets[rank] : self.offsets[rank + 1]].tolist()

    def many(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids() of many ranks: all ids, and how many of each rank."""
        start = self.offsets[ranks].astype(np.int64)
        size = self.offsets[ranks + 1] - start
        return self.outputs[np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)], size


def mapped(blob: bytes) -> Lexicon:
    """The lexicon of these bytes, mapped from a file of this machine's temporary folder that is gone when the process is."""
    with tempfile.NamedTemporaryFile(prefix="lexicon-") as f:
        f.write(blob)
        f.flush()
        return Lexicon(f.name)
