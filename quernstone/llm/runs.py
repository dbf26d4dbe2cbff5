"""A disk-backed priority queue of fixed-size records, for tasks whose share exceeds memory."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

BLOCK = 50_000


class RunQueue:
    """Takes arrays of one record type in any order and gives them back by ascending ``key``.

    What exceeds the limit goes to disk as a sorted run; runs are merged a block at a time, so that
    memory holds one block of each. The files are unnamed and go with the queue."""

    def __init__(self, dtype: np.dtype, limit: int = 96_000_000):
        self.dtype, self.limit = dtype, limit
        self.held: list[np.ndarray] = []
        self.size = 0
        self.files: list[tuple] = []

    def push(self, records: np.ndarray) -> None:
        if len(records):
            self.held.append(records)
            self.size += records.nbytes
            if self.size > self.limit:
                self._spill()

    def _sorted(self) -> np.ndarray:
        a = np.concatenate(self.held) if self.held else np.zeros(0, self.dtype)
        self.held, self.size = [], 0
        return a[np.argsort(a["key"], kind="stable")]

    def _spill(self) -> None:
        a = self._sorted()
        f = tempfile.TemporaryFile()
        a.tofile(f)
        f.seek(0)
        self.files.append((f, len(a)))

    def blocks(self) -> Iterator[np.ndarray]:
        """Sorted blocks; all records of a key lie in one block."""
        if not self.files:
            a = self._sorted()
            while len(a):
                n = len(a) if len(a) <= BLOCK else int(np.searchsorted(a["key"], a["key"][BLOCK], "left")) or int(np.searchsorted(a["key"], a["key"][0], "right"))
                yield a[:n]
                a = a[n:]
            return
        if self.held:
            self._spill()
        heads = [np.zeros(0, self.dtype) for _ in self.files]
        left = [n for _, n in self.files]
        while True:
            for i, (f, _) in enumerate(self.files):
                if left[i] and len(heads[i]) < BLOCK // 4:
                    more = np.fromfile(f, self.dtype, min(BLOCK, left[i]))
                    left[i] -= len(more)
                    heads[i] = np.concatenate([heads[i], more])
            if not any(map(len, heads)):
                break
            open_ends = [h["key"][-1] for h, n in zip(heads, left) if n]
            cuts = [int(np.searchsorted(h["key"], min(open_ends), "left")) if open_ends else len(h) for h in heads]
            if not any(cuts):  # one key fills a whole block: read on in the runs that end with it
                for i, (f, _) in enumerate(self.files):
                    if left[i] and heads[i]["key"][-1] == min(open_ends):
                        more = np.fromfile(f, self.dtype, min(BLOCK, left[i]))
                        left[i] -= len(more)
                        heads[i] = np.concatenate([heads[i], more])
                continue
            out = np.concatenate([h[:c] for h, c in zip(heads, cuts)])
            heads = [h[c:] for h, c in zip(heads, cuts)]
            yield out[np.argsort(out["key"], kind="stable")]
        for f, _ in self.files:
            f.close()
