"""Helpers for tasks: Arrow texts as one byte array, and hashes of words and windows over it, all in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES = 4_000_000
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
ROOT = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64 bits (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_codes(lower: bool = False) -> np.ndarray:
    """A fixed 64-bit code for each byte."""
    codes = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(ROOT))
    return codes[LOWER] if lower else codes


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ROOT**i and ROOT**-i mod 2**64 for i up to n, kept for the next slice."""
    if len(_powers.get("up", ())) <= n:
        size = n + n // 4 + 1
        up, down = np.empty(size, np.uint64), np.empty(size, np.uint64)
        for out, root in ((up, ROOT), (down, pow(ROOT, -1, 2**64))):
            out[0], filled = 1, 1
            while filled < size:  # doubling
                step = np.uint64(pow(root, filled, 2**64))
                take = min(filled, size - filled)
                out[filled : filled + take] = out[:take] * step
                filled += take
        _powers.update(up=up, down=down)
    return _powers["up"], _powers["down"]


def prefix_hash(codes: np.ndarray) -> np.ndarray:
    """Sums S with S[e] - S[s], times ROOT**-s, a polynomial hash of codes[s:e]."""
    up, _ = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(codes * up[: len(codes)], out=sums[1:])
    return sums


def slices(texts: pa.Array, most_rows: int = 2**30, most_bytes: int | None = None):
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about SLICE_BYTES; a longer text is a run of its own. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + (most_bytes or SLICE_BYTES), "right")) - 1)
        b = min(b, a + most_rows)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def words(data: np.ndarray, offsets: np.ndarray, spaces: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text numbers of all words."""
    solid = ~spaces[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word."""
    sums = prefix_hash(byte_codes(lower)[data])
    _, down = powers(len(data))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word shingles, end to end, and where each text's begin. A text of fewer words has one shingle, of all its words; one without words has none."""
    n = len(offsets) - 1
    starts, ends, doc = words(data, offsets)
    h = word_hashes(data, starts, ends, lower=True)
    count = np.bincount(doc, minlength=n)
    begin = np.concatenate([[0], np.cumsum(count)])
    root = [np.uint64(pow(ROOT, 3 + 2 * i, 2**64)) for i in range(width)]
    m = max(len(h) - width + 1, 0)
    s = np.zeros(m, np.uint64)
    for i in range(width):
        s += h[i : i + m] * root[i]
    whole = doc[:m] == doc[width - 1 :] if m else np.zeros(0, bool)
    s, of = mix(s[whole]), doc[:m][whole]
    for d in np.flatnonzero((count > 0) & (count < width)):
        x = np.array([count[d]], np.uint64)
        for i in range(count[d]):
            x += h[begin[d] + i : begin[d] + i + 1] * root[i]
        s, of = np.append(s, mix(x)), np.append(of, d)
    if len(of) and np.any(of[1:] < of[:-1]):
        order = np.argsort(of, kind="stable")
        s, of = s[order], of[order]
    edges = np.searchsorted(of, np.arange(n + 1))
    for a, b in zip(edges[:-1], edges[1:]):
        s[a:b].sort()
    fresh = np.ones(len(s), bool)
    fresh[1:] = (s[1:] != s[:-1]) | (of[1:] != of[:-1])
    s, of = s[fresh], of[fresh]
    return s, np.searchsorted(of, np.arange(n + 1))
