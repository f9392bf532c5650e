"""Hashed word shingles of whole texts, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
_M = np.uint64(0xFFFFFFFFFFFFFFFF)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.isin(np.arange(256), [0x20, 9, 10, 11, 12, 13])
#: A value for each byte, the same for A-Z as for a-z.
_VALUE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_PLACE = np.random.default_rng(11).integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (the splitmix finalizer)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base, and of its inverse, mod 2 ** 64."""
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


_BLOCK = 1 << 16


def word_hashes(data: np.ndarray, texts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of the bytes (ASCII letters without case), and where the words start.

    texts: places at which another text begins, so that no word runs over them.
    """
    space = _SPACE[data]
    cut = np.zeros(len(data) + 1, bool)  # between the byte before and this one
    cut[[0, -1]] = True
    if texts is not None:
        cut[texts] = True
    before, after = cut[:-1].copy(), cut[1:]
    before[1:] |= space[:-1]
    after[:-1] |= space[1:]
    start, end = np.flatnonzero(before & ~space), np.flatnonzero(after & ~space) + 1
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[:-1], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def _long_words(data: np.ndarray) -> np.ndarray:
    """word_hashes of one text over a block, in blocks cut at white space."""
    out, at = [], 0
    while at < len(data):
        stop = min(len(data), at + _BLOCK)
        while stop < len(data) and not _SPACE[data[stop]]:
            stop += 1
        out.append(word_hashes(data[at:stop])[0])
        at = stop
    return np.concatenate(out)


def _set(h: np.ndarray) -> np.ndarray:
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) > 1 else h


def _grams(w: np.ndarray, k: int) -> np.ndarray:
    h = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        h += w[i : len(w) - k + 1 + i] * _PLACE[i]
    return mix(h)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct shingles: 5 words each; with fewer words the whole sequence as one;
    without words, or for null, none. Works on the UTF-8 bytes of the array, many short texts at once."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and len(data) else np.zeros(0, np.uint8)
    null = texts.is_null().to_numpy(zero_copy_only=False)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + _BLOCK, "right")) - 1)
        block = data[at[i] : at[j]]
        if len(block) > _BLOCK:
            w, bounds = _long_words(block), None
        else:
            w, start = word_hashes(block, at[i:j] - at[i])
            bounds = np.searchsorted(start, at[i : j + 1] - at[i])
        if bounds is None:
            bounds = np.array([0, len(w)])
        grams = _grams(w, WORDS) if len(w) >= WORDS else w[:0]
        for k in range(i, j):
            a, b = int(bounds[k - i]), int(bounds[k - i + 1])
            if null[k] or a == b:
                yield w[:0]
            elif b - a < WORDS:
                yield _grams(w[a:b], b - a)
            else:
                yield _set(grams[a : b - WORDS + 1])
        i = j
