"""Hashed byte n-gram counts of many texts at once, for the classifiers."""

from __future__ import annotations

import numpy as np


def language_bytes(data: np.ndarray) -> np.ndarray:
    """Lower-cased letters; every other ASCII byte is a space. Upper-case letters U+00C0-U+00DE are lower-cased too."""
    table = np.full(256, 32, np.uint8)
    table[97:123] = np.arange(97, 123)
    table[65:91] = np.arange(97, 123)
    table[128:] = np.arange(128, 256)
    out = table[data]
    after = np.flatnonzero(data[:-1] == 0xC3) + 1
    upper = after[(data[after] >= 0x80) & (data[after] <= 0x9E) & (data[after] != 0x97)]
    out[upper] += 32
    return out


def histogram(data: np.ndarray, offs: np.ndarray, buckets: int, sizes: tuple[int, ...]) -> np.ndarray:
    """Counts (rows x buckets, float32) of the byte n-grams of the given sizes, hashed to ``buckets``.

    N-grams do not cross texts.
    """
    n = len(offs) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(offs))
    out = np.zeros(n * buckets, np.float32)
    wide = data.astype(np.uint32)
    for size in sizes:
        if len(data) < size:
            continue
        h = np.full(len(data) - size + 1, 0x811C9DC5 + size * 7919, np.uint32)
        for i in range(size):
            h = (h ^ wide[i : len(data) - size + 1 + i]) * np.uint32(16777619)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        inside = row[: len(h)] == row[size - 1 :]
        key = row[: len(h)] * buckets + (h % np.uint32(buckets))
        out += np.bincount(key[inside], minlength=n * buckets)
    return out.reshape(n, buckets)
