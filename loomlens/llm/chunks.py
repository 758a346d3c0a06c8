"""Texts cut before white space, each distinct piece once: what tokenizers cache by.

No token crosses from other characters into following white space, so a text's tokens are those
of its pieces in order, where a piece is a run of white space and the run of other characters
after it. A batch's distinct pieces are encoded once and mapped back.
"""

from __future__ import annotations

import numpy as np

from .common import gather_spans, span_hashes


def cut(data: np.ndarray, offs: np.ndarray, space: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the pieces; ``space`` says which bytes are white space."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    at = np.zeros(n + 1, bool)
    at[offs] = True
    at[1:n] |= space[data[1:]] & ~space[data[:-1]]
    at[n] = False
    starts = np.flatnonzero(at)
    ends = np.append(starts[1:], n)
    return starts, ends, np.searchsorted(offs, starts, side="right") - 1


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of one piece of each kind, and the kind of each piece.

    Pieces are told apart by a 64-bit hash, then compared byte by byte with the piece that
    stands for their kind; one that differs becomes a kind of its own.
    """
    _, first, kind = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
    lens = ends - starts
    stand = first[kind]
    bad = lens != lens[stand]
    ok = np.flatnonzero(~bad)
    if len(ok):
        differ = gather_spans(data, starts[ok], lens[ok]) != gather_spans(data, starts[stand[ok]], lens[ok])
        bad[ok] = np.add.reduceat(differ, np.concatenate([[0], np.cumsum(lens[ok])])[:-1]) > 0
    if bad.any():
        odd = np.flatnonzero(bad)
        kind[odd] = len(first) + np.arange(len(odd))
        first = np.concatenate([first, odd])
    return first, kind


def spread(values: np.ndarray, sizes: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of each kind (``sizes`` per kind, one after another) for all pieces in order, and the pieces' sizes."""
    at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    return gather_spans(values, at[kind], sizes[kind]), sizes[kind]
