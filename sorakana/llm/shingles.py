"""Distinct word shingles of texts as 64-bit hashes, by array operations."""

from __future__ import annotations

import numpy as np

from .common import SPACES, Rolling, mix

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_words: list[Rolling] = []


def shingles(raw: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Of rows raw[bounds[i]:bounds[i + 1]], the sorted distinct shingles, and their bounds.

    Words are runs of bytes that aren't white space, A-Z as a-z. A row of fewer words
    than ``width`` has its whole sequence as one shingle, a row without words none.
    """
    if not _words:
        _words.append(Rolling(5))
    rows = len(bounds) - 1
    space = _SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    inside = ~space
    before = np.concatenate([[False], inside[:-1]]) if len(raw) else inside
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]]) if len(raw) else inside
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    words = _words[0].ranges(_words[0].prefixes(_LOWER[raw]), start, end)
    first = np.searchsorted(start, bounds)  # words before each row
    n = np.diff(first)
    grams = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for i in range(width):
        grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(grams)] + np.uint64(i + 1))
    out, counts = [], np.zeros(rows, np.int64)
    for i in np.flatnonzero(n).tolist():
        a, k = int(first[i]), int(n[i])
        if k >= width:
            own = np.unique(grams[a : a + k - width + 1])
        else:
            h = np.uint64(k)
            for w in words[a : a + k]:
                h = mix(np.array([h]) * np.uint64(0xC2B2AE3D27D4EB4F) + w)[0]
            own = np.array([h], np.uint64)
        out.append(own)
        counts[i] = len(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(counts)])
