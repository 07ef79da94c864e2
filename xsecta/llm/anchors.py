"""Anchors of byte strings: positions that two equal 100-byte strings choose alike."""

from __future__ import annotations

import numpy as np

from .common import mix64

#: Bytes of a repeated string, of the gram at an anchor, and grams that such a string holds.
SPAN, GRAM = 100, 32
WIDTH = SPAN - GRAM + 1


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte strings of data, by doubling."""
    h = mix64(data.astype(np.uint64) + np.uint64(0x51ED27))
    size, factor = 1, 0x9E3779B97F4A7C15
    while size < GRAM:
        h = h[:-size] * np.uint64(factor) + h[size:]
        factor = factor * factor % 2**64 | 1
        size *= 2
    return mix64(h)


def runs(data: np.ndarray, offsets: np.ndarray):
    """(row, anchor, first, last, hash) of each run of strings that share an anchor.

    A SPAN-byte string's anchor is the leftmost of its grams with the smallest hash, so equal strings have it at the same
    place. first and last are the run's first and last string's starts; all places count from the row's start.
    """
    none = np.zeros(0, np.int64)
    if len(data) < SPAN:
        return none, none, none, none, np.zeros(0, np.uint64)
    h = gram_hashes(data)
    m = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    size = 1
    while size * 2 <= WIDTH:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    m = np.minimum(m[: len(m) - (WIDTH - size)], m[WIDTH - size :])
    anchor = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)
    del m
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    good = np.arange(len(anchor)) + SPAN <= offsets[1:][row]
    where = np.flatnonzero(good)
    if len(where) == 0:
        return none, none, none, none, np.zeros(0, np.uint64)
    a, r = anchor[where], row[where]
    new = np.ones(len(where), bool)
    new[1:] = (a[1:] != a[:-1]) | (r[1:] != r[:-1])
    start = np.flatnonzero(new)
    end = np.append(start[1:], len(where)) - 1
    rows, base = r[start], offsets[r[start]]
    return rows, a[start] - base, where[start] - base, where[end] - base, h[a[start]]
