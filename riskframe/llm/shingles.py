"""Hashed word shingles of whole texts, computed for a whole Arrow batch at once.

A word's hash is a polynomial in its bytes: with prefix sums of T[byte] * r^position (mod 2^64)
every word of a window costs two look-ups, so no Python runs per word. r is odd and so has an
inverse, which removes the position again. Hashes are 64 bits wide; two different shingles of a
pair of documents collide with a probability of about 1e-12 for documents of thousands of words.
"""

from __future__ import annotations

import numpy as np

from .common import MASK64, mix64, utf8_buffers

R = 0x9E3779B97F4A7C15
R_INVERSE = pow(R, -1, 1 << 64)
TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Values of the bytes, A-Z counted as a-z.
BYTE_VALUE = TABLE[LOWER]
WINDOW = 1 << 18

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((R, R_INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte position, hash) of every word of texts laid end to end; ``offsets`` bound the texts."""
    n, at, starts_all, hashes_all = len(data), 0, [], []
    while at < n:
        end = min(n, at + WINDOW)
        if end < n:  # cut after white space or a text's end, so that no word is cut
            stop = end
            while True:
                spaces = np.flatnonzero(SPACE[data[at:stop]])
                ends = offsets[np.searchsorted(offsets, at, "right"):np.searchsorted(offsets, stop, "right")]
                cut = max(at + spaces[-1] + 1 if len(spaces) else at, ends[-1] if len(ends) else at)
                if cut > at or stop == n:
                    break
                stop = min(n, stop + WINDOW)
            end = cut if cut > at else n
        chunk = data[at:end]
        word = ~SPACE[chunk]
        first = word.copy()
        first[1:] &= ~word[:-1]
        inside = offsets[(offsets > at) & (offsets < end)] - at
        first[inside] = word[inside]
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[inside - 1] = word[inside - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        power, inverse = _power_tables(len(chunk) + 1)
        sums = np.zeros(len(chunk) + 1, np.uint64)
        np.cumsum(BYTE_VALUE[chunk] * power[:len(chunk)], dtype=np.uint64, out=sums[1:])
        h = (sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64)
        starts_all.append(starts + at)
        hashes_all.append(mix64(h))
        at = end
    if not starts_all:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(starts_all), np.concatenate(hashes_all)


def shingle_sets(column, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit names of the ``k``-word shingles of every text.

    A text of fewer than ``k`` words has its whole word sequence as its one shingle; one without
    words has none.
    """
    data, offsets = utf8_buffers(column)
    starts, h = word_hashes(data, offsets)
    bounds = np.searchsorted(starts, offsets)
    s = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        s = (s ^ h[i:len(h) - k + 1 + i]) * np.uint64((2 * i + 3) * 0x9E3779B97F4A7C15 & MASK64)
        s ^= s >> np.uint64(29)
    s = mix64(s)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= k:
            out.append(np.unique(s[lo:hi - k + 1]))
        elif hi > lo:
            x = np.uint64(hi - lo)
            for v in h[lo:hi]:
                x = mix64(np.array([x ^ v]))[0]
            out.append(np.array([x], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
