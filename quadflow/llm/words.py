"""Vectorised word and shingle hashes over the UTF-8 bytes of many texts.

Words are runs of bytes other than space and tab to carriage return; A-Z are
lower-cased. A word's hash is a polynomial of its bytes modulo 2^64, taken from
one running sum, then mixed; a shingle's hash combines the mixed hashes of its
words. No Python object is made per word.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2^64
BASE_INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: U, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, offsets: np.ndarray):
    """(hash per word, first byte, end byte, word offsets per text)."""
    n = len(data)
    if n == 0:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    blank = BLANK[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = blank[:-1]
    starts = np.flatnonzero(~blank & (before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = blank[1:]
    ends = np.flatnonzero(~blank & (after | cut[1:])) + 1
    run = np.zeros(n + 1, U)
    np.cumsum((LOWER[data].astype(U) + U(1)) * powers(BASE, n), out=run[1:])
    hashes = mix((run[ends] - run[starts]) * powers(BASE_INVERSE, n + 1)[starts])
    return hashes, starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, offsets: np.ndarray, size: int):
    """(hash per shingle, shingle offsets per text): every run of ``size``
    words; a text with fewer words is one shingle, one without words none."""
    counts = np.diff(offsets)
    many = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_offsets = np.concatenate([[0], np.cumsum(many)])
    n = len(hashes)
    scale = mix(np.arange(1, size + 1, dtype=U)) | U(1)
    full = np.zeros(max(n - size + 1, 0), U)
    for k in range(size):
        full += hashes[k:k + len(full)] * scale[k]
    full = mix(full)
    text = np.repeat(np.arange(len(counts)), many)
    at = offsets[text] + np.arange(out_offsets[-1]) - out_offsets[text]
    out = np.zeros(len(at), U)
    long = (counts >= size)[text]
    out[long] = full[at[long]]
    for i in np.flatnonzero((counts > 0) & (counts < size)):
        own = hashes[offsets[i]:offsets[i + 1]]
        out[out_offsets[i]] = mix(np.array([(own * scale[:len(own)]).sum() + U(len(own))], U))[0]
    return out, out_offsets
