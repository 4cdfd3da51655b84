"""Vectorised hashing of texts: character n-grams, words and word shingles of a batch."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.default_rng(20240229)
#: A random 64-bit value for each byte; lower-casing A-Z is part of the table.
_BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64; a bijection on 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BACK = [np.uint64(pow(x, -1, 1 << 64)) for x in (0x94D049BB133111EB, 0xBF58476D1CE4E5B9)]


def unmix(x: np.ndarray) -> np.ndarray:
    """The inverse of mix."""
    x = (x ^ (x >> np.uint64(31)) ^ (x >> np.uint64(62))) * _BACK[0]
    x = (x ^ (x >> np.uint64(27)) ^ (x >> np.uint64(54))) * _BACK[1]
    return x ^ (x >> np.uint64(30)) ^ (x >> np.uint64(60))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of texts, each followed by one space, and where each text begins (and the end)."""
    raw = [t.encode() for t in texts]
    bounds = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=bounds[1:])
    return np.frombuffer(b" ".join([*raw, b""]), np.uint8), bounds


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, below n."""
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, b in enumerate((_BASE, _BASE_INVERSE)):
            steps = np.full(size, b)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS[0][:n], _POWERS[1][:n]


#: Bytes hashed at once; longer data is cut at white space.
SLICE = 1 << 21


def _word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of data, which ends in white space."""
    space = _SPACE[data]
    inside = ~space
    start = np.flatnonzero(inside & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], inside[:-1]]))
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (run without ASCII white space, A-Z lowered) and each text's first word."""
    data, bounds = joined(texts)
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(data):
        end = min(len(data), at + SLICE)
        if end < len(data):
            cut = np.flatnonzero(_SPACE[data[at:end]])
            later = cut[-1] if len(cut) else end - at + int(np.argmax(_SPACE[data[end:]]))
            end = at + int(later) + 1
        h, s = _word_hashes(data[at:end])
        hashes.append(h)
        starts.append(s + at)
        at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), bounds)


def shingles(texts: list[str], size: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted within it, and where each text's begin.

    A text of fewer words has the whole sequence as its one shingle, a text without words none.
    """
    h, first = words(texts)
    n = np.diff(first)
    counts = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(texts)), counts)
    offset = np.cumsum(counts) - counts
    at = first[doc] + np.arange(len(doc)) - offset[doc]
    out = np.full(len(doc), np.uint64(size))
    left = n[doc]
    for k in range(size):
        has = left > k
        word = h[np.where(has, np.minimum(at + k, max(len(h) - 1, 0)), 0)] if len(h) else out
        out = mix(out * np.uint64(0x2545F4914F6CDD1D) + np.where(has, word, np.uint64(0)) + np.uint64(k))
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    fresh = np.ones(len(out), bool)
    fresh[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    return out[fresh], np.searchsorted(doc[fresh], np.arange(len(texts) + 1))


def char_ngrams(data: np.ndarray, sizes: tuple[int, ...], bits: int) -> list[np.ndarray]:
    """For each size in order, the bucket of the byte n-gram that begins at each position; white space counts as a space.

    At the last positions, where data ends before an n-gram does, buckets have no meaning.
    """
    value = _BYTE[np.where(_SPACE[data], 32, data)]
    rows, rolling = [], np.zeros(len(data), np.uint64)
    for k in range(1, max(sizes) + 1):
        n = max(0, len(data) - k + 1)
        rolling[:n] = rolling[:n] * _BASE + value[k - 1 :]
        if k in sizes:
            rows.append((mix(rolling + np.uint64(k)) >> np.uint64(64 - bits)).astype(np.int32))
    return rows
