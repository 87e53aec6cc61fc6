"""Vectorised work on the UTF-8 bytes of many texts at once (no loop over characters or words)."""

from __future__ import annotations

import numpy as np
import xxhash

_RNG = np.random.default_rng(20240517)
#: A random 64-bit number for each byte value, A-Z as a-z.
BYTE_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER_VALUE = BYTE_VALUE.copy()
LOWER_VALUE[65:91] = BYTE_VALUE[97:123]
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Words of more bytes are hashed by xxh3 (64 bits) instead of a sum over their bytes.
LONG_WORD = 64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """_ODD ** 0 .. _ODD ** (n - 1) modulo 2 ** 64."""
    global _POWERS
    with np.errstate(over="ignore"):
        while len(_POWERS) < n:
            _POWERS = np.concatenate((_POWERS, _POWERS * (_POWERS[-1] * _ODD)))
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word (a 64-bit finaliser)."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (maximal runs without space and TAB..CR; A-Z as a-z) and each text's range of them."""
    n = len(raw)
    n_texts = len(offsets) - 1
    if not n:
        return np.zeros(0, np.uint64), np.zeros(n_texts + 1, np.int64)
    inside = ~_SPACE[raw]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    border = offsets[(offsets > 0) & (offsets < n)]
    first[border] = inside[border]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[border - 1] = inside[border - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    # value of a word: sum of byte value * odd ** (distance to the word's end), from prefix sums
    size = end - start
    position = np.arange(n, dtype=np.int64)
    value = LOWER_VALUE[raw]
    which = np.repeat(np.arange(len(start)), size)
    at = np.flatnonzero(inside)
    weighted = value[at] * powers(int(size.max()) if len(size) else 1)[end[which] - 1 - position[at]]
    word = np.add.reduceat(weighted, np.concatenate(([0], np.cumsum(size)[:-1]))) if len(start) else np.zeros(0, np.uint64)
    # sums with powers modulo 2 ** 64 fail together on long words of two letters in one pattern: those have a digest
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        word[i] = xxhash.xxh3_64_intdigest(_FOLD[raw[start[i] : end[i]]].tobytes())
    return mix(word + size.astype(np.uint64)), np.searchsorted(start, offsets)


def shingles(words: np.ndarray, bounds: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts (the whole sequence where a text has fewer words) and each text's range of them."""
    count = np.diff(bounds)
    made = np.where(count >= width, count - width + 1, (count > 0).astype(np.int64))
    out_bounds = np.concatenate(([0], np.cumsum(made)))
    total = int(out_bounds[-1])
    if not total:
        return np.zeros(0, np.uint64), out_bounds
    owner = np.repeat(np.arange(len(count)), made)
    begin = bounds[:-1][owner] + (np.arange(total) - out_bounds[:-1][owner])
    length = np.minimum(count, width)[owner]
    padded = np.concatenate((words, np.zeros(width, np.uint64)))
    value = length.astype(np.uint64)
    for j in range(width):
        value = value * _ODD + np.where(j < length, padded[begin + j], np.uint64(0))
    return mix(value), out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, owner))
    v, o = values[order], owner[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
    v, o = v[new], o[new]
    return v, np.searchsorted(o, np.arange(len(bounds)))


def intersection_sizes(values_a, bounds_a, values_b, bounds_b) -> np.ndarray:
    """Sizes of the intersections of the i-th sets of both sides (each set distinct)."""
    n = len(bounds_a) - 1
    owner = np.concatenate((np.repeat(np.arange(n), np.diff(bounds_a)), np.repeat(np.arange(n), np.diff(bounds_b))))
    value = np.concatenate((values_a, values_b))
    order = np.lexsort((value, owner))
    v, o = value[order], owner[order]
    same = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[1:][same], minlength=n)
