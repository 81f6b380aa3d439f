"""numpy kernels over the words of many texts at once. They run inside mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

_RNG = np.random.default_rng(20240229)
#: One random 64-bit value for each byte, A-Z as a-z, and 0 for white space.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE[65:91] = BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
BYTE[SPACE] = 0
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STEP = _RNG.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about most_bytes of text each, so that the kernels' arrays stay small; a longer text comes alone."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part, start = np.cumsum(lengths) // most_bytes, 0
    for end in [*(np.flatnonzero(np.diff(part)) + 1), len(lengths)]:
        if end > start:
            yield batch.slice(start, end - start)
            start = end


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text begins, with the end at last. Null is empty."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z lower-cased, in order, and the first word of each text, with the number of words at last."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = SPACE[data]
    begins = np.empty(len(data), bool)
    begins[0] = True
    begins[1:] = space[:-1]
    begins[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(begins & ~space)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    lengths = np.diff(np.append(starts, len(data)))
    at = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    powers = np.cumprod(np.full(int(lengths.max()), MULTIPLIER, np.uint64))
    return mix(np.add.reduceat(BYTE[data[starts[0] :]] * powers[at], starts - starts[0])), np.searchsorted(starts, offsets)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size words."""
    n = len(words) - size + 1
    total = np.zeros(n, np.uint64)
    for i in range(size):
        total += words[i : i + n] * _STEP[i]
    return mix(total)


def shingle_set(words: np.ndarray, size: int) -> np.ndarray:
    """The distinct shingles of one text, sorted; a shorter text is one shingle, one without words has none."""
    if not len(words):
        return words
    return np.unique(shingle_hashes(words, min(size, len(words))))


@lru_cache(8)
def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 32, (n, 1), dtype=np.uint32), rng.integers(0, 1 << 31, (n, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def min_hashes(values: np.ndarray, n: int, seed: int = 1) -> np.ndarray:
    """n MinHash values of a set of hashes, cut to 16 bits each. Arrays in between have 2^17 elements, however large the set is."""
    flip, times = _permutations(n, seed)
    least = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    high = (values >> np.uint64(32)).astype(np.uint32)
    step = max(1, (1 << 17) // n)
    for i in range(0, len(high), step):
        np.minimum(least, ((high[i : i + step] ^ flip) * times).min(axis=1), out=least)
    return (mix(least + np.arange(n, dtype=np.uint64) * MULTIPLIER) >> np.uint64(48)).astype(np.uint16)
