"""Word shingle sets of whole texts as 64-bit hashes, per Arrow batch.

These helpers run inside Spark tasks; they hold one batch and a bounded word
cache.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: A worker's cache of word hashes is emptied at this size.
CACHE_WORDS = 300_000

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ascii_words(text: bytes | None, lower: bool = True) -> list[bytes]:
    """Words between ASCII white space (space, \\t to \\r); only A-Z are
    lower-cased."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of ``size`` items."""
    n = len(hashes) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = mix(out + _STEP + hashes[i : i + n])
    return out


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles as int64; a shorter text is one shingle."""
    if not len(hashes):
        return np.empty(0, np.int64)
    return np.unique(windows(hashes, min(size, len(hashes))).view(np.int64))
