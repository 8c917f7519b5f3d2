"""Word and shingle fingerprints for Arrow functions, vectorised with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers of the polynomial hashes (fixed values).
P1 = np.uint64(0x9E3779B97F4A7C15)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)

_CACHE_LIMIT = 60_000


class WordHashes(dict):
    """Word bytes to a 64-bit hash; a cache that starts anew when it is full, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _CACHE_LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHashes()


def split_words(text: bytes | None, lower: bool) -> list[bytes]:
    """Runs of bytes other than space and 09-0D; ``lower`` folds A-Z only, as bytes methods do."""
    if not text:
        return []
    return (text.lower() if lower else text).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A uint64 hash of each word."""
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that high bits depend on all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, size: int, multiplier: np.uint64 = P1) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive words, by doubling: O(n log size), exact modulo 2**64."""
    if len(hashes) < size:
        return np.empty(0, dtype=np.uint64)
    total = len(hashes) - size + 1
    result, done = np.zeros(total, dtype=np.uint64), 0
    power, block, width = np.uint64(multiplier), hashes, 1
    left = size
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                result = result * power + block[done : done + total]
                done += width
            left >>= 1
            if left:
                block = block[:-width] * power + block[width:]
                power = power * power
                width *= 2
        return mixed(result + np.uint64(size) * P2)
