"""64-bit hashes of words and of runs of words, for Python tasks."""

from __future__ import annotations

import numpy as np
import xxhash

REMEMBERED = 200_000  # words whose hash a task remembers at once, some 30 MB
STEP = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hash by word, forgotten when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words."""
    many = max(len(hashes) - length + 1, 0)
    total = np.zeros(many, np.uint64)
    for k in range(length):
        total = total * STEP + hashes[k : k + many]
    return scrambled(total + np.uint64(length))
