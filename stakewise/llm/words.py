"""Words and word shingles of texts as numpy hashes."""

from __future__ import annotations

import numpy as np

#: Words a worker remembers; the memory is emptied when full.
CACHED_WORDS = 100_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


class _Memory(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_memory = _Memory()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_memory.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash for each run of ``width`` words, in order; with fewer words, one for the whole run; with none, none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(width, n)
    total = np.full(n - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total * _ODD[i % 8] + hashes[i : n - width + 1 + i])
    return total
