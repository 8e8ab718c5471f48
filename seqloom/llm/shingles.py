"""Word shingles of whole texts as sets of 64-bit values."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a worker remembers before it starts again.
MEMO = 250_000
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        out = self[word] = xxhash.xxh3_64_intdigest(word)
        return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX[3]
    return h ^ (h >> np.uint64(29))


def shingles(text: bytes, k: int, words: WordHash) -> np.ndarray:
    """Every k-word shingle of the text with A-Z in lower case, repeats included; with fewer words, the whole sequence as one.

    Words are runs of bytes other than space and the ASCII controls 9 to 13. None without words.
    """
    own = text.lower().split()
    n = len(own)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, own), np.uint64, n)
    m = min(k, n)
    with np.errstate(over="ignore"):
        h = np.full(n - m + 1, m, np.uint64)
        for i in range(m):
            h = (h ^ w[i : n - m + 1 + i]) * MIX[4]
            h ^= h >> np.uint64(31)
        return mixed(h)
