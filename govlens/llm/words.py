"""Words of a text as 64-bit hashes, fast: each Python worker keeps the hashes of words seen."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE = 500_000
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = word_hash(word)
        return h


_KNOWN = _Hashes()


def hashed_words(text: str) -> np.ndarray:
    """Hashes of the words in order; A-Z lower-cased, cut at space and \\x09-\\x0D."""
    words = text.encode().lower().split()
    return np.fromiter(map(_KNOWN.__getitem__, words), np.uint64, len(words))
