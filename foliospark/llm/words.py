"""Words and word shingles as 64-bit hashes, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

_MULTIPLIERS = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63], np.uint64
)


class WordHashes(dict):
    """xxhash64 of words, remembered up to a bound in bytes (about 100 a word, and its length)."""

    def __init__(self, remember: int = 16 << 20):
        super().__init__()
        self.remember, self.taken = remember, 0

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        self.keep(word, value)
        return value

    def keep(self, word: bytes, value: int) -> None:
        self.taken += 100 + len(word)
        if self.taken > self.remember:
            self.clear()
            self.taken = 100 + len(word)
        self[word] = value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one mixing of 64-bit numbers (the finalizer of splitmix64)."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _odd_numbers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.array([mixed(_MULTIPLIERS[i % 4 : i % 4 + 1], i)[0] | np.uint64(1) for i in range(n)], np.uint64)


#: An odd number for the i-th word of a shingle.
_ODD = _odd_numbers(64)


def multiplier(i: int) -> np.uint64:
    """The number by which the i-th word of a shingle is multiplied."""
    return _ODD[i] if i < len(_ODD) else _odd_numbers(i + 1)[i]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words; of all words if there are fewer."""
    n = len(words)
    if not n:
        return words
    used = min(width, n)
    total = np.full(n - used + 1, used, np.uint64)
    for i in range(used):
        total += words[i : i + len(total)] * multiplier(i)
    return mixed(total)
