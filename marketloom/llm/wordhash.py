"""Words as 64-bit hashes and rolling hashes over them, vectorised with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

ODD, OTHER = 0x9E3779B97F4A7C15, 0xD1B54A32D192ED03  # odd multipliers; use both for 128 bits
KEPT_WORDS = 200_000  # remembered word hashes of a worker; a full memory is emptied, which costs time only


class WordHashes(dict):
    """XXH3 of words, remembered while there is room."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def rolling(words: np.ndarray, k: int, odd: int = ODD) -> np.ndarray:
    """Hash of every run of ``k`` words, modulo 2^64; none if there are fewer words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    if k <= 16:
        out = words[:n].copy()
        for j in range(1, k):
            out *= np.uint64(odd)
            out += words[j: j + n]
        return mixed(out)
    return spans(words, np.arange(n), np.arange(n) + k, odd)


def spans(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, odd: int = ODD) -> np.ndarray:
    """Hash of every word range, end exclusive, modulo 2^64."""
    powers, back = (np.full(len(words) + 1, p, np.uint64) for p in (odd, pow(odd, -1, 1 << 64)))
    powers[0] = back[0] = 1  # the multiplier is odd, so it has an inverse
    powers, back = np.multiply.accumulate(powers), np.multiply.accumulate(back)
    sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(words * powers[:-1])])
    return mixed((sums[ends] - sums[starts]) * back[starts])


def winnowed(hashes: np.ndarray, window: int) -> np.ndarray:
    """For every run of ``window`` hashes, the position of its smallest one (the leftmost among equals)."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return views.argmin(axis=1) + np.arange(len(views))
