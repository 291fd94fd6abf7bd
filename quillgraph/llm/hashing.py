"""Vectorised word, window and shingle hashes."""

from __future__ import annotations

import numpy as np
import xxhash

MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_U = np.uint64


class WordHashes(dict):
    """Words to 64-bit hashes; emptied when it has ``most`` entries."""

    def __init__(self, most: int = 500_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values evenly."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Rolling:
    """Rabin-Karp hashes of any word span of a text, modulo 2**64."""

    _power = np.ones(1, np.uint64)
    _inverse = np.ones(1, np.uint64)

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        if n + 1 > len(Rolling._power):
            size = 1 << (n + 1).bit_length()
            for name, base in (("_power", MULTIPLIER), ("_inverse", pow(MULTIPLIER, -1, 1 << 64))):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(Rolling, name, np.cumprod(steps))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * Rolling._inverse[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, length) -> np.ndarray:
        """Hashes of the spans of ``length`` words from ``start``."""
        stop = start + length
        return (self.sums[stop] - self.sums[start]) * Rolling._power[stop - 1]

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all windows of ``length`` words."""
        n = len(self.sums) - length
        if n <= 0:
            return np.zeros(0, np.uint64)
        return (self.sums[length:] - self.sums[:n]) * Rolling._power[length - 1 : length - 1 + n]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


def shingle_set(raw: bytes, hashes: WordHashes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles of a text, A-Z in lower case.

    A text of fewer words is one shingle, one without words has none.
    """
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    rolling = Rolling(hashes.of(words))
    width = min(size, len(words))
    return np.unique(mix(rolling.windows(width) + _U(width)))
