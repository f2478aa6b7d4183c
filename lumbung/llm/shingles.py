"""Hashes of words and of runs of words, vectorised."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

#: Odd bases of two independent polynomials, and their inverses modulo 2**64.
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[tuple[int, int], np.ndarray] = {}


def _power(base: int, sign: int, n: int) -> np.ndarray:
    """Powers 0 to n-1 of a base (sign 1) or of its inverse (sign -1) modulo 2**64."""
    if len(_powers.get((base, sign), ())) < n:
        table = np.full(max(n, 4096), np.uint64(pow(_BASES[base], sign, 1 << 64)), np.uint64)
        table[0] = 1
        _powers[base, sign] = np.cumprod(table, dtype=np.uint64)
    return _powers[base, sign][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which all bits depend on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Words in UTF-8: bytes split at ASCII white space, and nowhere else."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, from 0 in order of first occurrence: equal words have equal numbers."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, n: int, base: int = 0) -> np.ndarray:
    """64-bit hash of each run of ``n`` consecutive words: a polynomial modulo 2**64, mixed.

    Bases 0 and 1 give independent hashes.
    """
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, np.uint64)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power(base, -1, len(hashes)), out=sums[1:])
    return mixed((sums[n:] - sums[:-n]) * _power(base, 1, k))
