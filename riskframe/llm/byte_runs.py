"""Words and tokens of a block of texts as arrays: where they lie, whose they are, and a 64-bit hash of each.

A run's hash is a polynomial over the values of its bytes, taken from one
running sum over the block, so its cost does not grow with the number of
distinct words. Equal runs have equal hashes. Different runs can share one, by
a chance of about 2**-56 a pair or by design, so where equality itself is
counted, ``equal_entries`` compares the bytes of those with equal hashes.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterable

import numpy as np

# The multiplier, its inverse modulo 2**64, and the finishing constants.
POLY = 0x9E3779B97F4A7C15
POLY_INVERSE = pow(POLY, -1, 1 << 64)
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def byte_values() -> np.ndarray:
    """A 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(POLY))


class RunHasher:
    """Hashes of byte ranges of a block; keeps the powers for the longest block seen."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, values: np.ndarray) -> np.ndarray:
        n = len(values) + 1
        if n > len(self.up):
            self.up, self.down = (np.multiply.accumulate(np.concatenate(
                [np.ones(1, np.uint64), np.full(n - 1, p, np.uint64)])) for p in (POLY, POLY_INVERSE))
        out = np.zeros(n, np.uint64)
        np.cumsum(values * self.up[:n - 1], out=out[1:])
        return out

    def hashes(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def runs(kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every longest run of one non-zero kind."""
    edge = np.flatnonzero(np.diff(kind, prepend=0, append=0))
    start, end = edge[:-1], edge[1:]
    real = kind[start] != 0
    return start[real], end[real]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts in one buffer, each closed by a line feed; and where each begins."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    return data, np.cumsum(size) - size


def repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which entries have an equal one anywhere, and which have an equal one before them."""
    order = np.argsort(key, kind="stable")
    equal = key[order[1:]] == key[order[:-1]]
    some, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    some[order[1:][equal]] = True
    some[order[:-1][equal]] = True
    later[order[1:][equal]] = True
    return some, later


def equal_entries(entries: Iterable[Hashable]) -> tuple[np.ndarray, np.ndarray]:
    """Like ``repeats``, by the entries' own values."""
    numbers: dict[Hashable, int] = {}
    return repeats(np.array([numbers.setdefault(e, len(numbers)) for e in entries], np.int64))
