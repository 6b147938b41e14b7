"""Shingle sets of texts, their MinHash signatures, and posterior bounds on similarity."""

from __future__ import annotations

import functools
import math

import numpy as np
import xxhash

# Signature values are cut to 16 bits; so many unequal sets agree in one by chance.
CHANCE = 2.0**-16
# Shingles whose hashes are held at once; longer sets go through in pieces.
PIECE = 1024
CACHE_WORDS = 150_000

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))  # a published 64-bit mixer


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles of texts, A-Z lower-cased, words between blanks."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def words(self, text: str | None) -> list[bytes]:
        # On bytes, lower() and split() know ASCII letters and blanks only, as asked.
        return (text or "").encode("utf-8", "surrogatepass").lower().split()

    def set_of(self, text: str | None) -> np.ndarray:
        """Sorted distinct 64-bit shingle hashes; the whole text if it has too few words."""
        words = self.words(text)
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(words))
        rows = len(words) - width + 1
        value = np.full(rows, width, np.uint64)
        for i in range(width):
            value = _mixed(value + np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + rows])
        return np.unique(value)


@functools.cache
def _permutations(hashes: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.Generator(np.random.PCG64(2024))
    odd = random.integers(0, 1 << 63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd[:, None], random.integers(0, 1 << 63, hashes, dtype=np.uint64)[:, None]


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """The top 16 bits of a mix of the least value of each hash function over the set."""
    times, plus = _permutations(hashes)
    least = np.full(hashes, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), PIECE):
        np.minimum(least, (shingles[None, i : i + PIECE] * times + plus).min(axis=1), out=least)
    # Least values are small, so their top bits alone would agree too often.
    return (_mixed(least) >> np.uint64(48)).astype(np.uint16)


def fingerprint(shingles: np.ndarray) -> tuple[int, int]:
    """128 bits of the set, as two signed numbers."""
    digest = xxhash.xxh3_128_digest(shingles.tobytes())
    return tuple(int(x) for x in np.frombuffer(digest, np.int64))


@functools.cache
def least_agreement(hashes: int, step: int, threshold: float, miss: float) -> tuple[tuple[int, int], ...]:
    """(values compared, fewest that must agree) after each batch of ``step`` values.

    With a uniform prior the similarity after m agreements of n is Beta(m + 1, n - m + 1)
    distributed; a pair is given up once the chance that its similarity reaches the
    threshold falls below ``miss``. That chance is a binomial tail.
    """
    out = []
    for n in range(step, hashes + 1, step):
        # P(Beta(m + 1, n - m + 1) >= t) = P(Binomial(n + 1, t) <= m)
        tail = 0.0
        for m in range(n + 1):
            tail += math.exp(
                math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold)
            )
            if tail >= miss:
                out.append((n, m))
                break
    return tuple(out)


def may_reach(left: np.ndarray, right: np.ndarray, threshold: float, miss: float, step: int) -> np.ndarray:
    """Numbers of the row pairs that are not given up after any batch."""
    alive = np.arange(len(left))
    agree = np.zeros(len(left), int)
    done = 0
    for n, least in least_agreement(left.shape[1], step, threshold, miss):
        agree = agree + (left[alive, done:n] == right[alive, done:n]).sum(axis=1)
        alive, agree, done = alive[agree >= least], agree[agree >= least], n
    return alive


def share_enough(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |intersection| >= percent * |union| of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both) and both > 0
