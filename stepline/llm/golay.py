"""The binary (23, 12, 7) Golay code, as a fuzzy hash.

The code is perfect: each 23-bit word is within 3 bits of exactly one codeword.  A word's
keys are the indices (12 bits) of its nearby codewords: the nearest alone if that is at
most 2 bits away, else the six at 3 or 4 bits.  If two words differ in at most one bit,
the nearest codeword of either is among the keys of the other:

* if y's nearest is at most 2 bits away, it is within 3 of x, hence x's nearest as well;
* else x's nearest, at most 3 bits from x, is at 3 or 4 bits from y, hence one of y's six.

All tables are made from the generator polynomial.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

#: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
GENERATOR = 0b101011100011
BITS, CHECK = 23, 11
MOST_KEYS = 6


def remainder(word: int) -> int:
    """The syndrome: the word as a polynomial, modulo the generator."""
    for i in range(BITS - 1, CHECK - 1, -1):
        if word >> i & 1:
            word ^= GENERATOR << (i - CHECK)
    return word


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(syndromes of the upper 12 bits; by syndrome: the error patterns that lead to the keys' codewords; how many)."""
    upper = np.array([remainder(i << CHECK) for i in range(1 << (BITS - CHECK))], np.int64)
    one = [remainder(1 << i) for i in range(BITS)]
    leader: dict[int, int] = {}
    for size in range(4):
        for at in combinations(range(BITS), size):
            pattern = syndrome = 0
            for i in at:
                pattern |= 1 << i
                syndrome ^= one[i]
            leader[syndrome] = pattern
    patterns, count = np.zeros((1 << CHECK, MOST_KEYS), np.int64), np.ones(1 << CHECK, np.int64)
    for syndrome, pattern in leader.items():
        near = {pattern}
        if pattern.bit_count() == 3:
            # what lies 4 bits away is the nearest to a word one flip away
            near |= {leader[syndrome ^ one[i]] ^ (1 << i) for i in range(BITS)}
        near = sorted(near)
        count[syndrome] = len(near)
        patterns[syndrome, : len(near)] = near
        patterns[syndrome, len(near) :] = near[0]
    return upper, patterns, count


def nearest(words: np.ndarray) -> np.ndarray:
    """The index of each word's nearest codeword."""
    upper, patterns, _ = tables()
    syndrome = upper[words >> CHECK] ^ (words & ((1 << CHECK) - 1))
    errors = patterns[syndrome]
    closest = errors[np.arange(len(words)), np.argmin(np.bitwise_count(errors), 1)]
    return (words ^ closest) >> CHECK


def keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each word's keys, (n, 6), and which of them count."""
    upper, patterns, count = tables()
    syndrome = upper[words >> CHECK] ^ (words & ((1 << CHECK) - 1))
    return (words[:, None] ^ patterns[syndrome]) >> CHECK, np.arange(MOST_KEYS) < count[syndrome][:, None]
