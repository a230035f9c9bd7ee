"""The binary Golay code of 23 bits: 4,096 codewords, and every word of 23 bits is within three bits of exactly one.

Two words that differ in at most two bits have a word between them that is one bit from either at most; the codeword within
three bits of that one is within four bits of both. So the indices of all codewords within four bits of a word are keys
that words at a distance of two or less always share: six of them if the nearest codeword is three bits off, else one.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np

BITS, INDEX_BITS = 23, 12
# x^11 + x^9 + x^7 + x^6 + x^5 + x + 1, a factor of x^23 + 1.
GENERATOR = 0b101011100011
RADIUS = 4
KEYS = 6


def _remainder(word: int) -> int:
    for at in range(BITS - 1, BITS - INDEX_BITS - 1, -1):
        if word >> at & 1:
            word ^= GENERATOR << (at - (BITS - INDEX_BITS))
    return word


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """(remainder of each word, the errors of at most RADIUS bits for each remainder; a missing one repeats the first)."""
    single = [_remainder(1 << i) for i in range(BITS)]
    remainders = np.zeros(1, np.uint16)
    for i in range(BITS):
        remainders = np.concatenate([remainders, remainders ^ np.uint16(single[i])])
    errors: list[list[int]] = [[] for _ in range(1 << (BITS - INDEX_BITS))]
    for weight in range(RADIUS + 1):
        for places in combinations(range(BITS), weight):
            word = sum(1 << p for p in places)
            errors[int(remainders[word])].append(word)
    return remainders, np.array([e + e[:1] * (KEYS - len(e)) for e in errors], np.uint32)


def indices(words: np.ndarray) -> np.ndarray:
    """For each word of BITS bits the indices (its upper 12 bits) of the codewords within RADIUS bits; KEYS columns, some repeated."""
    remainders, errors = _tables()
    words = words.astype(np.uint32)
    return (words[:, None] ^ errors[remainders[words]]) >> np.uint32(BITS - INDEX_BITS)
