"""A keyed bijection on 0 .. n-1 as a column expression: unique numbers without a shuffle or a sort.

A number is split into a remainder and a quotient, which take turns in being shifted by a hash of the other (a Feistel
network over two moduli whose product is n or little more). A result that is not below n is sent through again (cycle
walking) until it is; as each step is a bijection, so is the whole.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirrorframe.functions import random as rnd

ROUNDS = 4
# Moduli that are tried for the least excess over n.
TRIED = 256


def moduli(n: int) -> tuple[int, int]:
    """(a, b) with a * b >= n, near its square root and with little excess."""
    root = math.isqrt(max(n - 1, 0)) + 1
    return min(((a, -(-n // a)) for a in range(root, root + max(1, min(TRIED, root)))), key=lambda ab: (ab[0] * ab[1] - n, ab[0]))


def _shift(seed: int | str, stream: str, k: int, number: int, size: int) -> int:
    head = hashlib.md5(f"{seed}|{stream}#{k}|{number}".encode()).hexdigest()[:13]
    return math.floor(int(head, 16) / 2**52 * size)


def once(seed: int | str, stream: str, number: int, n: int) -> int:
    """One pass through the network, as the expression makes it; the result is below a * b."""
    a, b = moduli(n)
    left, right = number % a, number // a
    for k in range(ROUNDS):
        size = b if k % 2 else a
        left, right = right, (left + _shift(seed, stream, k, right, size)) % size
    return right * a + left if ROUNDS % 2 else left + a * right


@lru_cache(maxsize=64)
def walks(seed: int | str, stream: str, n: int) -> int:
    """How often a number is sent through again at most. Only the few numbers from n to a * b - 1 are followed."""
    a, b = moduli(n)
    longest = 0
    for start in range(n, a * b):
        at, steps = start, 0
        while at >= n:
            at, steps = once(seed, stream, at, n), steps + 1
        longest = max(longest, steps)
    return longest


def permuted(seed: int | str, stream: str, number: Column, n: int) -> Column:
    """The place of `number` (0 .. n-1) under the permutation that `seed` and `stream` name."""
    if n < 2:
        return number.cast("bigint")
    a, b = moduli(n)

    def through(value: Column) -> Column:
        left, right = value % a, F.floor(value / F.lit(a)).cast("bigint")
        for k in range(ROUNDS):
            size = b if k % 2 else a
            left, right = right, (left + rnd.index(seed, f"{stream}#{k}", right, F.lit(size))) % size
        return right * a + left if ROUNDS % 2 else left + right * a

    out = through(number.cast("bigint"))
    again = walks(seed, stream, n)
    if again:
        steps = F.sequence(F.lit(1), F.lit(again))
        walked = F.aggregate(steps, out, lambda at, _: F.when(at < n, at).otherwise(through(at)))
        out = F.when(out < n, out).otherwise(walked)
    return out
