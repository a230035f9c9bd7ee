"""Counter-based random numbers: a pure function of (seed, stream, row number).

Unlike `rand()` they do not depend on partitioning or task retries, so a lost executor recomputes the
same rows, and any SQL engine with md5 reproduces them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thirteen hex digits are 52 bits: all values are exact doubles, and tables of up to 2^52 rows are reached whole.
_DIGITS = 13
_SPAN = 4503599627370496.0


def uniform(seed: int | str, stream: str, counter: Column) -> Column:
    """A double in [0, 1) from the first thirteen hex digits of md5(seed|stream|counter)."""
    text = F.concat(F.lit(f"{seed}|{stream}|"), counter.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("bigint").cast("double") / F.lit(_SPAN)


def index(seed: int | str, stream: str, counter: Column, size: Column) -> Column:
    """A whole number in [0, size)."""
    return F.floor(uniform(seed, stream, counter) * size.cast("double")).cast("bigint")


def normal(seed: int | str, stream: str, counter: Column) -> Column:
    """Standard normal by Box-Muller from two uniforms; 1-u keeps the logarithm finite."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(seed, stream + "#r", counter)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(seed, stream + "#a", counter))


def order_key(seed: int | str, *keys: Column) -> Column:
    """A pseudo-random order over rows identified by `keys`."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))
