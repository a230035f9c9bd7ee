"""Words and shingles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters and digits make words; everything else parts them.
APART = r"[^\p{L}\p{N}]+"
# Rows that may be sent to all tasks: 8 to 40 bytes each, so 40 MB at most. Of rows that hold arrays of numbers, as many
# as have SENT_NUMBERS numbers, 40 MB as well.
SENT_ROWS = 1_000_000
SENT_NUMBERS = 5_000_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased words, in order; empty for null."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), APART), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, width: int) -> Column:
    """Hashes of the `width`-word shingles of an array of word hashes; empty if there are fewer words."""
    at = F.sequence(F.lit(1), F.size(words) - (width - 1))
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.element_at(words, (i + k).cast("int")) for k in range(width)]))
    return F.when(F.size(words) >= width, hashed).otherwise(F.array().cast("array<bigint>"))


def is_small(side: DataFrame) -> bool:
    """Whether `side`, which is counted for this, has at most SENT_ROWS rows."""
    return side.limit(SENT_ROWS + 1).count() <= SENT_ROWS


def sent_if_small(side: DataFrame) -> DataFrame:
    """`side`, sent to all tasks only if it is small; else joined by a shuffle."""
    return F.broadcast(side) if is_small(side) else side
