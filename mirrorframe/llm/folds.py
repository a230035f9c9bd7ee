"""Fixed folds by document id and bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def held_out(id_col: str, folds: int, fold: int) -> Column:
    """Whether the id belongs to the fold that is never learned from; a null id does."""
    return F.coalesce(remainder(id_col, folds) == fold, F.lit(True))


def sample(rows: DataFrame, id_col: str, size: int) -> DataFrame:
    """At most `size` rows with different ids, the same ones however the table is split."""
    return rows.dropDuplicates([id_col]).orderBy(F.xxhash64(F.col(id_col)), id_col).limit(size)
