"""Running aggregates and numbering that do not depend on any group fitting in one task.

A plain ordered window sends a whole group to one task. Here it is used only after the size of the
largest group has been checked; beyond that the rows are range-partitioned over the cluster, each
slice gets a local window, and slice totals supply the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorframe.session import materialize

# Rows of one group that a single window task may sort.
WINDOW_ROWS = 1_000_000

_FUNCTIONS = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Running:
    """One running aggregate: `function` over `column` into `output`; `inclusive` counts the row itself."""

    output: str
    function: str
    column: str
    inclusive: bool = True


def running(
    df: DataFrame,
    part: Sequence[str],
    order: Sequence[Column],
    specs: Sequence[Running],
    window_rows: int = WINDOW_ROWS,
    stored: bool = False,
) -> DataFrame:
    """`df` plus running aggregates per `part` in `order`; (`part`, `order`) must identify a row.

    The input is read several times, so it is written out first unless it is `stored` already.
    """
    part = list(part)
    base = df if stored else materialize(df)
    sizes = base.groupBy(*part).agg(F.count(F.lit(1)).alias("n"))
    largest, rows = sizes.agg(F.max("n"), F.sum("n")).first()
    if (largest or 0) <= window_rows:
        return base.withColumns(_windowed(specs, part, order))

    slices = max(int(base.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // window_rows))
    sliced = materialize(
        base.repartitionByRange(slices, *[F.col(c) for c in part], *order).withColumn("_slice", F.spark_partition_id())
    )
    local = sliced.withColumns(_windowed(specs, [*part, "_slice"], order))
    totals = sliced.groupBy(*part, "_slice").agg(
        *[_FUNCTIONS[s.function](s.column).alias(f"_t_{s.output}") for s in specs]
    )
    # One row per (group, slice): at most `slices` rows in any group.
    before = Window.partitionBy(*(part or [F.lit(0)])).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *part, "_slice", *[_FUNCTIONS[s.function](f"_t_{s.output}").over(before).alias(f"_o_{s.output}") for s in specs]
    )
    keys = [local[c].eqNullSafe(offsets[c]) for c in [*part, "_slice"]]
    joined = local.join(offsets, keys)
    return joined.select(
        *[local[c] for c in base.columns],
        *[_combine(s, local[s.output], offsets[f"_o_{s.output}"]).alias(s.output) for s in specs],
    )


def _windowed(specs, part, order):
    out = {}
    for spec in specs:
        window = Window.partitionBy(*(part or [F.lit(0)])).orderBy(*order)
        window = window.rowsBetween(Window.unboundedPreceding, 0 if spec.inclusive else -1)
        out[spec.output] = _FUNCTIONS[spec.function](spec.column).over(window)
    return out


def _combine(spec: Running, local: Column, offset: Column) -> Column:
    if spec.function == "max":
        return F.greatest(local, offset)
    if spec.function == "min":
        return F.least(local, offset)
    return F.when(local.isNotNull() | offset.isNotNull(), F.coalesce(local, F.lit(0)) + F.coalesce(offset, F.lit(0)))


def numbered(
    df: DataFrame, part: Sequence[str], order: Sequence[Column], output: str = "idx", window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """Dense numbers from 0 per `part` in `order`."""
    one = df.withColumn("_one", F.lit(1).cast("bigint"))
    counted = running(one, part, order, [Running("_before", "sum", "_one", inclusive=False)], window_rows)
    return counted.withColumn(output, F.coalesce("_before", F.lit(0)).cast("bigint")).drop("_one", "_before")


def _spread(df: DataFrame, value: str, digits: int) -> DataFrame:
    hashed = df.withColumn("_hash", F.coalesce(F.md5(F.col(value).cast("string")), F.lit("")))
    return hashed.withColumn("_lead", F.substring("_hash", 1, digits))


def hash_numbered(
    df: DataFrame, part: Sequence[str], value: str, output: str = "idx", digits: int = 3
) -> DataFrame:
    """Dense numbers from 0 per `part` for distinct values, in md5 order (null first).

    Unordered domains need no sampling to be split evenly: the leading hash `digits` are the slices.
    """
    part = list(part)
    spread = _spread(df, value, digits)
    counts = spread.groupBy(*part, "_lead").agg(F.count(F.lit(1)).alias("_n"))
    # At most 16 ** digits + 1 lead values per group.
    before = Window.partitionBy(*(part or [F.lit(0)])).orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*part, "_lead", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*part, "_lead").orderBy("_hash", F.col(value))
    return (
        spread.withColumn("_local", F.row_number().over(local) - 1)
        .join(offsets, [*part, "_lead"])
        .withColumn(output, (F.col("_off") + F.col("_local")).cast("bigint"))
        .drop("_hash", "_lead", "_local", "_off")
    )


def hash_ranges(df: DataFrame, part: Sequence[str], value: str, weight: str, digits: int = 3) -> DataFrame:
    """Adds `start` and `stop`: consecutive ranges of length `weight` per `part`, in md5 order of `value`."""
    part = list(part)
    spread = _spread(df, value, digits)
    totals = spread.groupBy(*part, "_lead").agg(F.sum(weight).alias("_n"))
    before = Window.partitionBy(*(part or [F.lit(0)])).orderBy("_lead").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*part, "_lead", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = Window.partitionBy(*part, "_lead").orderBy("_hash", F.col(value))
    return (
        spread.withColumn("_cum", F.sum(weight).over(local.rowsBetween(Window.unboundedPreceding, 0)))
        .join(offsets, [*part, "_lead"])
        .withColumn("stop", (F.col("_off") + F.col("_cum")).cast("bigint"))
        .withColumn("start", (F.col("stop") - F.col(weight)).cast("bigint"))
        .drop("_hash", "_lead", "_cum", "_off")
    )
