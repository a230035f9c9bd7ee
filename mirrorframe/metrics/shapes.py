"""Column shapes: how alike the distributions of single columns are."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions import scalar as S
from mirrorframe.operators.prefix import WINDOW_ROWS, Running, running
from mirrorframe.session import materialize, spread
from mirrorframe.synth.simple import as_number


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole.cast("double"))


def column_values(df: DataFrame, columns: list[str], numeric: bool) -> DataFrame:
    """(at, value) rows of the non-null values of `columns`; `at` is a position in `columns`."""
    def value(c):
        return S.no_nan(as_number(df.schema, c).cast("double")) if numeric else F.col(c).cast("string")

    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("at"), value(c).alias("value")) for i, c in enumerate(columns)]))
    # Only the columns asked for are read and redistributed.
    return spread(df.select(*columns)).select(pairs.alias("p")).select("p.*").where("value is not null")


def paired_counts(
    real: DataFrame, synthetic: DataFrame, columns: list[str], numeric: bool, prefix: str = ""
) -> DataFrame:
    """(column, value, n_real, n_synthetic), counted map-side first: a hot value is one row per task.

    Columns are named, with a `prefix`, once the values have been counted.
    """
    if real.sameSemantics(synthetic):
        # The same rows on both sides are counted once.
        once = column_values(real, columns, numeric).groupBy("at", "value").agg(F.count(F.lit(1)).alias("n_real"))
        counts = once.withColumn("n_synthetic", F.col("n_real"))
    else:
        both = column_values(real, columns, numeric).withColumn("is_real", F.lit(1)).unionByName(
            column_values(synthetic, columns, numeric).withColumn("is_real", F.lit(0))
        )
        counts = both.groupBy("at", "value").agg(
            F.sum("is_real").cast("bigint").alias("n_real"), F.sum(1 - F.col("is_real")).cast("bigint").alias("n_synthetic")
        )
    name = F.element_at(F.array(*[F.lit(prefix + c) for c in columns]), F.col("at") + 1)
    return counts.select(name.alias("column"), "value", "n_real", "n_synthetic")


def ks_complement(
    real: DataFrame, synthetic: DataFrame, columns: list[str], window_rows: int = WINDOW_ROWS
) -> DataFrame:
    """1 minus the largest gap between the empirical distribution functions, per numeric or datetime column."""
    return ks_of_counts(paired_counts(real, synthetic, columns, numeric=True), window_rows)


def ks_of_counts(counts: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    counts = materialize(counts)
    cumulated = running(
        counts, ["column"], [F.col("value")],
        [Running("c_real", "sum", "n_real"), Running("c_synthetic", "sum", "n_synthetic")], window_rows, stored=True,
    )
    totals = counts.groupBy("column").agg(
        F.sum("n_real").alias("t_real"), F.sum("n_synthetic").alias("t_synthetic")
    )
    gap = F.abs(share(F.col("c_real"), F.col("t_real")) - share(F.col("c_synthetic"), F.col("t_synthetic")))
    return cumulated.join(totals, "column").groupBy("column").agg((1.0 - F.max(gap)).alias("score"))


def _with_totals(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("column").agg(
        F.sum("n_real").alias("t_real"), F.sum("n_synthetic").alias("t_synthetic"),
        F.count(F.lit(1)).alias("n_values"),
    )
    return counts.join(totals, "column")


def tv_complement(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """1 minus half the summed frequency differences, per categorical column."""
    return tv_of_counts(paired_counts(real, synthetic, columns, numeric=False))


def tv_of_counts(counts: DataFrame) -> DataFrame:
    gap = F.abs(share(F.col("n_real"), F.col("t_real")) - share(F.col("n_synthetic"), F.col("t_synthetic")))
    return _with_totals(counts).groupBy("column").agg((1.0 - F.sum(gap) / 2).alias("score"))


def chi_square(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Homogeneity test of both sides' category counts: statistic, degrees of freedom and p-value (the score)."""
    counts = _with_totals(paired_counts(real, synthetic, columns, numeric=False))
    both, rows = F.col("n_real") + F.col("n_synthetic"), F.col("t_real") + F.col("t_synthetic")

    def term(observed, total):
        expected = F.col(total).cast("double") * both / rows
        return F.pow(F.col(observed) - expected, F.lit(2.0)) / expected

    tested = counts.groupBy("column").agg(
        F.sum(term("n_real", "t_real") + term("n_synthetic", "t_synthetic")).alias("statistic"),
        (F.max("n_values") - 1).alias("dof"),
    )
    return tested.withColumn("score", chi_square_tail(F.col("statistic"), F.col("dof")))


@F.pandas_udf(T.DoubleType())
def chi_square_tail(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    """P(X >= statistic); one value per tested column."""
    return pd.Series([upper_gamma(d / 2, s / 2) if d > 0 else 1.0 for s, d in zip(statistic, dof, strict=True)])


def upper_gamma(a: float, x: float) -> float:
    """Regularized upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1.0 - scale * total)
    # Continued fraction, evaluated from the far end.
    steps = 200 + int(20 * math.sqrt(a))
    fraction = 0.0
    for i in range(steps, 0, -1):
        fraction = i * (i - a) / (x + 2 * i + 1 - a - fraction)
    return scale / (x + 1 - a - fraction)
