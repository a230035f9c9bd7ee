"""Mixed-type encoding: numbers imputed (and mapped to normal scores), text as codes, ids regenerated."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions import gaussian
from mirrorframe.functions import scalar as S
from mirrorframe.operators import prefix
from mirrorframe.session import materialize
from mirrorframe.sources.metadata import INTEGER_TYPES, NUMERIC_TYPES, TableSpec
from mirrorframe.synth import lookup

# The category that stands for a missing value, the most distinct whole numbers a column
# may hold to be snapped back, and the bounds on the number of quantiles.
MISSING_CATEGORY = "__nan__"
MAX_SNAPPED = 32
MIN_QUANTILES, MAX_QUANTILES, ROWS_PER_QUANTILE = 10, 1000, 30


@dataclass
class EncoderModel:
    schema: T.StructType
    table: TableSpec
    numbers: list[str]
    categories: list[str]
    ids: list[str]
    means: dict[str, float]
    snapped: dict[str, list[float]]
    quantiles: dict[str, list[float]]
    # column, value, idx
    codes: DataFrame | None
    sizes: dict[str, int] = field(default_factory=dict)


def _as_double(model_table: TableSpec, column: str) -> Column:
    spec = model_table.columns[column]
    if spec.sdtype == "datetime":
        return S.to_micros(F.col(column), spec.datetime_format).cast("double")
    return S.safe_double(F.col(column))


def fit(data: DataFrame, table: TableSpec, normal_scores: bool = True) -> EncoderModel:
    numbers = [c for c in table.columns if table.columns[c].sdtype in ("numerical", "datetime")]
    ids = [c for c in table.columns if table.columns[c].sdtype == "id"]
    categories = [c for c in table.columns if c not in (*numbers, *ids)]

    means, snapped, quantiles = {}, {}, {}
    if numbers:
        values = data.select(*[_as_double(table, c).alias(c) for c in numbers])
        first = values.agg(F.count(F.lit(1)).alias("rows"), *[F.avg(c).alias(c) for c in numbers]).first()
        means = {c: first[c] if first[c] is not None else 0.0 for c in numbers}
        filled = values.select(*[F.coalesce(c, F.lit(means[c])).alias(c) for c in numbers])
        whole = [c for c in numbers if table.columns[c].sdtype == "numerical"]
        snapped = _few_whole_values(filled, whole)
        if normal_scores:
            n = max(min(first["rows"] // ROWS_PER_QUANTILE, MAX_QUANTILES), MIN_QUANTILES)
            levels = [i / (n - 1) for i in range(n)]
            row = filled.agg(*[F.percentile_approx(c, levels, 10 * MAX_QUANTILES).alias(c) for c in numbers]).first()
            quantiles = {c: list(row[c]) for c in numbers}

    codes, sizes = None, {}
    if categories:
        text = data.select(*[_category(c).alias(c) for c in categories])
        distinct = lookup.value_counts(text, categories).select("column", "value")
        codes = materialize(prefix.numbered(distinct, ["column"], [F.col("value")]))
        sizes = {r["column"]: r["n"] for r in codes.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return EncoderModel(data.schema, table, numbers, categories, ids, means, snapped, quantiles, codes, sizes)


def _category(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(MISSING_CATEGORY))


def _few_whole_values(filled: DataFrame, columns: list[str]) -> dict[str, list[float]]:
    """Values of the columns that hold at most MAX_SNAPPED distinct numbers, all of them whole.

    Distinct values are counted approximately first; only columns near the limit are listed.
    """
    if not columns:
        return {}
    row = filled.agg(*[F.approx_count_distinct(c).alias(c) for c in columns],
                     *[F.bool_and(F.col(c) == F.bround(c, 0)).alias(f"{c}|whole") for c in columns]).first()
    near = [c for c in columns if row[f"{c}|whole"] and row[c] <= 2 * MAX_SNAPPED]
    if not near:
        return {}
    listed = filled.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in near]).first()
    return {c: list(listed[c]) for c in near if len(listed[c]) <= MAX_SNAPPED}


def encode(data: DataFrame, model: EncoderModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """Numbers as doubles, categories as codes; `keep` passes columns through."""
    out = {}
    for c in model.numbers:
        value = F.coalesce(_as_double(model.table, c), F.lit(model.means[c]))
        out[c] = _to_normal(model.quantiles[c])(value) if model.quantiles else value
    coded = data.select(*keep, *[e.alias(c) for c, e in out.items()], *[_category(c).alias(c) for c in model.categories])
    for c in model.categories:
        codes = model.codes.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("idx").alias("_i"))
        coded = coded.join(codes, F.col(c) == F.col("_v")).withColumn(c, F.col("_i")).drop("_v", "_i")
    return coded


def decode(encoded: DataFrame, model: EncoderModel, row_id: str = "id", order: list[str] | None = None) -> DataFrame:
    """Back to the original types; ids count the rows from 0, by `row_id` if it does so already.

    With `order` the rows are numbered by these columns first (over slices, not in one task), into `row_id`.
    """
    out = encoded if order is None else prefix.numbered(encoded, [], [F.col(c) for c in order], row_id)
    for c in model.numbers:
        value = _from_normal(model.quantiles[c])(F.col(c)) if model.quantiles else F.col(c)
        if c in model.snapped:
            value = _nearest(value, model.snapped[c])
        spec, target = model.table.columns[c], model.schema[c].dataType
        if spec.sdtype == "datetime":
            value = S.from_micros(F.bround(value, 0), spec.datetime_format)
        elif isinstance(target, INTEGER_TYPES):
            value = F.bround(value, 0)
        out = out.withColumn(c, value.cast(target))
    for c in model.categories:
        codes = model.codes.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("idx").alias("_i"))
        number = F.bround(F.col(c).cast("double"), 0).cast("bigint")
        decoded = F.nullif(F.col("_v"), F.lit(MISSING_CATEGORY)).try_cast(model.schema[c].dataType)
        out = out.withColumn(c, number).join(codes, F.col(c) == F.col("_i")).withColumn(c, decoded).drop("_v", "_i")
    for c in model.ids:
        numeric = isinstance(model.schema[c].dataType, (*INTEGER_TYPES, *NUMERIC_TYPES))
        number = F.col(row_id).cast("bigint")
        out = out.withColumn(c, number if numeric else F.concat(F.lit(f"{c}_"), number.cast("string")))
    return out


def _nearest(value: Column, allowed: list[float]) -> Column:
    """The closest allowed value, the lower of two equally close."""
    ranked = F.transform(
        F.array(*[F.lit(float(a)) for a in allowed]), lambda a: F.struct(F.abs(a - value).alias("gap"), a.alias("value"))
    )
    return F.array_min(ranked)["value"]


def _to_normal(grid: list[float]):
    points, first = np.unique(np.asarray(grid), return_index=True)
    last = len(grid) - 1 - np.unique(np.asarray(grid)[::-1], return_index=True)[1]
    levels = (first + last) / 2 / max(len(grid) - 1, 1)

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(gaussian.inverse_cdf(np.interp(x.to_numpy(dtype=float), points, levels)))

    return score


def _from_normal(grid: list[float]):
    levels = np.linspace(0.0, 1.0, len(grid))

    @F.pandas_udf(T.DoubleType())
    def value(z: pd.Series) -> pd.Series:
        return pd.Series(np.interp(gaussian.cdf(z.to_numpy(dtype=float)), levels, grid))

    return value
