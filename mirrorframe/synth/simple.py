"""Identity, uniform, per-column and bootstrap synthesizers, and label sampling."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions import mixtures
from mirrorframe.functions import random as rnd
from mirrorframe.functions import scalar as S
from mirrorframe.operators import prefix
from mirrorframe.sources.metadata import INTEGER_TYPES, NUMERIC_TYPES, Metadata, TableSpec
from mirrorframe.synth import lookup
from mirrorframe.synth.roles import ByMetadata

# Fixed value: most components of a column's mixture.
MAX_COMPONENTS = 5
TIME_TYPES = (T.TimestampType, T.TimestampNTZType, T.DateType)


def integers(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, INTEGER_TYPES)]


def reals(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def times(schema: T.StructType) -> list[str]:
    return [f.name for f in schema.fields if isinstance(f.dataType, TIME_TYPES)]


def objects(schema: T.StructType) -> list[str]:
    taken = {*integers(schema), *reals(schema), *times(schema)}
    return [f.name for f in schema.fields if f.name not in taken]


def as_number(schema: T.StructType, column: str):
    """Numbers as they are, datetimes as epoch micros."""
    if column in times(schema):
        return S.to_micros(F.col(column))
    return F.col(column)


class IdentitySynthesizer:
    name, modality = "IdentitySynthesizer", "single_table"

    def fit(self, data: DataFrame, table: TableSpec) -> DataFrame:
        return data

    def sample(self, model: DataFrame, n_rows: int) -> DataFrame:
        return model


@dataclass
class UniformModel:
    schema: T.StructType
    bounds: dict[str, tuple[Any, Any]]
    domains: DataFrame | None
    sizes: dict[str, int]


class UniformSynthesizer(ByMetadata):
    """Every column on its own: whole numbers in [min, max], distinct values evenly, the rest in [min, max).

    With a table's spec, keys, ids and personal data are made anew, and formatted datetimes are drawn as datetimes.
    """

    name, modality = "UniformSynthesizer", "single_table"

    def __init__(self, seed: int = 0):
        self.seed = seed

    def _fit(self, data: DataFrame) -> UniformModel:
        schema = data.schema
        ranged = [*integers(schema), *reals(schema), *times(schema)]
        bounds = {}
        if ranged:
            # One row of two values per column.
            row = data.agg(*[f(as_number(schema, c)).alias(f"{c}|{n}") for c in ranged
                             for f, n in ((F.min, "lo"), (F.max, "hi"))]).first()
            bounds = {c: (row[f"{c}|lo"], row[f"{c}|hi"]) for c in ranged}
        named = objects(schema)
        domains, sizes = lookup.domains(data, named) if named else (None, {})
        return UniformModel(schema, bounds, domains, sizes)

    def _rows(self, model: UniformModel, ids: DataFrame) -> DataFrame:
        i = F.col("id")
        columns = {}
        for f in model.schema.fields:
            c = f.name
            if c in model.sizes:
                columns[c] = rnd.index(self.seed, c, i, F.lit(model.sizes[c]))
                continue
            low, high = model.bounds[c]
            if low is None:
                columns[c] = F.lit(None).cast(f.dataType)
            elif c in integers(model.schema):
                columns[c] = (F.lit(low) + rnd.index(self.seed, c, i, F.lit(high) - F.lit(low) + 1)).cast(f.dataType)
            else:
                value = F.lit(low) + rnd.uniform(self.seed, c, i) * (F.lit(high) - F.lit(low))
                if c in times(model.schema):
                    value = S.from_micros(F.floor(value))
                columns[c] = value.cast(f.dataType)
        drawn = ids.withColumns(columns)
        for c, size in model.sizes.items():
            drawn = lookup.pick(drawn, c, model.domains, c, size, c)
            drawn = drawn.withColumn(c, F.col(c).cast(model.schema[c].dataType))
        return drawn.select("id", *model.schema.fieldNames())


class MultiTableUniformSynthesizer:
    """A uniform synthesizer per table; keys are drawn like other columns and not linked."""

    name, modality = "MultiTableUniformSynthesizer", "multi_table"

    def __init__(self, seed: int = 0):
        self.seed = seed

    def fit(self, data: dict[str, DataFrame], metadata: Metadata | None = None) -> dict:
        return {
            name: (UniformSynthesizer(f"{self.seed}.{name}").fit(df), df.count()) for name, df in data.items()
        }

    def sample(self, model: dict, scale: float = 1.0) -> dict[str, DataFrame]:
        return {
            name: UniformSynthesizer(f"{self.seed}.{name}").sample(one, int(rows * scale))
            for name, (one, rows) in model.items()
        }


@dataclass
class ColumnModel:
    schema: T.StructType
    ranges: DataFrame | None
    sizes: dict
    # column -> (weights, means, deviations, low, high, null share)
    mixtures: dict[str, tuple]


class ColumnSynthesizer(ByMetadata):
    """Every column on its own: text resampled by frequency, numbers from a clipped Gaussian mixture.

    With a table's spec, keys, ids and personal data are made anew.
    """

    name, modality = "ColumnSynthesizer", "single_table"

    def __init__(self, seed: int = 0, iterations: int = 20):
        self.seed, self.iterations = seed, iterations

    def _fit(self, data: DataFrame) -> ColumnModel:
        schema = data.schema
        named = objects(schema)
        ranges, sizes = None, {}
        if named:
            ranges, sizes = lookup.frequency_ranges(lookup.value_counts(data, named), ["column"])
        numbers = [c for c in schema.fieldNames() if c not in named]
        mixtures = self._fit_mixtures(data, numbers) if numbers else {}
        return ColumnModel(schema, ranges, sizes, mixtures)

    def _fit_mixtures(self, data, numbers):
        schema = data.schema
        numeric = data.select(*[S.no_nan(as_number(schema, c).cast("double")).alias(c) for c in numbers])
        stats = numeric.agg(*[e for c in numbers for e in (
            F.min(c).alias(f"{c}|lo"), F.max(c).alias(f"{c}|hi"), F.avg(c).alias(f"{c}|mean"),
            F.stddev_pop(c).alias(f"{c}|sd"), F.count(c).alias(f"{c}|n"),
            F.approx_count_distinct(c).alias(f"{c}|distinct"),
        )], F.count(F.lit(1)).alias("rows")).first()
        out, varied = {}, []
        for c in numbers:
            low, high, mean, sd = (stats[f"{c}|{k}"] for k in ("lo", "hi", "mean", "sd"))
            nulls = 1.0 - stats[f"{c}|n"] / stats["rows"] if stats["rows"] else 1.0
            # Nothing or one value leaves no mixture to fit.
            out[c] = ([1.0], [mean], [0.0], low, high, nulls)
            if sd:
                varied.append(c)
        if not varied:
            return out
        scaled = [[(F.col(c) - stats[f"{c}|mean"]) / stats[f"{c}|sd"]] for c in varied]
        wanted = [mixtures.Wanted(i, min(stats[f"{c}|distinct"], MAX_COMPONENTS), 17) for i, c in enumerate(varied)]
        for c, found in zip(varied, mixtures.fit(mixtures.points(numeric, scaled), wanted, self.iterations), strict=True):
            mean, sd = stats[f"{c}|mean"], stats[f"{c}|sd"]
            means = [float(m) * sd + mean for m in found.means[:, 0]]
            spreads = [float(v) ** 0.5 * sd for v in found.covariances[:, 0, 0]]
            out[c] = ([float(w) for w in found.weights], means, spreads, *out[c][3:])
        return out

    def _rows(self, model: ColumnModel, ids: DataFrame) -> DataFrame:
        i = F.col("id")
        drawn = ids.withColumns({c: self._number(model, c, i) for c in model.mixtures})
        for (c,), (total, distinct) in model.sizes.items():
            drawn = drawn.withColumn(c, rnd.index(self.seed, c, i, F.lit(total)))
            drawn = lookup.range_lookup(drawn, c, model.ranges.where(F.col("column") == c), total, distinct, c)
            drawn = drawn.withColumn(c, F.col(c).cast(model.schema[c].dataType))
        return drawn.select("id", *model.schema.fieldNames())

    def _number(self, model, c, i):
        weights, means, spreads, low, high, nulls = model.mixtures[c]
        data_type = model.schema[c].dataType
        if low is None:
            return F.lit(None).cast(data_type)
        u = rnd.uniform(self.seed, c + "#component", i)
        reached, mean, spread = 0.0, F.lit(float(means[-1])), F.lit(float(spreads[-1]))
        bounds = []
        for w, m, s in zip(weights[:-1], means[:-1], spreads[:-1], strict=True):
            reached += w
            bounds.append((reached, m, s))
        for edge, m, s in reversed(bounds):
            mean = F.when(u < edge, F.lit(float(m))).otherwise(mean)
            spread = F.when(u < edge, F.lit(float(s))).otherwise(spread)
        value = mean + spread * rnd.normal(self.seed, c, i)
        value = F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
        if c in integers(model.schema):
            value = F.bround(value, 0).cast(data_type)
        elif c in times(model.schema):
            value = S.from_micros(F.bround(value, 0)).cast(data_type)
        else:
            value = value.cast(data_type)
        return F.when(rnd.uniform(self.seed, c + "#null", i) >= nulls, value) if nulls > 0 else value


def bootstrap_rows(data: DataFrame, keys: list[str], n_rows: int, seed: int | str = 0, row_id: str = "id") -> DataFrame:
    """Rows drawn with replacement; `keys` identify a row (up to exact copies).

    Rows are numbered in hash order, so the draw needs no global sort; both sides meet on a uniform number.
    """
    total = data.count()
    digits = 3 if total < 10**9 else 5
    tagged = data.withColumn("_key", F.concat_ws("|", *[F.col(k).cast("string") for k in keys]))
    rows = prefix.hash_numbered(tagged, [], "_key", "_n", digits=digits).drop("_key")
    draws = lookup.row_ids(data.sparkSession, n_rows).select(
        F.col("id").alias(row_id), rnd.index(seed, "bootstrap", F.col("id"), F.lit(total)).alias("_n")
    )
    return draws.join(rows, "_n").drop("_n")


def label_sample(data: DataFrame, label: str, n_rows: int, seed: int | str = 0, row_id: str = "id") -> DataFrame:
    """Labels drawn from their empirical distribution."""
    ranges, sizes = lookup.frequency_ranges(lookup.value_counts(data, [label]), ["column"])
    (total, distinct), = sizes.values()
    draws = lookup.row_ids(data.sparkSession, n_rows).select(
        F.col("id").alias(row_id), rnd.index(seed, label, F.col("id"), F.lit(total)).alias("_d")
    )
    picked = lookup.range_lookup(draws, "_d", ranges, total, distinct, label)
    return picked.select(row_id, F.col(label).cast(data.schema[label].dataType).alias(label))
