"""Gaussian copula synthesizers: one copula for the table, one per segment, or on bootstrapped rows.

Fitting is three aggregations, each grouped by segment: quantile grids of numbers, frequency ranges of
text, and correlations of normal scores. What reaches the driver is bounded by segments x columns x grid.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions import gaussian
from mirrorframe.functions import random as rnd
from mirrorframe.functions import scalar as S
from mirrorframe.functions.moments import moments
from mirrorframe.session import materialize, spread
from mirrorframe.synth import lookup
from mirrorframe.synth.roles import ByMetadata
from mirrorframe.synth.simple import as_number, bootstrap_rows, integers, objects, times

# Quantiles of a number's distribution: even steps, and further points in the tails, where the ends of long ones lie.
GRID = 200
TAILS = (0.0001, 0.0003, 0.001, 0.0025)
LEVELS = np.array(sorted({*(i / GRID for i in range(GRID + 1)), *TAILS, *(1 - t for t in TAILS)}))
# One over the error of a quantile's rank.
ACCURACY = 20_000


@dataclass
class CopulaModel:
    schema: T.StructType
    numbers: list[str]
    texts: list[str]
    # segment -> share of rows, and per segment the lower triangle that correlates normal draws
    shares: dict[int, float]
    triangles: dict[int, np.ndarray]
    # (segment, column) -> quantile values and null share
    grids: dict[tuple[int, str], tuple[list[float], float]]
    ranges: DataFrame | None
    sizes: dict[tuple[int, str], tuple[int, int]]


def _number_grids(data: DataFrame, numbers: list[str], schema: T.StructType) -> dict:
    if not numbers:
        return {}
    levels = LEVELS.tolist()
    rows = data.groupBy("_segment").agg(F.count(F.lit(1)).alias("rows"), *[e for c in numbers for e in (
        F.percentile_approx(as_number(schema, c).cast("double"), levels, ACCURACY).alias(f"{c}|grid"),
        F.count(c).alias(f"{c}|n"),
    )]).collect()
    return {
        (r["_segment"], c): (list(r[f"{c}|grid"] or []), 1.0 - r[f"{c}|n"] / r["rows"])
        for r in rows for c in numbers
    }


def _scorer(numbers: list[str], grids: dict[tuple[int, str], tuple[list[float], float]]):
    """Normal scores of a batch: numbers, within their segment's quantile grid, and then shares of texts; NaN scores 0."""
    levels, steps = LEVELS, {}
    for key, (grid, _) in grids.items():
        if grid:
            points, first = np.unique(np.asarray(grid), return_index=True)
            last = len(grid) - 1 - np.unique(np.asarray(grid)[::-1], return_index=True)[1]
            # A value holding several quantiles scores at the middle of them.
            steps[key] = points, (levels[first] + levels[last]) / 2

    def scores(segments: np.ndarray, values: list[np.ndarray]) -> list[np.ndarray]:
        out = []
        for c, value in zip(numbers, values):  # the texts follow
            one = np.zeros(len(value))
            for s in np.unique(segments).tolist():
                rows = (segments == s) & ~np.isnan(value)
                if (s, c) in steps and rows.any():
                    one[rows] = gaussian.inverse_cdf(np.interp(value[rows], *steps[s, c]))
            out.append(one)
        return out + [gaussian.inverse_cdf(p) for p in values[len(numbers):]]

    return scores


def _fit(data: DataFrame, schema: T.StructType) -> CopulaModel:
    return fit_scored(data, schema)[0]


def fit_scored(data: DataFrame, schema: T.StructType, keep: tuple[str, ...] = ()) -> tuple[CopulaModel, DataFrame]:
    """The copula of the columns in `schema`, by `_segment`; also the normal scores that it was fitted to, with `keep`."""
    texts = objects(schema)
    numbers = [c for c in schema.fieldNames() if c not in texts]
    counts = {r["_segment"]: r["n"] for r in data.groupBy("_segment").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    grids = _number_grids(data, numbers, schema)

    ranges, sizes = None, {}
    scored = data.select("_segment", *[F.col(c).alias(f"_keep_{c}") for c in keep], *numbers, *[F.col(c).cast("string").alias(c) for c in texts])
    if texts:
        pairs = F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in texts
        ])).alias("p")
        freq = scored.select("_segment", pairs).groupBy("_segment", "p.column", "p.value").agg(
            F.count(F.lit(1)).alias("n")
        )
        ranges, sizes = lookup.frequency_ranges(freq, ["_segment", "column"])
        for c in texts:
            share = {s: sizes[(s, c)][0] for s in counts}
            middle = ranges.where(F.col("column") == c).select(
                F.col("_segment").alias("_s"), F.col("value").alias("_v"),
                ((F.col("start") + F.col("stop")) / 2).alias("_mid"),
            )
            n = F.element_at(F.create_map(*[x for s, v in share.items() for x in (F.lit(s), F.lit(float(v)))]), F.col("_segment"))
            scored = (
                scored.join(middle, (F.col("_segment") == F.col("_s")) & F.col(c).eqNullSafe(F.col("_v")))
                .withColumn(c, F.col("_mid") / n).drop("_s", "_v", "_mid")
            )
    columns = [*numbers, *texts]
    kept = [f"_keep_{c}" for c in keep]
    raw = scored.select("_segment", *kept, *[as_number(schema, c).cast("double").alias(c) for c in numbers], *texts)
    scorer, names = _scorer(numbers, grids), ["_segment", *kept, *columns]

    def score(batches):
        for batch in batches:
            fixed = batch.columns[: 1 + len(kept)]
            values = [v.to_numpy(zero_copy_only=False) for v in batch.columns[1 + len(kept):]]
            found = scorer(fixed[0].to_numpy(zero_copy_only=False), values)
            yield pa.RecordBatch.from_arrays([*fixed, *[pa.array(v, pa.float64()) for v in found]], names)

    scored = raw.mapInArrow(score, T.StructType([*raw.select("_segment", *kept).schema.fields, *[T.StructField(c, T.DoubleType()) for c in columns]]))
    triangles = {s: np.eye(len(columns)) for s in counts}
    if len(columns) > 1:
        # Scores are never null, so one matrix of products serves all pairs. They are made where they are added up: a task
        # then keeps one Python process busy.
        for segment, found in moments(raw, columns, F.col("_segment"), prepared=scorer).items():
            covariance = found.covariance
            spreads = np.sqrt(np.maximum(np.diag(covariance), 0.0))
            varies = spreads > 1e-9
            scale = np.where(varies, spreads, 1.0)
            matrix = np.where(np.outer(varies, varies), covariance / np.outer(scale, scale), 0.0)
            np.fill_diagonal(matrix, 1.0)
            triangles[segment] = _triangle(matrix)
    shares = {s: n / total for s, n in sorted(counts.items())}
    return CopulaModel(schema, numbers, texts, shares, triangles, grids, ranges, sizes), scored


def _triangle(matrix: np.ndarray) -> np.ndarray:
    """Cholesky factor, after lifting eigenvalues that rounding made non-positive."""
    values, vectors = np.linalg.eigh(matrix)
    lifted = vectors @ np.diag(np.maximum(values, 1e-6)) @ vectors.T
    scale = np.sqrt(np.diag(lifted))
    return np.linalg.cholesky(lifted / np.outer(scale, scale))


def sample_copula(model: CopulaModel, ids: DataFrame, seed: int | str, keep: tuple[str, ...] = (), shift: str | None = None) -> DataFrame:
    """Rows for the counters in `id` (unique, any type); `keep` passes columns through.

    The column `shift` holds what is added to a row's correlated normal draws, a number per column of the model.
    """
    columns = [*model.numbers, *model.texts]
    i = F.col("id")
    segment, reached = F.lit(max(model.shares)), 0.0
    edges = []
    for s, share in list(model.shares.items())[:-1]:
        reached += share
        edges.append((reached, s))
    u = rnd.uniform(seed, "#segment", i)
    for edge, s in reversed(edges):
        segment = F.when(u < edge, F.lit(s)).otherwise(segment)
    # Only columns that have nulls in some segment need a draw for them.
    missing = [c for c in model.numbers if any(model.grids[(s, c)][1] > 0 for s in model.triangles)]
    drawn = ids.select("id", *keep, segment.cast("int").alias("_segment"), F.array(*[
        rnd.normal(seed, c, i) for c in columns
    ]).alias("_z"), F.array(*[rnd.uniform(seed, c + "#null", i) for c in missing] or [F.lit(0.0)]).alias("_nulls"), *([F.col(shift).alias("_shift")] if shift else []))

    levels = LEVELS
    numbers, texts, grids, triangles = model.numbers, model.texts, model.grids, model.triangles
    kept = [drawn.schema[c] for c in keep]
    schema = T.StructType([
        drawn.schema["id"], *kept, T.StructField("_segment", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in columns],
    ])

    def matrix(values: pa.ListArray, rows: int) -> np.ndarray:
        return values.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, len(columns)))

    def correlate(batches):
        for batch in batches:
            seg = batch.column("_segment").to_numpy(zero_copy_only=False)
            z, nulls = (matrix(batch.column(c), len(seg)) for c in ("_z", "_nulls"))
            p = np.zeros_like(z)
            moved = matrix(batch.column("_shift"), len(seg)) if shift else np.zeros_like(z)
            for s, triangle in triangles.items():
                rows = seg == s
                if rows.any():
                    p[rows] = gaussian.cdf(z[rows] @ triangle.T + moved[rows])
            values = []
            for k, c in enumerate(columns):
                value = p[:, k].copy()
                if c in numbers:
                    for s in triangles:
                        grid, share = grids[(s, c)]
                        rows = seg == s
                        value[rows] = np.interp(p[rows, k], levels, grid) if grid else np.nan
                        if c in missing:
                            value[rows & (nulls[:, missing.index(c)] < share)] = np.nan
                values.append(pa.array(value, pa.float64()))
            passed = ["id", *keep, "_segment"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in passed], *values], [*passed, *columns])

    out = drawn.mapInArrow(correlate, schema)
    for c in texts:
        out = _texts(out, model, c)
    finals = {}
    for c in numbers:
        value = F.when(~F.isnan(c), F.col(c))
        if c in integers(model.schema):
            value = F.bround(value, 0)
        elif c in times(model.schema):
            value = S.from_micros(F.bround(value, 0))
        finals[c] = value.cast(model.schema[c].dataType)
    for c in texts:
        finals[c] = F.col(c).cast(model.schema[c].dataType)
    return out.withColumns(finals).select("id", *keep, *model.schema.fieldNames())


def _texts(rows: DataFrame, model: CopulaModel, c: str) -> DataFrame:
    """Turn the probability in `c` into the value holding it, segment by segment's own ranges.

    The ranges of all segments are laid end to end, so one lookup serves every segment.
    """
    offset, offsets, distinct = 0, {}, 0
    for s in model.shares:
        total, values = model.sizes[(s, c)]
        offsets[s] = (offset, total)
        offset += total
        distinct += values
    base = F.element_at(F.create_map(*[x for s, (o, _) in offsets.items() for x in (F.lit(s), F.lit(o).cast("bigint"))]), F.col("_segment"))
    size = F.element_at(F.create_map(*[x for s, (_, t) in offsets.items() for x in (F.lit(s), F.lit(t).cast("bigint"))]), F.col("_segment"))
    inside = F.least(F.floor(F.col(c) * size).cast("bigint"), size - 1)
    ranges = model.ranges.where(F.col("column") == c).select(
        "value", (F.col("start") + base).alias("start"), (F.col("stop") + base).alias("stop")
    )
    return lookup.range_lookup(rows.withColumn(c, base + inside), c, ranges, offset, distinct, c)


class GaussianCopulaSynthesizer(ByMetadata):
    """One copula for the table. With its spec, keys, ids and personal data are made anew and never modelled."""

    name, modality = "GaussianCopulaSynthesizer", "single_table"

    def __init__(self, seed: int | str = 0):
        self.seed = seed

    def _fit(self, data: DataFrame) -> CopulaModel:
        return _fit(spread(data).withColumn("_segment", F.lit(0)), data.schema)

    def _rows(self, model: CopulaModel, ids: DataFrame) -> DataFrame:
        return sample_copula(model, ids, self.seed)


class BootstrapSynthesizer(GaussianCopulaSynthesizer):
    """A copula fitted to rows drawn with replacement."""

    name = "BootstrapSynthesizer"

    def _fit(self, data: DataFrame) -> CopulaModel:
        rows = bootstrap_rows(data, data.columns, data.count(), self.seed).drop("id")
        return super()._fit(materialize(rows.select(*data.columns)))


class SegmentSynthesizer(GaussianCopulaSynthesizer):
    """K-means segments, each with its own copula, fitted and sampled together."""

    name = "SegmentSynthesizer"

    def __init__(self, seed: int | str = 0, segments: int = 4):
        super().__init__(seed)
        self.segments = segments

    def _fit(self, data: DataFrame) -> CopulaModel:
        schema = data.schema
        numbers = [c for c in schema.fieldNames() if c not in objects(schema)]
        if not numbers:
            return super()._fit(data)
        means = data.agg(*[F.avg(as_number(schema, c)).alias(c) for c in numbers]).first()
        filled = data.withColumns({
            f"_x_{c}": F.coalesce(as_number(schema, c).cast("double"), F.lit(float(means[c] or 0.0))) for c in numbers
        })
        packed = VectorAssembler(inputCols=[f"_x_{c}" for c in numbers], outputCol="_raw").transform(filled)
        scaled = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True).fit(packed).transform(packed)
        points = KMeans(k=self.segments, seed=17, featuresCol="_scaled", predictionCol="_segment", maxIter=10)
        marked = points.fit(scaled.select("_scaled")).transform(scaled).select(*data.columns, "_segment")
        return _fit(materialize(marked), schema)
