"""Likelihood of synthetic rows under models of the real data."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirrorframe.functions import mixtures
from mirrorframe.functions import scalar as S
from mirrorframe.metrics.pairs import discretized, mutual_information, numeric_bounds
from mirrorframe.synth.simple import as_number


def gm_scores(
    real: DataFrame, synthetic: DataFrame, numbers: list[str], sizes: Sequence[int] = (10, 30), iterations: int = 10, max_iter: int = 20,
) -> DataFrame:
    """(components, seed, num_rows, score, mean_score): mean log-likelihood of synthetic rows under Gaussian mixtures of the real ones.

    There is a row per number of components and seed, and `mean_score` is the mean over the seeds. All mixtures are fitted
    together. Columns are scaled by their real deviation first, and the scale is taken back out of the density; columns
    that do not vary are left out. A missing number counts as the real mean, so no row is left out.
    """
    number = lambda df, c: S.no_nan(as_number(df.schema, c).cast("double"))
    stats = real.agg(*[e for c in numbers for e in (F.avg(number(real, c)).alias(f"{c}|m"), F.stddev_pop(number(real, c)).alias(f"{c}|s"))]).first()
    used = [c for c in numbers if stats[f"{c}|s"]]
    if not used:
        raise ValueError("No number of the real rows varies.")

    def scaled(df):
        return [F.coalesce((number(df, c) - stats[f"{c}|m"]) / stats[f"{c}|s"], F.lit(0.0)) for c in used]

    wanted = [mixtures.Wanted(0, k, seed) for k in sizes for seed in range(iterations)]
    fitted = mixtures.fit(mixtures.points(real, [scaled(real)]), wanted, max_iter)
    totals = mixtures.log_likelihoods(mixtures.each_point(synthetic, [scaled(synthetic)]), wanted, fitted)
    jacobian = float(sum(np.log(stats[f"{c}|s"]) for c in used))
    names = [(i, w.components, w.seed) for i, w in enumerate(wanted)]
    named = real.sparkSession.createDataFrame(names, "mixture int, components int, seed int").join(totals, "mixture", "left")
    scored = named.withColumn("score", F.try_divide("total", "rows") - jacobian)
    alike = Window.partitionBy("components")  # as many rows as seeds
    return scored.select(
        "components", "seed", F.coalesce("rows", F.lit(0).cast("long")).alias("num_rows"), "score", F.avg("score").over(alike).alias("mean_score")
    )


def gm_log_likelihood(
    real: DataFrame, synthetic: DataFrame, numbers: list[str], components: int = 10, iterations: int = 10, max_iter: int = 20,
) -> list[float]:
    """The scores of `gm_scores` for one number of components, by seed."""
    return [r["score"] for r in gm_scores(real, synthetic, numbers, (components,), iterations, max_iter).orderBy("seed").collect()]


def dependency_tree(real: DataFrame, texts: list[str], numbers: list[str] = ()) -> list[tuple[str | None, str]]:
    """Chow-Liu tree as (parent, column) pairs, root first: the maximum spanning tree of mutual information.

    What is collected is one number per pair of columns.
    """
    columns = [*texts, *numbers]
    if len(columns) == 1:
        return [(None, columns[0])]
    weight = {}
    for r in mutual_information(real, texts, list(numbers)).collect():
        weight[r["column_a"], r["column_b"]] = weight[r["column_b"], r["column_a"]] = r["mutual_information"]
    tree, inside = [(None, columns[0])], {columns[0]}
    while len(inside) < len(columns):
        _, parent, child = max((weight[a, b], a, b) for a in inside for b in columns if b not in inside)
        tree.append((parent, child))
        inside.add(child)
    return tree


def bn_log_likelihood(
    real: DataFrame, synthetic: DataFrame, texts: list[str], numbers: list[str] = (), smoothing: float = 1.0
) -> DataFrame:
    """Mean log-likelihood of synthetic rows under the real data's dependency tree.

    Both sides are counted per (edge, parent value, value); only those counts are joined. Conditional
    probabilities are smoothed by `smoothing` per value of the column.
    """
    tree = dependency_tree(real, texts, numbers)
    bounds = numeric_bounds(real, list(numbers))

    def edges(df):
        table = discretized(df, texts, bounds)
        return table.select(F.explode(F.array(*[
            F.struct(F.lit(child).alias("child"),
                     F.coalesce(F.col(parent) if parent else F.lit(None).cast("string"), F.lit("\0")).alias("given"),
                     F.coalesce(F.col(child), F.lit("\0")).alias("value"))
            for parent, child in tree
        ])).alias("e")).select("e.*").groupBy("child", "given", "value").agg(F.count(F.lit(1)).alias("n"))

    known = edges(real)
    given = known.groupBy("child", "given").agg(F.sum("n").alias("n_given"))
    width = known.select("child", "value").distinct().groupBy("child").agg(F.count(F.lit(1)).alias("width"))
    seen = edges(synthetic).withColumnRenamed("n", "n_synthetic")
    joined = seen.join(known, ["child", "given", "value"], "left").join(given, ["child", "given"], "left").join(width, "child")
    p = (F.coalesce("n", F.lit(0)) + smoothing) / (F.coalesce("n_given", F.lit(0)) + smoothing * (F.col("width") + 1))
    # Every row contributes one term per column.
    rows = F.sum("n_synthetic") / len(tree)
    return joined.agg((F.sum(F.col("n_synthetic") * F.log(p)) / rows).alias("score"))
