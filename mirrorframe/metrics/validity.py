"""Validity of synthetic data: bounds, categories, keys, references, structure and new rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions import random as rnd
from mirrorframe.functions import scalar as S
from mirrorframe.metrics import tolerance as tolerant
from mirrorframe.metrics.pairs import numeric_bounds
from mirrorframe.metrics.shapes import ks_of_counts, paired_counts, share
from mirrorframe.session import materialize
from mirrorframe.synth.simple import as_number
from mirrorframe.synth.tables import children_per_parent


def boundary_adherence(
    real: DataFrame, synthetic: DataFrame, columns: list[str], bounds: dict[str, tuple[float, float]] | None = None
) -> DataFrame:
    """Share of the non-null synthetic values inside the real [min, max]; one scan of each side."""
    bounds = bounds or numeric_bounds(real, columns)

    def inside(c):
        low, high = bounds[c]
        value = S.no_nan(as_number(synthetic.schema, c).cast("double"))
        test = value.between(low, high) if low is not None else F.lit(False)
        return F.avg(F.when(value.isNotNull(), test.cast("double")))

    scores = F.array(*[F.struct(F.lit(c).alias("column"), inside(c).alias("score")) for c in columns])
    return synthetic.agg(scores.alias("all")).select(F.explode("all").alias("s")).select("s.*")


def category_adherence(real: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """Share of the non-null synthetic values that occur in the real column."""
    counts = paired_counts(real, synthetic, columns, numeric=False)
    seen = F.sum(F.when(F.col("n_real") > 0, F.col("n_synthetic")).otherwise(0))
    return counts.groupBy("column").agg(share(seen, F.sum("n_synthetic")).alias("score"))


def key_uniqueness(synthetic: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys as a share of the rows."""
    return synthetic.agg(
        F.lit(key).alias("column"),
        share(F.count_distinct(key), F.count(F.lit(1))).alias("score"),
    )


def referential_integrity(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Share of the child rows whose key has a parent. Children are counted per key before the join."""
    counts = child.groupBy(F.col(child_key).alias("_k")).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(F.col(parent_key).alias("_k"), F.lit(1).alias("_found")).distinct()
    found = F.sum(F.when(F.col("_found") == 1, F.col("n")).otherwise(0))
    return counts.join(keys, "_k", "left").agg(
        F.lit(child_key).alias("column"), share(found, F.sum("n")).alias("score")
    )


def structure(real: DataFrame, synthetic: DataFrame) -> float:
    """Overlap of the (column, type) sets of both tables."""
    a, b = set(real.dtypes), set(synthetic.dtypes)
    return len(a & b) / len(a | b) if a | b else 1.0


def structure_overlap(real: DataFrame, synthetic: DataFrame) -> DataFrame:
    """`structure` for whole catalogs: per dataset, shared over all (table, column, type) entries."""
    key = ["dataset", "table_name", "column_name", "sdtype"]
    sides = real.select(*key, F.lit(1).alias("side")).unionByName(synthetic.select(*key, F.lit(2).alias("side")))
    entries = sides.groupBy(*key).agg(F.count_distinct("side").alias("sides"))
    return entries.groupBy("dataset").agg(share(F.count_if(F.col("sides") == 2), F.count(F.lit(1))).alias("score"))


def cardinality_shape(
    real: tuple[DataFrame, DataFrame], synthetic: tuple[DataFrame, DataFrame], parent_key: str, child_key: str
) -> DataFrame:
    """KS complement of children per parent; each side is (parent, child). Childless parents count as 0."""
    return ks_of_counts(cardinality_counts(real, synthetic, parent_key, child_key))


def cardinality_counts(
    real: tuple[DataFrame, DataFrame], synthetic: tuple[DataFrame, DataFrame], parent_key: str, child_key: str,
    prefix: str = "",
) -> DataFrame:
    """Parents per number of children on both sides, in the form of `paired_counts`."""
    def counted(side, parent, child):
        n = children_per_parent(parent, parent_key, child, child_key)
        return n.groupBy(F.col("n").cast("double").alias("value")).agg(F.count(F.lit(1)).alias("k")).withColumn("side", F.lit(side))

    both = counted("real", *real).unionByName(counted("synthetic", *synthetic))
    return both.groupBy(F.lit(prefix + child_key).alias("column"), "value").agg(
        F.sum(F.when(F.col("side") == "real", F.col("k")).otherwise(0)).alias("n_real"),
        F.sum(F.when(F.col("side") == "synthetic", F.col("k")).otherwise(0)).alias("n_synthetic"),
    )


def new_row_synthesis(
    real: DataFrame,
    synthetic: DataFrame,
    texts: list[str],
    numbers: list[str],
    tolerance: float = 0.01,
    sample_share: float | None = None,
    seed: int = 0,
) -> DataFrame:
    """Share of synthetic rows without a real match.

    Rows match when their texts are equal and no number differs by more than `tolerance` of its real range; a missing
    value matches a missing one. Both sides are reduced to distinct rows first, so repeated rows meet once.
    `sample_share` restricts the test to a hashed share of the synthetic rows.
    """
    bounds = numeric_bounds(real, numbers)
    if sample_share is not None:
        row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in [*texts, *numbers]])
        synthetic = synthetic.where(rnd.uniform(seed, "new-row", row) < sample_share)
    close = [bounds[c] for c in numbers if tolerance > 0 and tolerant.wide(bounds[c])]
    spread = bounds if tolerance > 0 else {c: (None, None) for c in numbers}
    made, known = (materialize(tolerant.points(df, texts, numbers, spread)) for df in (synthetic, real))
    hits = tolerant.matched_counts(made, known, [low for low, _ in close], [(high - low) * tolerance for low, high in close])
    sides = made.select("n", F.lit(0).cast("bigint").alias("hit")).unionByName(hits.select(F.lit(0).cast("bigint").alias("n"), F.col("n").alias("hit")))
    return sides.agg(share(F.sum(F.col("n") - F.col("hit")), F.sum("n")).alias("score"))
