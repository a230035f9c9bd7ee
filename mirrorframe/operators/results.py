"""Benchmark result rows: adjusted scores, duplicates, Pareto frontiers and wins.

`by` names extra grouping columns (such as a run), so many runs are processed in one plan. All "first
row" rules take an explicit `order`, since rows of a DataFrame have none.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions import scalar as S
from mirrorframe.operators.prefix import Running, running
from mirrorframe.session import materialize

# Fixed values.
DEFAULT_TIMEOUT = 345600.0
DEFAULT_BASELINE = "GaussianCopulaSynthesizer"
SUMMARY_COLUMNS = ["Dataset", "Synthesizer", "Adjusted_Total_Time", "Adjusted_Quality_Score", "Diagnostic_Score"]

Order = Sequence[str]


def attach(df: DataFrame, by: Sequence[str], **aggregates: Column) -> DataFrame:
    """Add per-`by` aggregates of `df` to its rows; scalar subqueries where there is no grouping."""
    if by:
        totals = df.groupBy(*by).agg(*[a.alias(n) for n, a in aggregates.items()])
        return df.join(totals, list(by))
    return df.withColumns({n: df.agg(a.alias(n)).scalar() for n, a in aggregates.items()})


def keep_best(results: DataFrame, order: Order, by: Sequence[str] = ()) -> DataFrame:
    """One row per (dataset, synthesizer): the first in `order`, a failed uniform row only as a last resort."""
    failed = S.is_uniform(F.col("Synthesizer")) & F.col("Error").isNotNull()
    rank = F.struct(failed.cast("int").alias("failed"), *order)
    best = results.groupBy(*by, "Dataset", "Synthesizer").agg(
        F.min_by(F.struct(*results.columns), rank).alias("row")
    )
    return best.select("row.*")


def adjusted_scores(
    results: DataFrame, order: Order, timeout: float | None = DEFAULT_TIMEOUT, by: Sequence[str] = ()
) -> DataFrame:
    """Charge failures with the uniform baseline's time and quality, per dataset."""
    rank = F.struct(*order)
    base = (
        results.where(S.is_uniform(F.col("Synthesizer")))
        .groupBy(*by, "Dataset")
        .agg(F.min_by(F.struct("Train_Time", "Sample_Time", "Quality_Score"), rank).alias("b"))
        .select(*by, "Dataset", F.col("b.Train_Time").alias("_fit"), F.col("b.Sample_Time").alias("_sample"),
                F.col("b.Quality_Score").alias("_quality"))
    )
    usable = F.col("_fit").isNotNull() & F.col("_sample").isNotNull()
    own = F.coalesce("Train_Time", F.lit(0.0)) + F.coalesce("Sample_Time", F.lit(0.0))
    error = F.col("Error")
    total = (
        F.when(error == S.TIMEOUT_ERROR, F.col("_fit") + F.lit(float(timeout or 0)) + F.col("_sample"))
        .when(error.isNotNull(), F.col("_fit") + own + F.col("_sample"))
        .otherwise(F.col("_fit") + own)
    )
    quality = F.when(error.isNotNull(), F.col("_quality")).otherwise(F.col("Quality_Score"))
    return (
        results.drop("Adjusted_Total_Time", "Adjusted_Quality_Score")
        .join(base, [*by, "Dataset"], "left")
        .withColumn("Adjusted_Total_Time", F.when(usable, total))
        .withColumn("Adjusted_Quality_Score", F.when(usable & F.col("_quality").isNotNull(), quality))
        .drop("_fit", "_sample", "_quality")
    )


def uniform_times(results: DataFrame, order: Order, by: Sequence[str] = ()) -> DataFrame:
    """Each row with the fit and sample time of its dataset's uniform row."""
    base = (
        results.where(S.is_uniform(F.col("Synthesizer")))
        .groupBy(*by, "Dataset")
        .agg(F.min_by(F.struct("Train_Time", "Sample_Time"), F.struct(*order)).alias("b"))
        .select(*by, "Dataset", F.col("b.Train_Time").alias("Uniform_Train_Time"),
                F.col("b.Sample_Time").alias("Uniform_Sample_Time"))
    )
    return results.join(base, [*by, "Dataset"], "left")


def complete_datasets(results: DataFrame, by: Sequence[str] = (), require: bool = False) -> DataFrame:
    """Rows of the datasets that every synthesizer has run."""
    pairs = results.select(*by, "Dataset", "Synthesizer").distinct()
    per_dataset = pairs.groupBy(*by, "Dataset").agg(F.count(F.lit(1)).alias("n"))
    if by:
        expected = results.groupBy(*by).agg(F.count_distinct("Synthesizer").alias("expected"))
        full = per_dataset.join(expected, list(by)).where("n = expected")
    else:
        full = per_dataset.where(F.col("n") == results.agg(F.count_distinct("Synthesizer")).scalar())
    kept = results.join(full, [*by, "Dataset"], "left_semi")
    if require and kept.isEmpty():
        raise ValueError("No dataset has been run by every synthesizer; there is nothing to summarize.")
    return kept


def fill_missing_adjusted(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Older runs: an adjusted column that is null throughout falls back to the raw scores."""
    marked = attach(
        results, by,
        _q=F.count("Adjusted_Quality_Score"),
        _t=F.count("Adjusted_Total_Time"),
    )
    return (
        marked.withColumn("Fallback_Quality", F.col("_q") == 0)
        .withColumn("Fallback_Time", F.col("_t") == 0)
        .withColumn(
            "Adjusted_Quality_Score",
            F.when(F.col("Fallback_Quality"), F.col("Quality_Score")).otherwise(F.col("Adjusted_Quality_Score")))
        .withColumn(
            "Adjusted_Total_Time",
            F.when(F.col("Fallback_Time"), F.col("Train_Time") + F.col("Sample_Time"))
            .otherwise(F.col("Adjusted_Total_Time")))
        .drop("_q", "_t")
    )


def process_results(
    results: DataFrame, order: Order, by: Sequence[str] = (), timeout: float = DEFAULT_TIMEOUT, require: bool = False
) -> DataFrame:
    """Plain names, best duplicates, adjusted scores, fallbacks, complete datasets only."""
    if "Error" not in results.columns:
        results = results.withColumn("Error", F.lit(None).cast("string"))
    named = S.clean_nans(results).withColumn("Synthesizer", S.plain_name(F.col("Synthesizer")))
    # Every later step joins the rows with aggregates of themselves: read the input once.
    best = materialize(keep_best(named, order, by))
    scored = materialize(fill_missing_adjusted(adjusted_scores(best, order, timeout, by), by))
    return complete_datasets(scored, by, require)


def pareto_per_dataset(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """`On_Pareto_Frontier`: no row of the dataset is strictly better in both quality and time.

    Equals "the best quality among strictly faster rows does not exceed mine"; a row without quality or
    time neither dominates nor is dominated.
    """
    keys = [*by, "Dataset"]
    known = results.where(F.col("Adjusted_Quality_Score").isNotNull() & F.col("Adjusted_Total_Time").isNotNull())
    steps = known.groupBy(*keys, "Adjusted_Total_Time").agg(F.max("Adjusted_Quality_Score").alias("_top"))
    faster = running(
        steps, keys, [F.col("Adjusted_Total_Time")], [Running("_faster_top", "max", "_top", inclusive=False)]
    ).drop("_top")
    dominated = F.col("_faster_top") > F.col("Adjusted_Quality_Score")
    return (
        results.join(faster, [*keys, "Adjusted_Total_Time"], "left")
        .withColumn("On_Pareto_Frontier", ~F.coalesce(dominated, F.lit(False)))
        .drop("_faster_top")
    )


def meets_baseline(
    results: DataFrame, order: Order, baseline: str = DEFAULT_BASELINE, by: Sequence[str] = ()
) -> DataFrame:
    """`Meets_Baseline_Quality` against the baseline's first row of the dataset; missing is false."""
    base = (
        results.where(F.col("Synthesizer") == baseline)
        .groupBy(*by, "Dataset")
        .agg(F.min_by(F.struct("Adjusted_Quality_Score"), F.struct(*order)).alias("b"))
        .select(*by, "Dataset", F.col("b.Adjusted_Quality_Score").alias("Baseline_Quality_Score"))
    )
    test = F.col("Adjusted_Quality_Score") >= F.col("Baseline_Quality_Score")
    return results.join(base, [*by, "Dataset"], "left").withColumn(
        "Meets_Baseline_Quality", F.coalesce(test, F.lit(False))
    )


def wins(results: DataFrame, order: Order, baseline: str = DEFAULT_BASELINE, by: Sequence[str] = ()) -> DataFrame:
    """`Win` is 1 for rows on the frontier that also meet the baseline's quality."""
    judged = pareto_per_dataset(meets_baseline(results, order, baseline, by), by)
    return judged.withColumn(
        "Win", (F.col("Meets_Baseline_Quality") & F.col("On_Pareto_Frontier")).cast("int")
    ).drop("Meets_Baseline_Quality", "On_Pareto_Frontier", "Baseline_Quality_Score")


def wins_per_synthesizer(judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return judged.groupBy(*by, "Synthesizer").agg(F.sum("Win").cast("bigint").alias("Wins"))


def filter_results(
    results: DataFrame,
    dataset_names: Sequence[str] | None = None,
    synthesizer_names: Sequence[str] | None = None,
    summary: bool = False,
    warn: bool = False,
) -> DataFrame:
    """Restrict loaded results; with `summary`, to the summary columns."""
    for names, label in ((dataset_names, "dataset_names"), (synthesizer_names, "synthesizer_names")):
        if names is not None and not (isinstance(names, (list, tuple)) and all(isinstance(n, str) for n in names)):
            raise ValueError(f"`{label}` must be a list of strings or None.")
    if not isinstance(summary, bool):
        raise ValueError("`summary` must be a boolean.")
    if dataset_names is not None:
        results = results.where(F.col("Dataset").isin(list(dataset_names)))
    if synthesizer_names is not None:
        results = results.where(F.col("Synthesizer").isin(list(synthesizer_names)))
    if warn and results.isEmpty():
        warnings.warn("No results match the given datasets and synthesizers.", stacklevel=2)
    return results.select(*SUMMARY_COLUMNS) if summary else results


def evaluate_time(parts: Sequence[Column]) -> Column:
    """Sum of the stage times that are present; null when none is."""
    total = F.lit(0.0)
    for part in parts:
        total = total + F.coalesce(S.no_nan(part.cast("double")), F.lit(0.0))
    any_present = F.lit(False)
    for part in parts:
        any_present = any_present | part.isNotNull()
    return F.when(any_present, total)


def best_model(results: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Highest adjusted quality per dataset; ties go to the greater name."""
    scored = results.where(F.col("Adjusted_Quality_Score").isNotNull())
    return scored.groupBy(*by, "Dataset").agg(
        F.max_by("Synthesizer", F.struct("Adjusted_Quality_Score", "Synthesizer")).alias("Best_Model")
    )


def error_counts(results: DataFrame) -> DataFrame:
    """Datasets per synthesizer that timed out, and that failed in another way."""
    timed_out = F.col("Error") == S.TIMEOUT_ERROR
    return results.groupBy("Synthesizer").agg(
        F.count_distinct(F.when(timed_out, F.col("Dataset"))).alias("Timeouts"),
        F.count_distinct(F.when(~timed_out, F.col("Dataset"))).alias("Errors"),
    )


def datasets_in_run(results: DataFrame, baseline: str = DEFAULT_BASELINE, by: Sequence[str] = ()) -> DataFrame:
    """Distinct datasets the baseline has run, or all where it did not run."""
    of_baseline = F.count_distinct(F.when(F.col("Synthesizer") == baseline, F.col("Dataset")))
    return results.groupBy(*by).agg(
        F.when(of_baseline > 0, of_baseline).otherwise(F.count_distinct("Dataset")).alias("Num_Datasets")
    )


def leaderboard(results: DataFrame, fields: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    return results.groupBy(*fields).agg(*[F.avg(c).alias(c) for c in numbers])


def sort_table(df: DataFrame, fields: Sequence[str], reverse: bool = False) -> DataFrame:
    return df.orderBy(*[F.col(f).desc() if reverse else F.col(f).asc() for f in fields])
