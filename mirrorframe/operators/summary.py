"""Tables over processed results: run-to-run pivot, plot data, the coverage report and error pivots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions import scalar as S
from mirrorframe.operators import results as R
from mirrorframe.operators.prefix import Running, numbered, running
from mirrorframe.session import materialize

# Plot markers in the order they are handed out, the curve's padding and its colours.
MARKERS = [
    "circle", "square", "diamond", "cross", "x", "triangle-up", "triangle-down", "triangle-left",
    "triangle-right", "pentagon", "hexagon", "hexagon2", "octagon", "star", "hexagram",
    "star-triangle-up", "star-triangle-down", "star-square", "star-diamond", "diamond-tall",
    "diamond-wide", "hourglass", "bowtie", "circle-cross", "circle-x", "square-cross", "square-x",
    "diamond-cross", "diamond-x",
]
PLOT_PADDING = 0.25
FRONTIER_COLOR = "#01E0C9"
OTHER_COLOR = "#03AFF1"
IDENTITY_MODEL = "DataIdentity"


# --- runs -------------------------------------------------------------------------------------------

def runs_not_later(runs: DataFrame, folder: str, column: str = "folder") -> DataFrame:
    """Runs dated no later than `folder`; folders without a date are left out."""
    chosen = S.run_date(F.lit(folder))
    return runs.where(S.run_date(F.col(column)) <= chosen)


def latest_run(runs: DataFrame, column: str = "folder") -> DataFrame:
    date = S.run_date(F.col(column))
    return runs.where(date.isNotNull()).agg(F.max_by(column, F.struct(date, F.col(column))).alias("latest_folder"))


def runs_complete(metainfo: DataFrame) -> DataFrame:
    """True only if there are runs and every one carries a completion date."""
    done = F.coalesce(F.bool_and(F.col("completed_date").isNotNull()), F.lit(False))
    return metainfo.agg(((F.count(F.lit(1)) > 0) & done).alias("all_complete"))


def run_headers(judged: DataFrame, versions: DataFrame, baseline: str = R.DEFAULT_BASELINE) -> DataFrame:
    """`run`, its date and the column header of the summary; a run without metainfo has no version."""
    counts = R.datasets_in_run(judged, baseline, by=["run"])
    date = S.run_date(F.col("run"))
    header = F.concat(
        F.date_format(date, "MM_dd_yyyy"), F.lit(" - # datasets: "), F.col("Num_Datasets").cast("string"),
        F.lit(" - version: "), F.coalesce("version", F.lit("None")),
    )
    return counts.join(versions, "run", "left").select("run", date.alias("date"), header.alias("header"))


def summary_pivot(judged: DataFrame, versions: DataFrame, baseline: str = R.DEFAULT_BASELINE) -> DataFrame:
    """Wins per synthesizer of the newest run (rows) and run (columns, newest first); `-` where missing."""
    headers = run_headers(judged, versions, baseline)
    # One short header per run.
    listed = [r["header"] for r in headers.orderBy(F.desc("date")).select("header").collect()]
    won = R.wins_per_synthesizer(judged, by=["run"]).join(headers, "run")
    newest = F.max_by("run", "date")
    rows = won.where(F.col("run") == headers.agg(newest).scalar()).select("Synthesizer").distinct()
    table = won.groupBy("Synthesizer").pivot("header", listed).agg(F.sum("Wins"))
    return table.join(rows, "Synthesizer", "left_semi").select(
        "Synthesizer", *[F.coalesce(F.col(f"`{h}`").cast("string"), F.lit("-")).alias(h) for h in listed]
    )


def summarize_runs(
    results: DataFrame, versions: DataFrame, folder: str, order: R.Order, baseline: str = R.DEFAULT_BASELINE
) -> tuple[DataFrame, DataFrame]:
    """(summary over all runs up to `folder`, detailed rows of `folder`) in one plan over all runs."""
    rows = runs_not_later(results, folder, "run")
    judged = materialize(R.wins(R.process_results(rows, order, by=["run"], require=True), order, baseline, by=["run"]))
    without = rows.select("run").distinct().join(judged.select("run").distinct(), "run", "left_anti")
    names = sorted(r["run"] for r in without.collect())  # one row per run
    if names:
        raise ValueError(f"Runs without a dataset that every synthesizer finished: {', '.join(names)}")
    detail = judged.where(F.col("run") == folder)
    fallback = detail.agg(F.max("Fallback_Quality"), F.max("Fallback_Time")).first()
    dropped = [c for c, used in zip(("Adjusted_Quality_Score", "Adjusted_Total_Time"), fallback, strict=True) if used]
    marks = ["Fallback_Quality", "Fallback_Time"]
    return summary_pivot(judged, versions, baseline), detail.drop(*dropped, *marks)


# --- plot data --------------------------------------------------------------------------------------

def aggregated_time(results: DataFrame) -> DataFrame:
    """Total time and mean quality per synthesizer."""
    return results.groupBy("Synthesizer").agg(
        F.coalesce(F.sum("Adjusted_Total_Time"), F.lit(0.0)).alias("Aggregated_Time"),
        F.avg("Adjusted_Quality_Score").alias("Quality_Score"),
    ).withColumn("Log10_Aggregated_Time", S.safe_log10(F.col("Aggregated_Time")))


def _speed_order():
    return [F.asc("Aggregated_Time"), F.desc_nulls_last("Quality_Score"), F.asc("Synthesizer")]


def pareto_models(models: DataFrame) -> DataFrame:
    """`Pareto`: quality equals the best quality so far, going from fast to slow."""
    ranked = running(models, [], _speed_order(), [Running("_best", "max", "Quality_Score")])
    return ranked.withColumn("Pareto", F.coalesce(F.col("Quality_Score") == F.col("_best"), F.lit(False))).drop("_best")


def with_markers(models: DataFrame) -> DataFrame:
    """Markers handed out in order of time, starting over after the last."""
    position = numbered(models, [], _speed_order(), "_position")
    marker = F.element_at(F.array(*[F.lit(m) for m in MARKERS]), (F.col("_position") % len(MARKERS) + 1).cast("int"))
    return position.withColumn("Marker", marker).drop("_position")


def curve_ends(plotted: DataFrame) -> DataFrame:
    """Both ends of the frontier, extended by the padding in log time; nothing below two points."""
    frontier = plotted.where("Pareto").groupBy(F.col("Log10_Aggregated_Time").alias("x")).agg(
        F.max("Quality_Score").alias("y")
    )
    point = F.struct("x", "y")
    first = frontier.orderBy("x").limit(2).agg(F.min(point).alias("a"), F.max(point).alias("b"), F.count("x").alias("n"))
    last = frontier.orderBy(F.desc("x")).limit(2).agg(F.min(point).alias("a"), F.max(point).alias("b"), F.count("x").alias("n"))
    x = F.col("x")
    line = F.col("a.y") + (x - F.col("a.x")) * (F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))
    ends = first.where("n = 2").withColumn(
        "x", F.log10(plotted.agg(F.min("Aggregated_Time")).scalar()) - PLOT_PADDING
    ).unionByName(last.where("n = 2").withColumn(
        "x", F.log10(plotted.agg(F.max("Aggregated_Time")).scalar()) + PLOT_PADDING
    ))
    return ends.select(
        F.lit(None).cast("string").alias("Synthesizer"),
        F.pow(F.lit(10.0), x).alias("Aggregated_Time"),
        line.alias("Quality_Score"),
        x.alias("Log10_Aggregated_Time"),
        F.lit(True).alias("Pareto"),
        F.lit(FRONTIER_COLOR).alias("Color"),
        F.lit(None).cast("string").alias("Marker"),
    )


def plot_data(results: DataFrame) -> DataFrame:
    """Per-model points with frontier, colour and marker, plus the two curve ends."""
    models = pareto_models(aggregated_time(results))
    points = (
        with_markers(models)
        .withColumn("Color", F.when(F.col("Pareto"), FRONTIER_COLOR).otherwise(OTHER_COLOR))
        .withColumn("Synthesizer", S.short_name(F.col("Synthesizer")))
        .select("Synthesizer", "Aggregated_Time", "Quality_Score", "Log10_Aggregated_Time", "Pareto", "Color", "Marker")
    )
    return points.unionByName(curve_ends(points))


# --- coverage report --------------------------------------------------------------------------------

def mean_per_pair(results: DataFrame) -> DataFrame:
    """Repeats of a (dataset, synthesizer) pair averaged; its error is the least error text."""
    return results.groupBy("Dataset", "Synthesizer").agg(
        F.avg("Quality_Score").alias("Quality_Score"),
        F.avg("Train_Time").alias("Train_Time"),
        F.min("Error").alias("Error"),
    )


def coverage(pairs: DataFrame) -> DataFrame:
    total = pairs.agg(F.count_distinct("Dataset").alias("total")).scalar()
    return (
        pairs.groupBy("Synthesizer").agg(F.count("Quality_Score").alias("solved"))
        .withColumn("total", total)
        .withColumn("coverage_perc", F.col("solved") / F.col("total"))
        .withColumn("coverage", S.coverage_text(F.col("solved"), F.col("total")))
    )


def mean_score(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("Synthesizer").agg(F.avg("Quality_Score").alias("avg_score"))


def mean_seconds(pairs: DataFrame) -> DataFrame:
    """Mean train time rounded half to even."""
    return pairs.groupBy("Synthesizer").agg(F.bround(F.avg("Train_Time"), 0).alias("time"))


def rank_counts(pairs: DataFrame, field: str, ascending: bool, names: Sequence[str]) -> DataFrame:
    """How often each synthesizer has the best, second best, ... value of `field` in a dataset.

    Equal values share a rank. The ranked values are found by repeated aggregation, so no dataset is
    sorted in one task.
    """
    pick, beyond = (F.min, F.col(field) > F.col("_cut")) if ascending else (F.max, F.col(field) < F.col("_cut"))
    # Each rank reads what is left of the one before: the values are written once.
    known = materialize(pairs.where(F.col(field).isNotNull()).select("Dataset", "Synthesizer", field))
    values = known.select("Dataset", field).distinct()
    ranked, left = None, values
    for rank in range(1, len(names) + 1):
        cut = left.groupBy("Dataset").agg(pick(field).alias("_cut"))
        level = cut.select("Dataset", F.col("_cut").alias(field), F.lit(rank).alias("_rank"))
        ranked = level if ranked is None else ranked.unionByName(level)
        left = left.join(cut, "Dataset").where(beyond).drop("_cut")
    scored = known.join(ranked, ["Dataset", field])
    everyone = pairs.select("Synthesizer").distinct()
    counts = scored.groupBy("Synthesizer").agg(
        *[F.count_if(F.col("_rank") == i).alias(n) for i, n in enumerate(names, 1)]
    )
    return everyone.join(counts, "Synthesizer", "left").fillna(0, list(names))


def beat_baseline(pairs: DataFrame, baseline_pairs: DataFrame, output: str) -> DataFrame:
    """Datasets of the baseline where a synthesizer scores at least as well; a missing score is minus infinity.

    A dataset without a baseline score is beaten by everyone, run or not, so it is counted once for all.
    """
    base = baseline_pairs.select("Dataset", F.col("Quality_Score").alias("_base"))
    free = base.agg(F.count_if(F.col("_base").isNull())).scalar()
    matched = pairs.join(base.where(F.col("_base").isNotNull()), "Dataset", "left")
    return matched.groupBy("Synthesizer").agg(
        F.count_if(F.col("Quality_Score") >= F.col("_base")).alias("_met")
    ).select("Synthesizer", (F.col("_met") + free).alias(output))


def coverage_report(
    results: DataFrame, baselines: Sequence[str] = (), datasets: Sequence[str] | None = None
) -> DataFrame:
    """Per synthesizer: coverage, time, ranks, baselines beaten and error counts."""
    if datasets is not None:
        results = results.where(F.col("Dataset").isin(list(datasets)))
    pairs = materialize(mean_per_pair(results))
    of_baselines = pairs.where(F.col("Synthesizer").isin(list(baselines)))
    rest = pairs.where(~F.col("Synthesizer").isin(list(baselines)))
    ranked = rest.where(F.col("Synthesizer") != IDENTITY_MODEL)

    best = rank_counts(ranked, "Quality_Score", False, ["best"])
    fast = rank_counts(ranked, "Train_Time", True, ["best_time", "second_best_time", "third_best_time"])
    table = coverage(rest).join(mean_seconds(rest), "Synthesizer").join(mean_score(rest), "Synthesizer")
    table = table.join(best, "Synthesizer", "left").join(fast, "Synthesizer", "left")
    for name in baselines:
        beaten = beat_baseline(rest, of_baselines.where(F.col("Synthesizer") == name), f"beat_{name.lower()}")
        table = table.join(beaten, "Synthesizer", "left")
    errors = rest.groupBy("Synthesizer").agg(
        *[F.count_if(S.known_error(F.col("Error"), m)).alias(n) for n, m in S.KNOWN_ERRORS.items()],
        F.count(S.unknown_error(F.col("Error"))).alias("errors"),
    )
    return table.join(errors, "Synthesizer").withColumn(
        "metric_errors", F.col("total") - F.col("solved") - F.col("errors")
    )


def errors_pivot(results: DataFrame, synthesizers: Sequence[str] | None = None) -> DataFrame:
    """Error texts by synthesizer, with a total, most frequent first."""
    failed = results.where(S.unknown_error(F.col("Error")).isNotNull())
    if synthesizers is None:
        synthesizers = sorted(r[0] for r in failed.select("Synthesizer").distinct().collect())
    table = failed.groupBy("Error").pivot("Synthesizer", list(synthesizers)).agg(F.count(F.lit(1)))
    totals = failed.groupBy("Error").agg(F.count(F.lit(1)).alias("all"))
    return totals.join(table, "Error").fillna(0).orderBy(F.desc("all"), "Error")
