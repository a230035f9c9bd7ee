"""Registered queries over benchmark results, jobs and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.functions import scalar as S
from mirrorframe.operators import jobs as J
from mirrorframe.operators import results as R
from mirrorframe.operators import summary as Y
from mirrorframe.plans import views as V
from mirrorframe.session import materialize

ORDER = ["file_no", "row_no"]
NAMES = ["Synthesizer"]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), 6) for c in columns})


def _plain(spark, sf_dir):
    """The single-run results with plain names."""
    return V.results(spark, sf_dir).withColumn("Synthesizer", S.plain_name(F.col("Synthesizer")))


def _scored(spark, sf_dir):
    return R.adjusted_scores(_plain(spark, sf_dir), NAMES)


def _processed(spark, sf_dir, run="results_03_01_2026"):
    rows = V.result_files(spark, sf_dir).where(F.col("run") == run)
    return R.process_results(rows, ORDER)


def _all_runs(spark, sf_dir):
    return R.wins(R.process_results(V.result_files(spark, sf_dir), ORDER, by=["run"]), ORDER, by=["run"])


def wins_per_synthesizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = R.wins(R.process_results(V.results(spark, sf_dir), NAMES), NAMES)
    return R.wins_per_synthesizer(judged)


def adjusted_scores(spark, sf_dir):
    out = _scored(spark, sf_dir).select("Dataset", "Synthesizer", "Adjusted_Total_Time", "Adjusted_Quality_Score")
    return rounded(out, "Adjusted_Total_Time", "Adjusted_Quality_Score")


def uniform_times(spark, sf_dir):
    return R.uniform_times(_plain(spark, sf_dir), NAMES).select(
        "Dataset", "Synthesizer", "Train_Time", "Uniform_Train_Time", "Uniform_Sample_Time"
    )


def process_results(spark, sf_dir):
    out = _processed(spark, sf_dir).select(
        "Dataset", "Synthesizer", "Train_Time", "Sample_Time", "Error", "file_no", "row_no",
        "Adjusted_Total_Time", "Adjusted_Quality_Score",
    )
    return rounded(out, "Adjusted_Total_Time", "Adjusted_Quality_Score")


def pareto_per_dataset(spark, sf_dir):
    return R.pareto_per_dataset(_scored(spark, sf_dir)).select("Dataset", "Synthesizer", "On_Pareto_Frontier")


def meets_baseline(spark, sf_dir):
    return R.meets_baseline(_scored(spark, sf_dir), NAMES).select("Dataset", "Synthesizer", "Meets_Baseline_Quality")


def summary_pivot(spark, sf_dir):
    """The pivoted summary, read back as (synthesizer, header, wins) rows."""
    table = Y.summary_pivot(materialize(_all_runs(spark, sf_dir)), V.run_versions(spark, sf_dir))
    headers = [c for c in table.columns if c != "Synthesizer"]
    pairs = F.create_map(*[x for h in headers for x in (F.lit(h), F.col(f"`{h}`"))])
    return table.select("Synthesizer", F.explode(pairs).alias("header", "wins"))


def datasets_in_run(spark, sf_dir):
    rows = V.result_files(spark, sf_dir)
    return R.datasets_in_run(rows, by=["run"])


def runs_not_later(spark, sf_dir):
    rows = V.result_files(spark, sf_dir).groupBy("run").agg(F.count(F.lit(1)).alias("num_rows"))
    return Y.runs_not_later(rows, "results_02_01_2026", "run")


def latest_run(spark, sf_dir):
    return Y.latest_run(V.result_files(spark, sf_dir).select("run"), "run")


def runs_complete(spark, sf_dir):
    return Y.runs_complete(V.run_versions(spark, sf_dir))


def aggregated_time(spark, sf_dir):
    out = Y.aggregated_time(_scored(spark, sf_dir))
    return rounded(out, "Aggregated_Time", "Quality_Score", "Log10_Aggregated_Time")


def pareto_models(spark, sf_dir):
    return Y.pareto_models(Y.aggregated_time(_scored(spark, sf_dir))).select("Synthesizer", "Pareto")


def pareto_end_points(spark, sf_dir):
    # A short timeout spreads the models over the frontier.
    scored = R.adjusted_scores(_plain(spark, sf_dir), NAMES, timeout=20)
    models = Y.pareto_models(Y.aggregated_time(scored))
    out = Y.curve_ends(models).select("Aggregated_Time", "Quality_Score", "Log10_Aggregated_Time", "Pareto")
    return out.withColumns({
        "Aggregated_Time": F.round(F.col("Aggregated_Time"), 3),
        "Quality_Score": F.round(F.col("Quality_Score"), 6),
        "Log10_Aggregated_Time": F.round(F.col("Log10_Aggregated_Time"), 6),
    })


def markers(spark, sf_dir):
    return Y.with_markers(Y.aggregated_time(_scored(spark, sf_dir))).select("Synthesizer", "Marker")


def plot_data(spark, sf_dir):
    out = Y.plot_data(_scored(spark, sf_dir))
    return out.withColumns({
        "Aggregated_Time": F.round(F.col("Aggregated_Time"), 3),
        "Quality_Score": F.round(F.col("Quality_Score"), 6),
        "Log10_Aggregated_Time": F.round(F.col("Log10_Aggregated_Time"), 6),
    })


def load_results_filtered(spark, sf_dir):
    out = R.filter_results(_plain(spark, sf_dir), ["d1", "d2", "d5"], ["CTGANSynthesizer", "UniformSynthesizer"])
    return rounded(out, "Quality_Score", "Diagnostic_Score")


def summary_projection(spark, sf_dir):
    out = R.filter_results(_scored(spark, sf_dir), summary=True)
    return rounded(out, "Adjusted_Total_Time", "Adjusted_Quality_Score", "Diagnostic_Score")


def complete_datasets(spark, sf_dir):
    return R.complete_datasets(V.result_files(spark, sf_dir), by=["run"]).select("run", "file_no", "Dataset", "Synthesizer")


def dedup_best(spark, sf_dir):
    rows = V.result_files(spark, sf_dir).withColumn("Synthesizer", S.plain_name(F.col("Synthesizer")))
    return R.keep_best(rows, ORDER, by=["run"]).select("run", "Dataset", "Synthesizer", "file_no", "Train_Time", "Error")


def coverage(spark, sf_dir):
    pairs = Y.mean_per_pair(_with_gaps(spark, sf_dir))
    return rounded(Y.coverage(pairs), "coverage_perc")


def _with_gaps(spark, sf_dir):
    """Runs pooled, failed rows without a score, as the coverage report expects them."""
    rows = V.result_files(spark, sf_dir).withColumn("Synthesizer", S.plain_name(F.col("Synthesizer")))
    return rows.withColumn("Quality_Score", F.when(F.col("Error").isNull(), F.col("Quality_Score")))


def mean_score(spark, sf_dir):
    return rounded(Y.mean_score(Y.mean_per_pair(_with_gaps(spark, sf_dir))), "avg_score")


def mean_seconds(spark, sf_dir):
    return Y.mean_seconds(Y.mean_per_pair(_plain(spark, sf_dir)))


def best_rank_counts(spark, sf_dir):
    pairs = Y.mean_per_pair(_plain(spark, sf_dir))
    return Y.rank_counts(pairs, "Train_Time", True, ["first", "second", "third"])


def beat_baseline(spark, sf_dir):
    pairs = Y.mean_per_pair(_with_gaps(spark, sf_dir))
    base = pairs.where("Synthesizer = 'GaussianCopulaSynthesizer'")
    return Y.beat_baseline(pairs.where("Synthesizer <> 'GaussianCopulaSynthesizer'"), base, "beaten")


def legacy_summary(spark, sf_dir):
    out = Y.coverage_report(_with_gaps(spark, sf_dir), ["UniformSynthesizer"])
    return rounded(out, "coverage_perc", "avg_score")


def errors_pivot(spark, sf_dir):
    rows = V.result_files(spark, sf_dir).withColumn("Synthesizer", S.plain_name(F.col("Synthesizer")))
    # The shortened text, so that several messages share a row.
    rows = rows.withColumn("Error", F.concat(F.col("Error"), F.lit(" #"), (F.col("row_no") % 2).cast("string")))
    return Y.errors_pivot(rows)


def error_counts(spark, sf_dir):
    return R.error_counts(_plain(spark, sf_dir))


def library_class(spark, sf_dir):
    return _plain(spark, sf_dir).groupBy(S.library_of(F.col("Synthesizer")).alias("library")).agg(
        F.count_distinct("Synthesizer").alias("models"), F.count(F.lit(1)).alias("num_rows")
    )


def leaderboard(spark, sf_dir):
    out = R.sort_table(R.leaderboard(_plain(spark, sf_dir), ["Synthesizer"], ["Train_Time", "Quality_Score"]),
                       ["Quality_Score"], reverse=True)
    return rounded(out, "Train_Time", "Quality_Score")


def short_errors(spark, sf_dir):
    text = F.concat(F.col("Error"), F.lit(" in "), F.col("Dataset"), F.lit(" of "), F.col("Synthesizer"))
    return V.results(spark, sf_dir).where("Error is not null").select(
        "Dataset", "Synthesizer", S.short_error(text).alias("short_error"),
        S.short_name(S.plain_name(F.col("Synthesizer"))).alias("short_name"),
        S.known_error(F.col("Error"), "Synthesizer Timeout").alias("timeout"),
        S.unknown_error(F.col("Error")).alias("unknown_error"),
    )


def best_model(spark, sf_dir):
    return R.best_model(_scored(spark, sf_dir))


def model_details(spark, sf_dir):
    judged = materialize(R.wins(R.process_results(V.results(spark, sf_dir), NAMES), NAMES))
    return J.model_details(judged, V.descriptions(spark, sf_dir), Y.plot_data(judged), "single_table")


def dataset_details(spark, sf_dir):
    from mirrorframe.operators import catalog as C

    summary = C.dataset_summary(
        V.catalog(spark, sf_dir), V.edges(spark, sf_dir), C.row_counts(V.table_rows(spark, sf_dir)), None
    )
    number = F.substring(F.col("Dataset"), 2, 9).cast("int")
    out = J.dataset_details(
        _scored(spark, sf_dir).where("Dataset <> 'd11'"),
        summary.where(number % 2 == 0), summary.where(number % 3 == 0), "single_table",
    )
    return out.select("Dataset", "Availability", F.col("Best Model").alias("Best_Model"), "Total_Num_Columns",
                      "Total_Num_Rows", F.col("Data Modality").alias("Data_Modality"))


def upsert_by_key(spark, sf_dir):
    rows = V.results(spark, sf_dir).select("Dataset", "Synthesizer", "Train_Time")
    new = rows.where("Dataset in ('d2', 'd3')").withColumn("Train_Time", F.col("Train_Time") + 100)
    return J.upsert(rows.where("Dataset <> 'd3'"), new, "Dataset")


def missing_job_rows(spark, sf_dir):
    rows = V.results(spark, sf_dir).select("Dataset", "Synthesizer", "Train_Time", "Error")
    return J.missing_job_rows(V.jobs(spark, sf_dir), rows.where("Train_Time > 30"))


def job_status(spark, sf_dir):
    return J.job_status(V.jobs(spark, sf_dir), V.artifacts(spark, sf_dir), V.instances(spark, sf_dir))


def job_grid(spark, sf_dir):
    return J.job_grid(V.results(spark, sf_dir), ["UniformSynthesizer", "ColumnSynthesizer", "Variant:Wide"])


def collect_distinct(spark, sf_dir):
    first = V.results(spark, sf_dir).select("Dataset", "Synthesizer", "Train_Time", "Error")
    second = V.results(spark, sf_dir).select("Synthesizer", "Dataset", "Train_Time", "Sample_Time")
    doubled = first.unionByName(second, allowMissingColumns=True).unionByName(first, allowMissingColumns=True)
    return doubled.distinct()


def bucket_precedence(spark, sf_dir):
    parts = V.table(spark, sf_dir, "part").groupBy(
        F.col("p_type").alias("dataset_name"), F.col("p_brand").alias("root")
    ).agg(F.sum("p_size").cast("bigint").alias("size"), F.min("p_size").alias("priority"))
    return J.bucket_precedence(parts)


def missing_names(spark, sf_dir):
    requested = V.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("Dataset"))
    available = V.table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("Dataset"))
    return J.missing_names(requested, available)


def dataset_selection(spark, sf_dir):
    names = V.results(spark, sf_dir).groupBy("Dataset").agg(F.count(F.lit(1)).alias("num_rows"))
    return J.select_datasets(names, ["d1", "d2", "d3", "d4"], ["d2"])


def deadline_passed(spark, sf_dir):
    orders = V.table(spark, sf_dir, "orders")
    launched = F.col("o_orderdate")
    lines = V.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("now"))
    return orders.join(lines, orders.o_orderkey == lines.l_orderkey).select(
        "o_orderkey", S.past_deadline(F.col("now"), launched, F.round(F.col("o_totalprice"), 0)).alias("passed")
    )


def run_index_latest(spark, sf_dir):
    runs = V.run_versions(spark, sf_dir).select(
        F.date_format("starting_date", "yyyy-MM-dd").alias("date"), "run"
    ).unionByName(V.result_files(spark, sf_dir).groupBy("run").agg(
        F.concat(F.lit("2026-01-"), F.lpad((F.max("row_no") + F.count(F.lit(1)) % 20 + 1).cast("string"), 2, "0")).alias("date")
    ))
    return runs.agg(F.max_by("run", F.struct("date", "run")).alias("folder_name"), F.max("date").alias("latest_date"))


def run_names(spark, sf_dir):
    """Run ids and folder names over the dates of all orders."""
    days = V.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    folder = S.run_folder(F.date_format("day", "yyyy-MM-dd"), "results_")
    return days.select(
        folder.alias("folder"), S.run_id(F.col("day"), F.col("n")).alias("run_id"),
        F.date_format(S.run_date(folder), "yyyy-MM-dd").alias("parsed"),
    )


def evaluate_times(spark, sf_dir):
    rows = V.results(spark, sf_dir)
    parts = [F.nullif(F.col("Sample_Time"), F.lit(0.0)),
             F.when(F.col("Error").isNull(), F.col("Train_Time")),
             F.when(F.col("Train_Time") > 50, F.lit(float("nan"))).otherwise(F.lit(None).cast("double"))]
    return rows.select("Dataset", "Synthesizer", R.evaluate_time(parts).alias("Evaluate_Time"))


QUERIES = {
    f.__name__: f
    for f in [
        wins_per_synthesizer, adjusted_scores, uniform_times, process_results, pareto_per_dataset, meets_baseline,
        summary_pivot, datasets_in_run, runs_not_later, latest_run, runs_complete, aggregated_time, pareto_models,
        pareto_end_points, markers, plot_data, load_results_filtered, summary_projection, complete_datasets,
        dedup_best, coverage, mean_score, mean_seconds, best_rank_counts, beat_baseline, legacy_summary,
        errors_pivot, error_counts, library_class, leaderboard, short_errors, best_model, model_details,
        dataset_details, upsert_by_key, missing_job_rows, job_status, job_grid, collect_distinct,
        bucket_precedence, missing_names, dataset_selection, deadline_passed, run_index_latest, run_names,
        evaluate_times,
    ]
}
