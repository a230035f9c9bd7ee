"""Job grids, job status, missing results, and the detail tables built over results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions import scalar as S
from mirrorframe.operators import results as R

# Defaults of the model table.
DEFAULT_SOURCE = "In-house"
UNKNOWN = "Unknown"
NO_DESCRIPTION = "No description available."
MODEL_COLUMNS = [
    "Synthesizer", "Model Name", "Data Modality", "Source", "Organization", "Type", "Description",
    "Number of datasets - Wins", "Number of datasets - Timeout", "Number of datasets - Errors",
    "On the Pareto Curve",
]
ARTIFACTS = ["benchmark_result", "synthetic_data", "synthesizer"]


def job_grid(datasets: DataFrame, synthesizers: Sequence[str]) -> DataFrame:
    """Every dataset with every requested synthesizer; the list of synthesizers is an argument, not data."""
    return datasets.select("Dataset").distinct().select(
        "Dataset", F.explode(F.array(*[F.lit(s) for s in synthesizers])).alias("Synthesizer")
    )


def missing_job_rows(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Results plus one deadline-error row per job that left none."""
    missing = jobs.select("Dataset", "Synthesizer").distinct().join(results, ["Dataset", "Synthesizer"], "left_anti")
    return results.unionByName(missing.withColumn("Error", F.lit(S.DEADLINE_ERROR)), allowMissingColumns=True)


def job_status(jobs: DataFrame, artifacts: DataFrame, instances: DataFrame) -> DataFrame:
    """Status per job from the artifacts present and the state of its instance.

    jobs: Dataset, Synthesizer, Instance_Name, Output_Destination, position;
    artifacts: Output_Destination, Dataset, Synthesizer, kind; instances: Instance_Name, state.
    """
    key = ["Output_Destination", "Dataset", "Synthesizer"]
    found = artifacts.groupBy(*key).agg(
        *[F.bool_or(F.col("kind") == k).alias(f"_{k}") for k in ARTIFACTS]
    )
    result, data, model = (F.coalesce(F.col(f"_{k}"), F.lit(False)) for k in ARTIFACTS)
    seen = jobs.join(found, key, "left").withColumn(
        "_artifact_status",
        F.when(result & data & model, "Completed").when(result & ~data & ~model, "Failed").otherwise("Queued"),
    ).join(instances, "Instance_Name", "left")
    first = (
        seen.where("_artifact_status = 'Queued' and state = 'running'")
        .groupBy("Instance_Name").agg(F.min("position").alias("_first"))
    )
    running = F.coalesce(F.col("state") == "running", F.lit(False))
    status = (
        F.when(F.col("_artifact_status") != "Queued", F.col("_artifact_status"))
        .when(~running, "Failed")
        .when(F.col("position") == F.col("_first"), "Running")
        .otherwise("Queued")
    )
    return seen.join(first, "Instance_Name", "left").select(
        "Dataset", "Synthesizer", "Instance_Name", "Output_Destination", status.alias("Status")
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """`new` rows plus the `old` rows whose key `new` does not hold."""
    kept = old.join(new.select(key).distinct(), key, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def first_source(*sources: DataFrame, key: str) -> DataFrame:
    """Rows of the first source that knows a key; later sources only fill what is still missing."""
    table = sources[0]
    for source in sources[1:]:
        table = table.unionByName(source.join(table.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)
    return table


def bucket_precedence(listings: DataFrame) -> DataFrame:
    """One row per dataset name: the one with the lowest `priority`."""
    row = F.min_by(F.struct(*listings.columns), F.struct("priority", "root")).alias("row")
    return listings.groupBy("dataset_name").agg(row).select("row.*")


def dataset_details(
    results: DataFrame, public: DataFrame, private: DataFrame, modality: str
) -> DataFrame:
    """Dataset summaries with availability and best model; the public source wins."""
    wanted = results.select("Dataset").distinct()
    known = first_source(
        public.withColumn("Availability", F.lit("Public")),
        private.withColumn("Availability", F.lit("Private")),
        key="Dataset",
    ).join(wanted, "Dataset", "left_semi")
    best = R.best_model(results).withColumnRenamed("Best_Model", "Best Model")
    return known.join(best, "Dataset", "left").withColumn("Data Modality", F.lit(modality))


def model_details(
    judged: DataFrame, descriptions: DataFrame, frontier: DataFrame, modality: str
) -> DataFrame:
    """One row per synthesizer: description, wins, failures and whether it is on the Pareto curve.

    descriptions: Synthesizer, library, organization, modality, type, description;
    frontier: plot rows (`Synthesizer` without its suffix, `Pareto`).
    """
    models = judged.groupBy("Synthesizer").agg(F.sum("Win").alias("_wins"))
    on_curve = frontier.where("Pareto and Synthesizer is not null").select(
        F.concat("Synthesizer", F.lit(S.MODEL_SUFFIX)).alias("Synthesizer"), F.lit(True).alias("_curve")
    ).distinct()
    return (
        models.join(descriptions, "Synthesizer", "left")
        .join(R.error_counts(judged), "Synthesizer", "left")
        .join(on_curve, "Synthesizer", "left")
        .select(
            "Synthesizer",
            S.short_name(F.col("Synthesizer")).alias("Model Name"),
            F.coalesce("modality", F.lit(UNKNOWN)).alias("Data Modality"),
            F.coalesce("library", F.lit(DEFAULT_SOURCE)).alias("Source"),
            F.coalesce("organization", F.lit(UNKNOWN)).alias("Organization"),
            F.coalesce("type", F.lit(UNKNOWN)).alias("Type"),
            F.coalesce("description", F.lit(NO_DESCRIPTION)).alias("Description"),
            F.coalesce("_wins", F.lit(0)).cast("bigint").alias("Number of datasets - Wins"),
            F.coalesce("Timeouts", F.lit(0)).cast("bigint").alias("Number of datasets - Timeout"),
            F.coalesce("Errors", F.lit(0)).cast("bigint").alias("Number of datasets - Errors"),
            F.coalesce("_curve", F.lit(False)).alias("On the Pareto Curve"),
        )
    )


def missing_names(requested: DataFrame, available: DataFrame, key: str = "Dataset") -> DataFrame:
    """Requested names that are not available."""
    return requested.select(key).distinct().join(available.select(key).distinct(), key, "left_anti")


def select_datasets(
    available: DataFrame, include: Sequence[str] | None = None, exclude: Sequence[str] = (), key: str = "Dataset"
) -> DataFrame:
    """Included minus excluded names; an included name that does not exist is an error."""
    chosen = available
    if include is not None:
        known = {r[0] for r in available.where(F.col(key).isin(list(include))).select(key).distinct().collect()}
        unknown = sorted(set(include) - known)
        if unknown:
            raise ValueError(f"Unknown datasets: {', '.join(unknown)}")
        chosen = chosen.where(F.col(key).isin(list(include)))
    return chosen.where(~F.col(key).isin(list(exclude))) if exclude else chosen
