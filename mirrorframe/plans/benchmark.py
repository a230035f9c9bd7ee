"""Benchmark runs: every dataset with every synthesizer, one result row each.

The driver only walks the grid; fitting, sampling and scoring of a cell are Spark jobs. Each cell's row is
appended as soon as it is known, so a run that dies continues with the cells it still lacks.
"""

from __future__ import annotations

import pickle
import threading
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import fields, is_dataclass

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions.scalar import TIMEOUT_ERROR
from mirrorframe.metrics import privacy, report
from mirrorframe.metrics.registry import select_metrics
from mirrorframe.operators import results as R
from mirrorframe.operators.catalog import dataset_size
from mirrorframe.session import materialize
from mirrorframe.sources import results as sinks
from mirrorframe.sources.metadata import Metadata, TableSpec
from mirrorframe.synth.registry import resolve

# Error labels.
LOAD_TIMEOUT = "Load Timeout"
METRIC_TIMEOUT = "Metric Timeout"

SINGLE_BASELINE, MULTI_BASELINE = "UniformSynthesizer", "MultiTableUniformSynthesizer"


class _Deadline:
    """Cancels the Spark jobs of this thread once the time is up, and stops it between jobs."""

    def __init__(self, spark: SparkSession, seconds: float | None):
        self.context, self.seconds, self.tag = spark.sparkContext, seconds, f"cell-{uuid.uuid4().hex}"
        self.over, self._done = False, threading.Event()

    def __enter__(self):
        if self.seconds is not None:
            self.context.addJobTag(self.tag)
            threading.Thread(target=self._watch, daemon=True).start()
        return self

    def _watch(self):
        if not self._done.wait(self.seconds):
            self.over = True
            # Jobs submitted after the first cancellation are cancelled too.
            while not self._done.wait(0.5):
                self.context.cancelJobsWithTag(self.tag)

    def check(self):
        if self.over:
            raise TimeoutError

    def __exit__(self, *_):
        self._done.set()
        if self.seconds is not None:
            self.context.removeJobTag(self.tag)


def _error_text(error: Exception) -> str:
    message = str(error).strip()
    return f"{type(error).__name__}: {message}" if message else type(error).__name__


def _megabytes(data: DataFrame | dict[str, DataFrame]) -> float:
    frames = data.values() if isinstance(data, dict) else [data]
    return sum(dataset_size(df).first()["size_MB"] for df in frames)


def model_megabytes(model) -> float:
    """Bytes of a fitted model: its parameter tables on disk and its parameters on the driver."""
    if isinstance(model, DataFrame):
        jvm, conf = model.sparkSession.sparkContext._jvm, model.sparkSession.sparkContext._jsc.hadoopConfiguration()
        total = 0
        for uri in model.inputFiles():
            path = jvm.org.apache.hadoop.fs.Path(uri)
            total += path.getFileSystem(conf).getFileStatus(path).getLen()
        return total / 1e6
    if is_dataclass(model):
        return sum(model_megabytes(getattr(model, f.name)) for f in fields(model))
    if isinstance(model, dict):
        return sum(model_megabytes(v) for v in model.values())
    if isinstance(model, (list, tuple)) and any(isinstance(v, DataFrame) or is_dataclass(v) for v in model):
        return sum(model_megabytes(v) for v in model)
    return len(pickle.dumps(model)) / 1e6


def _stored(data: DataFrame | dict[str, DataFrame]) -> DataFrame | dict[str, DataFrame]:
    """Sampled tables written out, so scoring reads rows instead of sampling again."""
    if isinstance(data, dict):
        return {name: materialize(df) for name, df in data.items()}
    return materialize(data)


def run_cell(
    spark: SparkSession,
    name: str,
    load: Callable[[], tuple],
    synthesizer,
    metrics: list[tuple],
    quality: bool,
    diagnostic: bool,
    privacy_score: bool,
    timeout: float | None,
    save: Callable | None = None,
) -> dict:
    """The result row of one dataset and synthesizer. Errors and timeouts end up in the row."""
    multi = synthesizer.modality == "multi_table"
    row = {"Synthesizer": synthesizer.name, "Dataset": name}
    stages: list[float | None] = []
    error, started, fitted = LOAD_TIMEOUT, None, None
    with _Deadline(spark, timeout) as deadline:
        try:
            data, metadata = load()
            row["Dataset_Size_MB"] = _megabytes(data)
            # Counted before either clock runs: the rows to sample are the run's choice, not the synthesizer's work.
            size = 1.0 if multi else data.count()
            deadline.check()
            error, started = TIMEOUT_ERROR, time.perf_counter()
            try:
                model = synthesizer.fit(data, metadata)
                fitted = time.perf_counter()
                deadline.check()
                synthetic = _stored(synthesizer.sample(model, size))
                sampled = time.perf_counter()
                deadline.check()
            except Exception as failure:
                if deadline.over:
                    raise
                # What was reached of fitting and sampling is kept.
                now = time.perf_counter()
                row["Train_Time"] = (fitted or now) - started
                row["Sample_Time"] = now - fitted if fitted else 0.0
                row["Error"] = _error_text(failure)
                return row
            row["Train_Time"], row["Sample_Time"] = fitted - started, sampled - fitted
            row["Synthesizer_Size_MB"] = model_megabytes(model)
            error = None
            if save:
                save(synthetic)
            _score(row, stages, deadline, data, synthetic, metadata, metrics, quality, diagnostic, privacy_score, multi)
        except Exception as failure:
            if deadline.over:
                if error:
                    row["Error"] = error
            else:
                row["Error"] = _error_text(failure)
    if stages:
        row["Evaluate_Time"] = sum(s for s in stages if s is not None)
    return row


def _score(row, stages, deadline, data, synthetic, metadata, metrics, quality, diagnostic, privacy_score, multi):
    def timed(compute):
        started = time.perf_counter()
        value = compute()
        deadline.check()
        stages.append(time.perf_counter() - started)
        return value

    for metric, kwargs in metrics:
        started = time.perf_counter()
        row[metric.name], row[f"{metric.name} Error"] = None, METRIC_TIMEOUT
        try:
            row[metric.name] = metric.normalize(metric.compute(data, synthetic, metadata, **kwargs))
            row[f"{metric.name} Error"] = None
        except Exception as failure:
            deadline.check()
            # A failing metric records its error and does not stop the others.
            row[f"{metric.name} Error"] = _error_text(failure)
        deadline.check()
        stages.append(time.perf_counter() - started)
    if diagnostic:
        make = report.multi_table_diagnostic_report if multi else report.diagnostic_report
        row["Diagnostic_Score"] = timed(lambda: report.overall(make(data, synthetic, metadata)))
    if quality:
        make = report.multi_table_quality_report if multi else report.quality_report
        row["Quality_Score"] = timed(lambda: report.overall(make(data, synthetic, metadata)))
    if privacy_score:
        numbers, texts = report.modelled(metadata)
        sides = [report.read_datetimes(df, metadata) for df in (data, synthetic)]
        row["Privacy_Score"] = timed(lambda: privacy.baseline_protection(*sides, numbers, texts).agg(F.avg("score")).first()[0])


def result_schema(metrics: list[tuple], quality: bool, diagnostic: bool, privacy_score: bool) -> T.StructType:
    """Fixed columns, the scores asked for, a column per metric, and the error."""
    asked = {"Diagnostic_Score": diagnostic, "Quality_Score": quality, "Privacy_Score": privacy_score}
    names = [*sinks.RESULT_COLUMNS, *[c for c in sinks.SCORE_COLUMNS if asked[c]], *[m.name for m, _ in metrics], "Error"]
    return T.StructType([
        T.StructField(n, T.StringType() if n in sinks.TEXT_COLUMNS else T.DoubleType()) for n in names
    ])


def result_rows(spark: SparkSession, rows: list[dict], schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([[r.get(f.name) for f in schema.fields] for r in rows], schema)


def _run(
    spark, datasets, synthesizers, modality, baseline, metrics, quality, diagnostic, privacy_score, timeout,
    output, run, workers,
):
    makers = list(synthesizers)
    if not any(m == baseline or getattr(m, "name", None) == baseline for m in makers):
        makers.append(baseline)
    makers = resolve(makers, modality)
    chosen = select_metrics(metrics, modality) if metrics else []
    schema = result_schema(chosen, quality, diagnostic, privacy_score)
    cells = f"{output}/cells/run={run}" if output else None

    done = _finished(spark, cells) if cells else set()
    grid = [(n, m) for n in datasets for m in makers if (n, m.name) not in done]

    def one(cell):
        name, maker = cell
        load = datasets[name] if callable(datasets[name]) else lambda: datasets[name]
        save = (lambda made: sinks.write_synthetic(made, f"{output}/synthetic", run, name, maker.name)) if output else None
        row = run_cell(spark, name, load, maker, chosen, quality, diagnostic, privacy_score, timeout, save)
        if cells:
            sinks.write_cell(result_rows(spark, [row], schema), cells)
        return row

    if workers > 1:
        with ThreadPoolExecutor(workers) as pool:
            rows = list(pool.map(inheritable_thread_target(spark)(one), grid))
    else:
        rows = [one(cell) for cell in grid]
    table = sinks.read_cells(spark, cells) if cells else result_rows(spark, rows, schema)
    if not quality:
        table = table.withColumn("Quality_Score", F.lit(None).cast("double"))
    scored = R.adjusted_scores(table, ["Synthesizer"], timeout)
    if not quality:
        scored = scored.drop("Quality_Score", "Adjusted_Quality_Score")
    if output:
        # The whole run as it now stands: a restarted run replaces its rows.
        scored.write.mode("overwrite").parquet(f"{output}/results/run={run}")
    return scored


def _finished(spark, cells) -> set[tuple[str, str]]:
    from mirrorframe.sources.files import exists

    if not exists(spark, cells):
        return set()
    return {(r["Dataset"], r["Synthesizer"]) for r in sinks.read_cells(spark, cells).select("Dataset", "Synthesizer").collect()}


def benchmark_single_table(
    spark: SparkSession,
    datasets: dict[str, tuple[DataFrame, TableSpec] | Callable],
    synthesizers: Sequence = ("GaussianCopulaSynthesizer",),
    metrics: Sequence = (),
    compute_quality_score: bool = True,
    compute_diagnostic_score: bool = True,
    compute_privacy_score: bool = True,
    timeout: float | None = None,
    output_destination: str | None = None,
    run: str = "run",
    workers: int = 1,
) -> DataFrame:
    """Fit, sample as many rows as the data has, and score, for every dataset and synthesizer.

    `datasets` maps names to (data, table spec) or to a function that loads them. The uniform baseline is
    always part of the run. With `output_destination`, synthetic tables and rows are kept there and a
    repeated call with the same `run` only does what is missing.
    """
    return _run(spark, datasets, synthesizers, "single_table", SINGLE_BASELINE, metrics, compute_quality_score,
                compute_diagnostic_score, compute_privacy_score, timeout, output_destination, run, workers)


def benchmark_multi_table(
    spark: SparkSession,
    datasets: dict[str, tuple[dict[str, DataFrame], Metadata] | Callable],
    synthesizers: Sequence = ("HierarchicalSynthesizer",),
    compute_quality_score: bool = True,
    compute_diagnostic_score: bool = True,
    timeout: float | None = None,
    output_destination: str | None = None,
    run: str = "run",
    workers: int = 1,
) -> DataFrame:
    """As for single tables, on linked tables sampled at scale 1; no privacy score and no named metrics."""
    return _run(spark, datasets, synthesizers, "multi_table", MULTI_BASELINE, (), compute_quality_score,
                compute_diagnostic_score, False, timeout, output_destination, run, workers)
