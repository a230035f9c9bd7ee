import time

import pytest
from pyspark.sql import functions as F

from mirrorframe.metrics.registry import Metric
from mirrorframe.plans import benchmark as B
from mirrorframe.plans import views as V
from mirrorframe.sources.metadata import infer_table
from mirrorframe.synth.base import create_single_table_synthesizer


@pytest.fixture
def parts(spark, sf):
    data = V.table(spark, sf, "part").select("p_brand", "p_size", "p_retailprice")
    return {"part": (data, infer_table(data))}


def broken_fit(data, table):
    raise ValueError("cannot fit")


def broken_sample(model, n):
    raise KeyError("x")


def test_failures_stay_in_their_row(spark, parts, tmp_path):
    fit_fails = create_single_table_synthesizer("FitFails", broken_fit, broken_sample)
    sample_fails = create_single_table_synthesizer("SampleFails", lambda d, t: d, broken_sample)
    fails = Metric("Odd", lambda real, synthetic, table: 1 / 0)

    def absent():
        raise FileNotFoundError("gone")

    out = str(tmp_path / "out")
    options = dict(metrics=["KSComplement", fails], compute_privacy_score=False, timeout=600.0, output_destination=out, run="r")
    table = B.benchmark_single_table(spark, {**parts, "absent": absent}, [fit_fails, sample_fails], **options)
    rows = {(r["Dataset"], r["Synthesizer"]): r for r in table.collect()}
    assert len(rows) == 6
    fit = rows["part", "Custom:FitFails"]
    assert fit["Error"] == "ValueError: cannot fit" and fit["Train_Time"] > 0 and fit["Sample_Time"] == 0
    sample = rows["part", "Custom:SampleFails"]
    assert sample["Error"] == "KeyError: 'x'" and sample["Sample_Time"] > 0
    good = rows["part", "UniformSynthesizer"]
    assert good["Error"] is None and 0 < good["Quality_Score"] < 1 and good["KSComplement"] > 0 and good["Odd"] is None
    assert good["Evaluate_Time"] > 0 and sample["Adjusted_Quality_Score"] == good["Quality_Score"]
    assert rows["absent", "UniformSynthesizer"]["Error"] == "FileNotFoundError: gone"
    assert rows["absent", "UniformSynthesizer"]["Train_Time"] is None
    # A second call finds every cell done.
    started = time.time()
    again = B.benchmark_single_table(spark, {**parts, "absent": absent}, [fit_fails, sample_fails], **options)
    assert again.count() == 6 and time.time() - started < 30
    # What is on disk holds each cell once, also if one is done again.
    spark = parts["part"][0].sparkSession
    B.sinks.write_cell(B.sinks.read_cells(spark, f"{out}/cells/run=r").where("Dataset = 'part'").limit(1), f"{out}/cells/run=r")
    B.benchmark_single_table(spark, {**parts, "absent": absent}, [fit_fails, sample_fails], **options)
    stored = spark.read.parquet(f"{out}/results").where("run = 'r'").collect()
    assert sorted((r["Dataset"], r["Synthesizer"]) for r in stored) == sorted(rows)
    assert {(r["Dataset"], r["Synthesizer"]): r["Quality_Score"] for r in stored} == {k: r["Quality_Score"] for k, r in rows.items()}


def test_timeout_cancels_the_cell(spark, parts):
    def slow(data, table):
        # Far more work than the time allows.
        spark.range(0, 10**13, 1, 8).select(F.sum(F.length(F.sha2(F.col("id").cast("string"), 512)))).collect()

    maker = create_single_table_synthesizer("Slow", slow, lambda m, n: m)
    started = time.time()
    row = B.run_cell(spark, "part", lambda: parts["part"], maker, [], True, True, False, timeout=3.0)
    assert time.time() - started < 50
    assert row["Error"] == "Synthesizer Timeout" and "Train_Time" not in row


def test_parallel_cells(spark, parts):
    table = B.benchmark_single_table(spark, parts, ["IdentitySynthesizer"], compute_diagnostic_score=False,
                                     compute_privacy_score=False, workers=2)
    scores = {r["Synthesizer"]: r["Quality_Score"] for r in table.collect()}
    assert scores["UniformSynthesizer"] < scores["IdentitySynthesizer"] == 1.0
    assert "Diagnostic_Score" not in table.columns
