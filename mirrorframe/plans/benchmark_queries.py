"""Registered benchmark runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from mirrorframe.operators import jobs as J
from mirrorframe.operators import summary as Y
from mirrorframe.plans import benchmark as B
from mirrorframe.plans import views as V
from mirrorframe.plans.synth_queries import star
from mirrorframe.session import materialize
from mirrorframe.sources.metadata import Metadata, infer_table


def benchmark_single(spark, sf_dir):
    """Customers and parts with three synthesizers."""
    datasets = {}
    for name, key in (("customer", "c_custkey"), ("part", "p_partkey")):
        data = V.table(spark, sf_dir, name)
        datasets[name] = (data, infer_table(data, key))
    return B.benchmark_single_table(
        spark, datasets, ["GaussianCopulaSynthesizer", "IdentitySynthesizer"], metrics=["KSComplement"],
        compute_privacy_score=False)


def benchmark_multi(spark, sf_dir):
    """Regions, nations and customers as linked tables."""
    data, metadata = star(spark, sf_dir)
    names = ["region", "nation", "customer"]
    part = Metadata({n: metadata.tables[n] for n in names},
                    [r for r in metadata.relationships if r.parent_table in names and r.child_table in names])
    return B.benchmark_multi_table(spark, {"customers": ({n: data[n] for n in names}, part)}, ["HierarchicalSynthesizer"])


def all_results(spark, sf_dir):
    """Summary, dataset, plot and model tables of the newest run, as one table of (table, key, value)."""
    from mirrorframe.plans.result_queries import ORDER

    order = ORDER
    rows = V.result_files(spark, sf_dir)
    summary, detail = Y.summarize_runs(rows, V.run_versions(spark, sf_dir), "results_03_01_2026", order)
    judged = materialize(detail)
    plotted = materialize(Y.plot_data(judged))
    models = J.model_details(judged, V.descriptions(spark, sf_dir), plotted, "single_table")
    newest = summary.columns[1]
    return (
        summary.select(F.lit("wins").alias("table_name"), F.col("Synthesizer").alias("key"), F.col(f"`{newest}`").alias("value"))
        .unionByName(plotted.select(F.lit("plot").alias("table_name"), F.coalesce("Synthesizer", F.lit("end")).alias("key"),
                                    F.round("Quality_Score", 6).cast("string").alias("value")))
        .unionByName(models.select(F.lit("models").alias("table_name"), F.col("Synthesizer").alias("key"),
                                   F.col("`Number of datasets - Wins`").cast("string").alias("value")))
    )


QUERIES = {f.__name__: f for f in [benchmark_single, benchmark_multi, all_results]}
