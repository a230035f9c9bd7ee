"""Benchmark-shaped inputs derived from the TPC-H-like tables, so operators can be checked on any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]
DATETIME = ["l_shipdate"]

RUN_FOLDERS = ["results_03_01_2026", "results_02_01_2026", "results_01_01_2026"]

# (parent table, parent key, child table, child key)
RELATIONSHIPS = [
    ("region", "r_regionkey", "nation", "n_regionkey"),
    ("nation", "n_nationkey", "customer", "c_nationkey"),
    ("nation", "n_nationkey", "supplier", "s_nationkey"),
    ("customer", "c_custkey", "orders", "o_custkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("supplier", "s_suppkey", "lineitem", "l_suppkey"),
    ("part", "p_partkey", "lineitem", "l_partkey"),
]
STAR_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dataset() -> Column:
    return F.expr("concat('d', cast(l_partkey % 12 as string))").alias("Dataset")


def _synthesizer() -> Column:
    return F.expr(
        "case l_suppkey % 6 when 0 then 'UniformSynthesizer' when 1 then 'GaussianCopulaSynthesizer' "
        "when 2 then 'ColumnSynthesizer(1)' when 3 then 'CTGANSynthesizer(1)' "
        "when 4 then 'TVAESynthesizer(2)' else 'CopulaGANSynthesizer' end"
    ).alias("Synthesizer")


def _scores() -> list[Column]:
    return [
        F.expr("cast(count(*) % 97 + 1 as double)").alias("Train_Time"),
        F.expr("cast(count(*) % 13 as double)").alias("Sample_Time"),
        F.expr("cast(sum(l_linenumber) % 101 as double) / 101").alias("Quality_Score"),
        F.expr("cast(sum(l_linenumber) % 7 as double) / 7").alias("Diagnostic_Score"),
        F.expr("case when max(l_orderkey) % 11 = 0 then 'Synthesizer Timeout' "
               "when max(l_orderkey) % 7 = 0 then 'ValueError: bad fit' end").alias("Error"),
    ]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (dataset, synthesizer)."""
    return table(spark, sf_dir, "lineitem").groupBy(_dataset(), _synthesizer()).agg(*_scores())


def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several runs, two files each, with repeated pairs and some pairs missing."""
    rows = table(spark, sf_dir, "lineitem").where("l_partkey % 12 + l_suppkey % 6 <> 14")
    run = F.expr("concat('results_0', cast(l_linenumber % 3 + 1 as string), '_01_2026')").alias("run")
    file_no = F.expr("cast(l_orderkey % 2 as int)").alias("file_no")
    return rows.groupBy(run, file_no, _dataset(), _synthesizer()).agg(
        *_scores(), F.expr("min(l_suppkey % 6)").alias("row_no")
    )


def run_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metainfo per run: version, start and completion, from the order dates of the run's rows."""
    run = F.expr("concat('results_0', cast(l_linenumber % 3 + 1 as string), '_01_2026')").alias("run")
    lines = table(spark, sf_dir, "lineitem").groupBy(run).agg(
        F.expr("concat('0.13.', cast(max(l_orderkey) % 5 as string))").alias("version"),
        F.expr("case when max(l_orderkey) % 2 = 0 then max(l_shipdate) end").alias("completed_date"),
        F.min("l_shipdate").alias("starting_date"),
    )
    return lines.where("run <> 'results_02_01_2026'")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(_dataset(), _synthesizer()).agg(
        F.expr("concat('i', cast(min(l_orderkey) % 4 as string))").alias("Instance_Name"),
        F.expr("concat('out', cast(min(l_orderkey) % 2 as string))").alias("Output_Destination"),
        F.expr("min(l_orderkey) * 100 + min(l_partkey % 12) * 6 + min(l_suppkey % 6)").alias("position"),
    )


def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files found per job; some jobs have all three kinds, some only the result, some none."""
    return jobs(spark, sf_dir).select(
        "Output_Destination", "Dataset", "Synthesizer",
        F.explode(F.expr(
            "case position % 3 when 0 then array('benchmark_result', 'synthetic_data', 'synthesizer') "
            "when 1 then array('benchmark_result') else array('other') end"
        )).alias("kind"),
    )


def instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).groupBy("Instance_Name").agg(
        F.expr("case when Instance_Name in ('i0', 'i1') then 'running' else 'stopped' end").alias("state")
    )


def descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model descriptions for the synthesizers whose name sorts before `D`; others fall to defaults."""
    return results(spark, sf_dir).where("Synthesizer < 'D'").groupBy(
        F.expr("trim(regexp_replace(Synthesizer, '\\\\s*\\\\(\\\\d+\\\\)\\\\s*$', ''))").alias("Synthesizer")
    ).agg(
        F.expr("concat('lib', cast(count(*) as string))").alias("library"),
        F.lit(None).cast("string").alias("organization"),
        F.lit("single_table").alias("modality"),
        F.expr("case when max(Train_Time) > 50 then 'Slow' end").alias("type"),
        F.lit(None).cast("string").alias("description"),
    )


def real_and_synthetic(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem")
    return lines.where("l_orderkey % 2 = 0"), lines.where("l_orderkey % 2 = 1")


def catalog(spark: SparkSession, sf_dir: str, rows: str = "true") -> DataFrame:
    """One row per (dataset, table, column) with a semantic type and key flags, from the lines meeting `rows`."""
    return table(spark, sf_dir, "lineitem").where(rows).groupBy(
        F.expr("concat('d', cast(l_partkey % 12 as string))").alias("dataset"),
        F.expr("concat('t', cast(l_suppkey % 5 as string))").alias("table_name"),
        F.expr("concat('c', cast(l_orderkey % 9 as string))").alias("column_name"),
    ).agg(
        F.expr("element_at(array('numerical', 'categorical', 'boolean', 'datetime', 'id', 'email'), "
               "cast(sum(l_linenumber) % 6 as int) + 1)").alias("sdtype"),
        F.expr("min(l_orderkey % 9) = 0").alias("is_primary_key"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parent-to-child edges; parents always have the lower number, so there are no cycles."""
    return table(spark, sf_dir, "lineitem").where(
        "l_suppkey % 5 < l_linenumber % 5 and (l_partkey + l_suppkey + l_linenumber) % 3 = 0 and l_partkey % 12 <> 7"
    ).groupBy(
        F.expr("concat('d', cast(l_partkey % 12 as string))").alias("dataset"),
        F.expr("concat('t', cast(l_suppkey % 5 as string))").alias("parent_table"),
        F.expr("concat('t', cast(l_linenumber % 5 as string))").alias("child_table"),
        F.expr("concat('k', cast(l_partkey % 24 as string))").alias("child_key"),
    ).agg(F.count(F.lit(1)).alias("n")).drop("n")


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the catalogued tables: (dataset, table_name), one per record."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("concat('d', cast(l_partkey % 12 as string))").alias("dataset"),
        F.expr("concat('t', cast(l_suppkey % 5 as string))").alias("table_name"),
    )
