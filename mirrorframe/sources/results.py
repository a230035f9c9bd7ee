"""Result files, metainfo and run folders: scans and sinks."""

from __future__ import annotations

import io

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions import scalar as S
from mirrorframe.operators import summary as Y
from mirrorframe.sources.files import children, exists, listing, opened

# Columns of a result row, in order.
TEXT_COLUMNS = ["Synthesizer", "Dataset", "Error"]
RESULT_COLUMNS = [
    "Synthesizer", "Dataset", "Dataset_Size_MB", "Train_Time", "Peak_Memory_MB", "Synthesizer_Size_MB",
    "Sample_Time", "Evaluate_Time",
]
SCORE_COLUMNS = ["Diagnostic_Score", "Quality_Score", "Privacy_Score"]
LATER_COLUMNS = ["Error", "Adjusted_Total_Time", "Adjusted_Quality_Score"]
METAINFO_SCHEMA = (
    "run_id string, modality string, starting_date string, completed_date string, version string, "
    "jobs array<struct<dataset:string,synthesizer:string>>, run string, file_name string"
)


# --- CSV results ------------------------------------------------------------------------------------

def _first_lines(files: DataFrame) -> DataFrame:
    """(path, header) with only the first line of each file read."""

    def read(frames):
        for frame in frames:
            heads = []
            for path in frame["path"]:
                with opened(path) as stream:
                    heads.append(io.TextIOWrapper(stream, encoding="utf-8-sig").readline().rstrip("\r\n"))
            yield pd.DataFrame({"path": frame["path"], "header": heads})

    return files.select("path").mapInPandas(read, "path string, header string")


def read_csv_by_header(spark: SparkSession, root: str, glob: str = "*.csv", typed: bool = True) -> DataFrame:
    """All matching CSV files below `root`, united by column name.

    One read over files of different headers would go by position, so files are grouped by header first.
    Names are compared exactly: a column that differs from a result column only in case is another column,
    and is left out. Adds `file_path`, `file_no` (the number in `results(2).csv`) and `row_no`.
    """
    groups = _first_lines(listing(spark, root, glob)).groupBy("header").agg(F.collect_list("path").alias("paths")).collect()
    if not groups:
        raise ValueError(f"No files match {glob} below {root}.")
    fixed = {c.lower(): c for c in (*RESULT_COLUMNS, *SCORE_COLUMNS, *LATER_COLUMNS)}
    out = None
    for group in sorted(groups, key=lambda g: g["header"]):
        names = next(iter(pd.read_csv(io.StringIO(group["header"]), header=None, dtype=str).itertuples(index=False)))
        positional = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(len(names))])
        rows = (
            spark.read.schema(positional).option("header", "true").option("multiLine", "true")
            .option("escape", '"').option("enforceSchema", "true").csv([_plain(p) for p in group["paths"]])
        )
        kept = {}
        for i, name in enumerate(names):
            if fixed.get(name.lower(), name) == name and name.lower() not in {k.lower() for k in kept}:
                text = F.col(f"_c{i}")
                kept[name] = text if name in TEXT_COLUMNS or not typed else S.safe_double(text)
        path = F.col("_metadata.file_path")
        number = F.regexp_extract(path, r"(?:\(|%28)(\d+)(?:\)|%29)\.csv$", 1).try_cast("int")
        one = rows.select(
            *[c.alias(n) for n, c in kept.items()], path.alias("file_path"), F.coalesce(number, F.lit(0)).alias("file_no"),
            F.monotonically_increasing_id().alias("row_no"),
        )
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def _plain(path: str) -> str:
    from urllib.parse import unquote

    return unquote(path)


def read_results(spark: SparkSession, root: str, prefix: str) -> DataFrame:
    """All result rows of every run folder `<prefix>MM_DD_YYYY` below `root`, with `run` and an order."""
    rows = read_csv_by_header(spark, root, "results*.csv")
    run = F.regexp_extract("file_path", rf"/({prefix}\d{{2}}_\d{{2}}_\d{{4}})/", 1)
    rows = rows.withColumn("run", run).where("run <> ''")
    return rows if "Error" in rows.columns else rows.withColumn("Error", F.lit(None).cast("string"))


def collect_results(spark: SparkSession, root: str, output: str) -> DataFrame:
    """Every CSV below `root` in one table without exact duplicates, written as CSV with a header."""
    rows = read_csv_by_header(spark, root, typed=False).drop("file_path", "file_no", "row_no").distinct()
    rows.write.option("header", "true").option("escape", '"').csv(output)
    return rows


# --- runs -------------------------------------------------------------------------------------------

def list_runs(spark: SparkSession, root: str) -> DataFrame:
    """Run folders (`folder`) and their dates; folders whose name holds no date are left out."""
    names = children(spark, root).withColumnRenamed("name", "folder")
    return names.withColumn("date", S.run_date(F.col("folder"))).where("date is not null")


def latest_run(spark: SparkSession, root: str) -> DataFrame:
    return Y.latest_run(list_runs(spark, root))


def read_metainfo(spark: SparkSession, root: str, version_key: str = "version") -> DataFrame:
    """One row per `metainfo*.yaml` below `root`, with its run folder and its jobs."""

    def parse(frames):
        import yaml

        for frame in frames:
            rows = []
            for path in frame["path"]:
                with opened(path) as stream:
                    info = yaml.safe_load(stream.read()) or {}
                jobs = [{"dataset": str(d), "synthesizer": str(s)} for d, s in info.get("jobs") or []]
                text = {k: None if info.get(k) is None else str(info[k]) for k in
                        ("run_id", "modality", "starting_date", "completed_date", version_key)}
                rows.append({**text, "version": text[version_key], "jobs": jobs, "run": path.rsplit("/", 2)[-2],
                             "file_name": path.rsplit("/", 1)[-1]})
            names = [f.split()[0] for f in METAINFO_SCHEMA.split(", ")]
            yield pd.DataFrame(rows, columns=names)

    return listing(spark, root, "metainfo*.yaml").select("path").mapInPandas(parse, METAINFO_SCHEMA)


def run_jobs(metainfo: DataFrame) -> DataFrame:
    return metainfo.select("run", "run_id", F.explode("jobs").alias("j")).select(
        "run", "run_id", F.col("j.dataset").alias("Dataset"), F.col("j.synthesizer").alias("Synthesizer"))


def run_versions(metainfo: DataFrame) -> DataFrame:
    """One version per run: of its first metainfo file."""
    return metainfo.groupBy("run").agg(F.min_by("version", "file_name").alias("version"))


# --- sinks ------------------------------------------------------------------------------------------

def append_results(rows: DataFrame, path: str) -> None:
    """Append by column name; parquet files of different columns are merged when read."""
    rows.write.mode("append").parquet(path)


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_synthetic(data: DataFrame | dict[str, DataFrame], path: str, run: str, dataset: str, synthesizer: str) -> None:
    """Synthetic tables at run=/dataset=/synthesizer=/table=, one write per table."""
    tables = data if isinstance(data, dict) else {"data": data}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/run={run}/dataset={dataset}/synthesizer={synthesizer}/table={name}")


def read_synthetic(
    spark: SparkSession, path: str, run: str, dataset: str, synthesizer: str, tables: list[str] | None = None
) -> DataFrame | dict[str, DataFrame]:
    home = f"{path}/run={run}/dataset={dataset}/synthesizer={synthesizer}"
    if tables is None:
        return spark.read.parquet(f"{home}/table=data")
    return {t: spark.read.parquet(f"{home}/table={t}") for t in tables}


# When a row was written; of the rows of a key the last one holds.
WRITTEN = "written_at"


def write_cell(rows: DataFrame, path: str) -> None:
    """Result rows, stored by dataset and synthesizer: rows of a cell that is already there are replaced.

    Only the folders of the cells in `rows` change, each when its job ends, so a write that is lost or repeated leaves
    every cell once, and cells may be written side by side.
    """
    keyed = rows.withColumns({"_dataset": F.col("Dataset"), "_synthesizer": F.col("Synthesizer")})
    writer = keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("_dataset", "_synthesizer").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return read_appended(spark, path).drop("_dataset", "_synthesizer")


def append_keyed(rows: DataFrame, path: str) -> None:
    """Add `rows` with the time of writing; nothing that is there is touched, so writers don't disturb each other."""
    rows.withColumn(WRITTEN, F.unix_micros(F.current_timestamp())).write.mode("append").parquet(path)


def read_newest(spark: SparkSession, path: str, key: str) -> DataFrame | None:
    """The last written row of each key, as it was written; None where nothing is stored yet."""
    if not exists(spark, path):
        return None
    rows = read_appended(spark, path)
    columns = [c for c in rows.columns if c != WRITTEN]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(WRITTEN, *columns)).alias("row")).select("row.*")


def write_metainfo(path: str, run: DataFrame) -> DataFrame:
    """Add or replace the row of a run (key `run_id`)."""
    append_keyed(run, path)
    return read_newest(run.sparkSession, path, "run_id")


def complete_run(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """Set the completion date of a run."""
    row = read_newest(spark, path, "run_id").where(F.col("run_id") == run_id)
    return write_metainfo(path, row.withColumn("completed_date", F.date_format(F.now(), "MM_dd_yyyy HH:mm:ss")))


def add_to_run_index(index: DataFrame | None, date: str, folder: str, spark: SparkSession) -> DataFrame:
    """The run index with one more (date, folder_name), sorted by date."""
    row = spark.createDataFrame([(date, folder)], "date string, folder_name string")
    return (row if index is None else index.unionByName(row)).orderBy("date", "folder_name")


def latest_in_index(index: DataFrame) -> DataFrame:
    return index.agg(F.max_by("folder_name", F.struct("date", "folder_name")).alias("folder_name"))
