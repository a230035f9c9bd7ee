"""Datasets: metadata scan, listing, loading, and landing of zipped CSV archives.

Layout below a root: `<modality>/<dataset>/metadata.json`, `metainfo.yaml`, `data.zip`, and after landing
`tables/<table>/` as parquet.
"""

from __future__ import annotations

import csv
import io
import json
from zipfile import ZipFile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions import scalar as S
from mirrorframe.operators import jobs as J
from mirrorframe.operators import subset
from mirrorframe.sources.files import batches, children, exists, listing, opened
from mirrorframe.sources.metadata import MODALITIES, Metadata, metadata_from_dict, schema_of

_COLUMN = "struct<sdtype:string,pii:boolean,datetime_format:string,computer_representation:string>"
_TABLE = (
    f"struct<columns:map<string,{_COLUMN}>,primary_key:string,alternate_keys:array<string>,"
    "sequence_key:string,sequence_index:string>"
)
_EDGE = (
    "struct<parent_table_name:string,parent_primary_key:string,child_table_name:string,child_foreign_key:string>"
)
METADATA_SCHEMA = f"tables map<string,{_TABLE}>, relationships array<{_EDGE}>"
CSV_BATCH = 10_000


def check_modality(modality: str) -> str:
    if modality not in MODALITIES:
        raise ValueError(f"Modality must be one of {', '.join(MODALITIES)}.")
    return modality


def _metadata_files(spark: SparkSession, root: str, modality: str) -> DataFrame:
    files = (
        spark.read.schema(METADATA_SCHEMA).option("multiLine", "true").option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "metadata.json").json(f"{root}/{check_modality(modality)}")
    )
    return files.withColumn("dataset", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/metadata\.json$", 1))


def column_catalog(spark: SparkSession, root: str, modality: str) -> DataFrame:
    """One row per (dataset, table, column) of every metadata file."""
    tables = _metadata_files(spark, root, modality).select(
        "dataset", F.explode("tables").alias("table_name", "t")
    )
    rows = tables.select("dataset", "table_name", "t", F.explode("t.columns").alias("column_name", "c"))
    name = F.col("column_name")

    def is_key(key):
        return F.coalesce(name == F.col(key), F.lit(False))

    return rows.select(
        "dataset", "table_name", "column_name", F.col("c.sdtype").alias("sdtype"),
        F.coalesce("c.pii", F.lit(False)).alias("pii"), F.col("c.datetime_format").alias("datetime_format"),
        F.col("c.computer_representation").alias("computer_representation"),
        is_key("t.primary_key").alias("is_primary_key"),
        F.coalesce(F.array_contains("t.alternate_keys", name), F.lit(False)).alias("is_alternate_key"),
        is_key("t.sequence_key").alias("is_sequence_key"), is_key("t.sequence_index").alias("is_sequence_index"),
    )


def edge_catalog(spark: SparkSession, root: str, modality: str) -> DataFrame:
    """One row per relationship of every metadata file."""
    return _metadata_files(spark, root, modality).select("dataset", F.explode("relationships").alias("r")).select(
        "dataset", F.col("r.parent_table_name").alias("parent_table"), F.col("r.parent_primary_key").alias("parent_key"),
        F.col("r.child_table_name").alias("child_table"), F.col("r.child_foreign_key").alias("child_key"),
    )


def list_datasets(spark: SparkSession, root: str, modality: str) -> DataFrame:
    """(dataset_name, size_MB, num_tables); a number that does not parse is null."""
    text = spark.read.text(
        f"{root}/{check_modality(modality)}", wholetext=True, recursiveFileLookup=True, pathGlobFilter="metainfo.yaml"
    )

    def field(name):
        return F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{name}:\s*['\"]?([^'\"\r\n#]*)", 1)), F.lit(""))

    return text.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/metainfo\.yaml$", 1).alias("dataset_name"),
        S.safe_double(field("dataset-size-mb")).alias("size_MB"), S.safe_int(field("num-tables")).alias("num_tables"),
    )


def list_datasets_in(spark: SparkSession, roots: list[str], modality: str) -> DataFrame:
    """Datasets of several roots; the first root that has a name wins, an unreachable root is skipped."""
    found = None
    for priority, root in enumerate(roots):
        if not exists(spark, f"{root}/{modality}"):
            continue
        one = list_datasets(spark, root, modality).withColumn("root", F.lit(root)).withColumn("priority", F.lit(priority))
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("None of the roots can be read.")
    return J.bucket_precedence(found)


def read_metadata(spark: SparkSession, root: str, modality: str, dataset: str) -> Metadata:
    """The metadata of one dataset as a driver object."""
    path = f"{root}/{check_modality(modality)}/{dataset}/metadata.json"
    return metadata_from_dict(json.loads(spark.read.text(path, wholetext=True).first()[0]))


def land_archive(spark: SparkSession, root: str, modality: str, dataset: str, metadata: Metadata) -> None:
    """Expand a dataset's `data.zip` into one parquet table per CSV.

    A compressed stream cannot be split, so each CSV inside an archive is one task, which reads it in
    batches and never holds it whole. Declared types are applied by Spark afterwards.
    """
    home = f"{root}/{check_modality(modality)}/{dataset}"
    members = _archive_members(listing(spark, home, "*.zip"))
    for name, table in metadata.tables.items():
        columns = list(table.columns)
        raw = members.where(F.col("table_name") == name).repartition("path", "member").mapInPandas(
            _csv_reader(columns), ", ".join(f"`{c}` string" for c in columns))
        typed = raw.select(*[_typed(F.col(f.name), f.dataType).alias(f.name) for f in schema_of(table).fields])
        typed.write.parquet(f"{home}/tables/{name}")


def _archive_members(archives: DataFrame) -> DataFrame:
    """(path, member, table_name) of the CSV files in each archive, from its directory."""

    def read(frames):
        for frame in frames:
            for path in frame["path"]:
                with opened(path) as stream, ZipFile(stream) as archive:
                    names = [n for n in archive.namelist() if n.endswith(".csv")]
                yield pd.DataFrame({
                    "path": path, "member": names, "table_name": [n.rsplit("/", 1)[-1][:-4] for n in names],
                })

    return archives.select("path").mapInPandas(read, "path string, member string, table_name string")


def _csv_reader(columns: list[str]):
    def read(frames):
        for frame in frames:
            for path, member in zip(frame["path"], frame["member"], strict=True):
                with opened(path) as stream, ZipFile(stream) as archive, archive.open(member) as data:
                    rows = csv.DictReader(io.TextIOWrapper(data, encoding="utf-8-sig", newline=""))
                    for batch in batches(rows, CSV_BATCH):
                        yield pd.DataFrame({c: [row.get(c) or None for row in batch] for c in columns}, dtype=object)

    return read


def _typed(text, data_type: T.DataType):
    if isinstance(data_type, T.LongType):
        # Whole numbers with gaps are often written as 3.0; others are not taken through a double.
        return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint"))
    return text.try_cast(data_type)


def csv_row_counts(archives: DataFrame) -> DataFrame:
    """(path, table_name, num_rows): non-empty records minus the header, at least 0, per CSV in each archive."""

    def count(frames):
        for frame in frames:
            for path, member, name in zip(frame["path"], frame["member"], frame["table_name"], strict=True):
                with opened(path) as stream, ZipFile(stream) as archive, archive.open(member) as data:
                    records = sum(1 for row in csv.reader(io.TextIOWrapper(data, "utf-8-sig", newline="")) if row)
                yield pd.DataFrame({"path": [path], "table_name": [name], "num_rows": [max(records - 1, 0)]})

    members = _archive_members(archives).repartition("path", "member")
    return members.mapInPandas(count, "path string, table_name string, num_rows bigint")


def load_dataset(
    spark: SparkSession, root: str, modality: str, dataset: str, limit_dataset_size: bool = False,
    row_keys: dict[str, list[str]] | None = None, seed: int = 0,
):
    """(data, metadata): one frame for a single table or sequence, a dict of frames for many tables.

    With `limit_dataset_size`, at most 10 optional columns and 1000 rows (related tables stay consistent).
    """
    metadata = read_metadata(spark, root, modality, dataset)
    home = f"{root}/{modality}/{dataset}"
    data = {}
    for name, table in metadata.tables.items():
        if exists(spark, f"{home}/tables/{name}"):
            data[name] = spark.read.schema(schema_of(table)).parquet(f"{home}/tables/{name}")
        else:
            data[name] = spark.read.schema(schema_of(table)).option("header", "true").option("multiLine", "true").option(
                "escape", '"').csv(f"{home}/{name}.csv")
    if limit_dataset_size:
        keys = row_keys or {}
        if modality == "multi_table":
            data = subset.referential_subset(data, metadata, keys, seed=seed)
        else:
            name, df = next(iter(data.items()))
            spec = metadata.tables[name]
            data = {name: subset.table_subset(df, spec, keys.get(name) or df.columns, seed=seed)}
        for name, table in metadata.tables.items():
            table.columns = {c: table.columns[c] for c in data[name].columns}
    return (data, metadata) if modality == "multi_table" else (next(iter(data.values())), metadata)


def dataset_names(spark: SparkSession, root: str, modality: str) -> DataFrame:
    return children(spark, f"{root}/{check_modality(modality)}")
