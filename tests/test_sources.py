import json
import zipfile

import pytest
from pyspark.sql import functions as F

from mirrorframe.operators import catalog as C
from mirrorframe.operators import results as R
from mirrorframe.operators import summary as Y
from mirrorframe.sources import datasets as D
from mirrorframe.sources import results as SR
from mirrorframe.sources.files import listing

METADATA = {
    "tables": {
        "users": {"primary_key": "id", "columns": {"id": {"sdtype": "id"}, "name": {"sdtype": "name", "pii": True}}},
        "transactions": {
            "primary_key": "id",
            "columns": {
                "id": {"sdtype": "id"}, "user_id": {"sdtype": "id"}, "amount": {"sdtype": "numerical"},
                "units": {"sdtype": "numerical", "computer_representation": "Int64"}, "note": {"sdtype": "categorical"},
                "day": {"sdtype": "datetime", "datetime_format": "%d %b %Y"},
            },
        },
    },
    "relationships": [
        {"parent_table_name": "users", "parent_primary_key": "id", "child_table_name": "transactions", "child_foreign_key": "user_id"}
    ],
}


@pytest.fixture
def root(tmp_path):
    home = tmp_path / "multi_table" / "bank"
    home.mkdir(parents=True)
    (home / "metadata.json").write_text(json.dumps(METADATA, indent=1))
    (home / "metainfo.yaml").write_text("dataset-size-mb: 1.25\nnum-tables: two\n")
    other = tmp_path / "multi_table" / "shop"
    other.mkdir()
    (other / "metainfo.yaml").write_text("num-tables: '3'\ndataset-size-mb: n/a\n")
    with zipfile.ZipFile(home / "data.zip", "w") as archive:
        archive.writestr("users.csv", "id,name\n1,Ann\n2,\"Bob\nB.\"\n\n3,Cy\n")
        archive.writestr("in/transactions.csv", "id,user_id,amount,units,note,day\n1,1,2.5,3.0,a,01 Jan 2020\n2,1,,4,\"x, y\",bad\n3,2,1,,,\n")
        archive.writestr("readme.txt", "none")
    return str(tmp_path)


def test_listing_parses_numbers_or_null(spark, root):
    rows = {r["dataset_name"]: (r["size_MB"], r["num_tables"]) for r in D.list_datasets(spark, root, "multi_table").collect()}
    assert rows == {"bank": (1.25, None), "shop": (None, 3)}
    with pytest.raises(ValueError, match="Modality"):
        D.list_datasets(spark, root, "tables")


def test_first_root_wins_and_missing_roots_are_skipped(spark, root, tmp_path_factory):
    second = tmp_path_factory.mktemp("second")
    (second / "multi_table" / "bank").mkdir(parents=True)
    (second / "multi_table" / "bank" / "metainfo.yaml").write_text("dataset-size-mb: 9\nnum-tables: 9\n")
    found = D.list_datasets_in(spark, ["/nowhere", str(second), root], "multi_table").collect()
    assert {r["dataset_name"]: r["size_MB"] for r in found} == {"bank": 9.0, "shop": None}


def test_catalog_and_edges(spark, root):
    catalog = D.column_catalog(spark, root, "multi_table")
    edges = D.edge_catalog(spark, root, "multi_table")
    assert catalog.count() == 8
    assert catalog.where("is_primary_key").count() == 2
    counts = C.metadata_counts(catalog).first()
    assert (counts["Total_Num_Columns"], counts["Total_Num_Columns_Numerical"], counts["Total_Num_Columns_ID_NonKey"],
            counts["Total_Num_Columns_PII"], counts["Max_Num_Columns_Per_Table"]) == (8, 2, 1, 1, 6)
    assert C.schema_depth(catalog, edges).first()["Max_Schema_Depth"] == 2


def test_archive_lands_typed_and_loads(spark, root):
    metadata = D.read_metadata(spark, root, "multi_table", "bank")
    D.land_archive(spark, root, "multi_table", "bank", metadata)
    data, metadata = D.load_dataset(spark, root, "multi_table", "bank")
    assert [r["name"] for r in data["users"].orderBy("id").collect()] == ["Ann", "Bob\nB.", "Cy"]
    rows = data["transactions"].orderBy("id").collect()
    assert [(r["amount"], r["units"], r["note"]) for r in rows] == [(2.5, 3, "a"), (None, 4, "x, y"), (1.0, None, None)]
    limited, _ = D.load_dataset(spark, root, "multi_table", "bank", limit_dataset_size=True)
    assert {n: df.count() for n, df in limited.items()} == {"users": 3, "transactions": 3}
    counts = D.csv_row_counts(listing(spark, f"{root}/multi_table/bank", "*.zip"))
    assert {r["table_name"]: r["num_rows"] for r in counts.collect()} == {"users": 3, "transactions": 3}


HEADER = "Synthesizer,Dataset,Train_Time,Sample_Time,Quality_Score"


@pytest.fixture
def runs(tmp_path):
    first = tmp_path / "results_01_02_2026"
    first.mkdir()
    (first / "results.csv").write_text(
        f"{HEADER},Error\nUniformSynthesizer,A,1,1,0.5,\nGaussianCopulaSynthesizer(1),A,2,1,0.9,\n"
        "TVAESynthesizer,A,,,,\"ValueError: no\nsuch \"\"thing\"\"\"\n")
    (first / "results(1).csv").write_text(
        "Synthesizer,Dataset,Train_Time,error,Sample_Time,Quality_Score\nTVAESynthesizer,A,9,bad,1,0.1\nCTGANSynthesizer,A,5,x,1,\n")
    (first / "metainfo.yaml").write_text(
        "run_id: run_01_02_2026_0\nmodality: single_table\nstarting_date: 01_02_2026 10:00:00\n"
        "completed_date: null\nversion: 1.0.0\njobs:\n- - A\n  - TVAESynthesizer\n- - A\n  - CTGANSynthesizer\n")
    second = tmp_path / "results_12_30_2025"
    second.mkdir()
    (second / "results.csv").write_text(f"{HEADER}\nUniformSynthesizer,A,1,1,0.5\nGaussianCopulaSynthesizer,A,2,1,0.9\n")
    (tmp_path / "notes").mkdir()
    (tmp_path / "notes" / "x.txt").write_text("x")
    return str(tmp_path)


def test_result_scan_keeps_headers_apart(spark, runs):
    rows = SR.read_results(spark, runs, "results_")
    assert rows.count() == 7
    assert "error" not in rows.columns
    failed = rows.where("Error is not null").collect()
    assert [r["Error"] for r in failed] == ['ValueError: no\nsuch "thing"']
    lower = rows.where("file_no = 1").orderBy("row_no").collect()
    assert [(r["Synthesizer"], r["Sample_Time"], r["Error"]) for r in lower] == [
        ("TVAESynthesizer", 1.0, None), ("CTGANSynthesizer", 1.0, None)]


def test_runs_and_metainfo(spark, runs):
    assert SR.latest_run(spark, runs).first()[0] == "results_01_02_2026"
    assert {r["folder"] for r in SR.list_runs(spark, runs).collect()} == {"results_01_02_2026", "results_12_30_2025"}
    info = SR.read_metainfo(spark, runs)
    assert Y.runs_complete(info).first()[0] is False
    assert Y.runs_complete(info.where("false")).first()[0] is False
    assert {r["Synthesizer"] for r in SR.run_jobs(info).collect()} == {"TVAESynthesizer", "CTGANSynthesizer"}


def test_summary_over_runs(spark, runs):
    rows = SR.read_results(spark, runs, "results_")
    versions = SR.run_versions(SR.read_metainfo(spark, runs))
    summary, detail = Y.summarize_runs(rows, versions, "results_01_02_2026", ["file_no", "row_no"])
    assert summary.columns == ["Synthesizer", "01_02_2026 - # datasets: 1 - version: 1.0.0", "12_30_2025 - # datasets: 1 - version: None"]
    table = {r[0]: (r[1], r[2]) for r in summary.collect()}
    assert table == {"UniformSynthesizer": ("0", "0"), "GaussianCopulaSynthesizer": ("1", "1"),
                     "TVAESynthesizer": ("0", "-"), "CTGANSynthesizer": ("0", "-")}
    assert detail.count() == 4
    older, _ = Y.summarize_runs(rows, versions, "results_12_30_2025", ["file_no", "row_no"])
    assert older.count() == 2 and len(older.columns) == 2


def test_collect_drops_duplicates(spark, runs, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out") / "collected")
    assert SR.collect_results(spark, runs, out).count() == 6
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(out).count() == 6


def test_sinks(spark, tmp_path):
    frame = spark.createDataFrame([("A", 10), ("B", 20)], "key string, v int")
    table = str(tmp_path / "t")
    assert SR.read_newest(spark, table, "key") is None
    SR.append_keyed(frame, table)
    SR.append_keyed(spark.createDataFrame([("B", 999, "x"), ("C", 30, None)], "key string, v int, extra string"), table)
    SR.append_keyed(spark.createDataFrame([("C", None, None)], "key string, v int, extra string"), table)
    found = SR.read_newest(spark, table, "key")
    assert {r["key"]: (r["v"], r["extra"]) for r in found.collect()} == {"A": (10, None), "B": (999, "x"), "C": (None, None)}
    assert found.columns == ["key", "v", "extra"]

    # A cell written again is there once, whatever its name; others stay.
    cells, schema = str(tmp_path / "cells"), "Dataset string, Synthesizer string, Train_Time double"
    SR.write_cell(spark.createDataFrame([("2020", "a/b:c=1", 1.0)], schema), cells)
    SR.write_cell(spark.createDataFrame([("d", "x", 2.0)], schema), cells)
    SR.write_cell(spark.createDataFrame([("2020", "a/b:c=1", 3.0, "late")], schema + ", Error string"), cells)
    assert sorted(tuple(r) for r in SR.read_cells(spark, cells).select("Dataset", "Synthesizer", "Train_Time", "Error").collect()) == [
        ("2020", "a/b:c=1", 3.0, "late"), ("d", "x", 2.0, None)]

    SR.append_results(frame, str(tmp_path / "r"))
    SR.append_results(frame.withColumn("extra", F.lit(1.5)), str(tmp_path / "r"))
    assert SR.read_appended(spark, str(tmp_path / "r")).where("extra is null").count() == 2

    SR.write_synthetic({"x": frame, "y": frame}, str(tmp_path / "s"), "r1", "d1", "m1")
    back = SR.read_synthetic(spark, str(tmp_path / "s"), "r1", "d1", "m1", ["x", "y"])
    assert back["y"].count() == 2

    runs = str(tmp_path / "runs")
    SR.write_metainfo(runs, spark.createDataFrame([("run_1", None), ("run_2", None)], "run_id string, completed_date string"))
    done = {r["run_id"]: r["completed_date"] for r in SR.complete_run(spark, runs, "run_1").collect()}
    assert len(done) == 2 and done["run_1"] and done["run_2"] is None

    index = SR.add_to_run_index(None, "2026-02-01", "f2", spark)
    index = SR.add_to_run_index(index, "2026-01-01", "f1", spark)
    assert [r["folder_name"] for r in index.collect()] == ["f1", "f2"]
    assert SR.latest_in_index(index).first()[0] == "f2"


def test_process_results_without_error_column(spark):
    rows = spark.createDataFrame([("UniformSynthesizer", "A", 1.0, 1.0, 0.5, 0)],
                                 "Synthesizer string, Dataset string, Train_Time double, Sample_Time double, Quality_Score double, n int")
    assert R.process_results(rows, ["n"]).first()["Adjusted_Total_Time"] == 3.0


def test_whole_numbers_keep_all_digits(spark):
    from pyspark.sql import types as T

    rows = spark.createDataFrame([("9007199254740993",), ("3.0",), ("x",), ("",)], "a string")
    found = [r[0] for r in rows.select(D._typed(F.col("a"), T.LongType())).collect()]
    assert found == [9007199254740993, 3, None, None]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_folders_whose_names_look_like_patterns(spark, tmp_path, scheme):
    from mirrorframe.sources.files import children

    home = tmp_path / "a (1)+ $x.d"
    for name in ("one", "t wo"):
        (home / name).mkdir(parents=True)
        (home / name / "f.csv").write_text("a\n1\n")
    assert {r["name"] for r in children(spark, f"{scheme}{home}").collect()} == {"one", "t wo"}
