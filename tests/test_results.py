import random

import pytest
from pyspark.sql import functions as F

from mirrorframe.functions import scalar as S
from mirrorframe.operators import catalog as C
from mirrorframe.operators import jobs as J
from mirrorframe.operators import results as R
from mirrorframe.operators import subset
from mirrorframe.operators import summary as Y

ROW = "n int, Dataset string, Synthesizer string, Train_Time double, Sample_Time double, Quality_Score double, Error string"
SCORED = "Dataset string, Synthesizer string, Adjusted_Quality_Score double, Adjusted_Total_Time double"


def adjusted(spark, rows, timeout=10.0):
    found = R.adjusted_scores(spark.createDataFrame(rows, ROW), ["n"], timeout).collect()
    return {r["n"]: (r["Adjusted_Total_Time"], r["Adjusted_Quality_Score"]) for r in found}


def test_adjusted_scores(spark):
    base = (0, "A", "UniformSynthesizer", 0.5, 0.25, 0.5, None)
    rows = [
        base, (1, "A", "S1", 1.0, 2.0, 1.0, None), (2, "A", "S2", None, None, None, "Synthesizer Timeout"),
        (3, "A", "S3", None, None, None, "ValueError"), (4, "A", "S4", 1.0, None, None, "RuntimeError"),
        (5, "A", "S5", 1.0, 2.0, None, "KeyError"), (6, "B", "S1", 1.0, 2.0, 1.0, None),
    ]
    assert adjusted(spark, rows) == {
        0: (1.25, 0.5), 1: (3.5, 1.0), 2: (10.75, 0.5), 3: (0.75, 0.5), 4: (1.75, 0.5), 5: (3.75, 0.5), 6: (None, None),
    }


def test_adjusted_scores_without_usable_baseline(spark):
    rows = [(0, "A", "UniformSynthesizer", 0.5, None, 0.5, None), (1, "A", "S1", 1.0, 2.0, 1.0, None),
            (2, "B", "MultiTableUniformSynthesizer(1)", 1.0, 1.0, None, None), (3, "B", "S1", 1.0, 2.0, 1.0, None),
            (4, "B", "UniformSynthesizer", 9.0, 9.0, 0.9, None)]
    assert adjusted(spark, rows) == {0: (None, None), 1: (None, None), 2: (3.0, None), 3: (4.0, None), 4: (19.0, None)}


def test_wins(spark):
    table = {
        "A": ([.90, .80, .85], [10, 20, 15], [1, 0, 0]), "B": ([.70, .75, .60], [150, 100, 90], [0, 1, 0]),
        "C": ([.80, .80, .79], [220, 210, 200], [1, 1, 0]), "D": ([.60, .70, .65], [300, 340, 320], [1, 1, 1]),
        "E": ([.82, .82, .81], [110, 110, 105], [1, 1, 0]),
    }
    names = ["GaussianCopulaSynthesizer", "Synth1", "Synth2"]
    rows = [(d, s, q, float(t)) for d, (qs, ts, _) in table.items() for s, q, t in zip(names, qs, ts, strict=True)]
    found = {(r["Dataset"], r["Synthesizer"]): r["Win"] for r in R.wins(spark.createDataFrame(rows, SCORED), ["Synthesizer"]).collect()}
    assert found == {(d, s): w for d, (_, _, ws) in table.items() for s, w in zip(names, ws, strict=True)}


def test_missing_scores_are_on_the_frontier_but_never_win(spark):
    rows = [("A", "GaussianCopulaSynthesizer", 0.5, 1.0), ("A", "x", None, 5.0), ("A", "y", 0.9, None), ("A", "z", 0.4, 2.0)]
    judged = R.pareto_per_dataset(spark.createDataFrame(rows, SCORED))
    assert {r["Synthesizer"]: r["On_Pareto_Frontier"] for r in judged.collect()} == {
        "GaussianCopulaSynthesizer": True, "x": True, "y": True, "z": False}
    won = R.wins(spark.createDataFrame(rows, SCORED), ["Synthesizer"])
    assert {r["Synthesizer"]: r["Win"] for r in won.collect()} == {"GaussianCopulaSynthesizer": 1, "x": 0, "y": 1, "z": 0}


def test_failed_uniform_row_gives_way(spark):
    rows = [(0, "A", "MultiTableUniformSynthesizer", None, None, None, "KeyError"),
            (1, "A", "MultiTableUniformSynthesizer(1)", 20.0, 2.0, 0.5, None),
            (2, "A", "GaussianCopulaSynthesizer", 1.0, 1.0, 0.7, None), (3, "A", "GaussianCopulaSynthesizer(2)", 5.0, 5.0, 0.9, None)]
    named = spark.createDataFrame(rows, ROW).withColumn("Synthesizer", S.plain_name(F.col("Synthesizer")))
    best = {r["Synthesizer"]: (r["Train_Time"], r["Sample_Time"]) for r in R.keep_best(named, ["n"]).collect()}
    assert best == {"MultiTableUniformSynthesizer": (20.0, 2.0), "GaussianCopulaSynthesizer": (1.0, 1.0)}


def test_all_null_adjusted_scores_fall_back(spark):
    rows = [(0, "A", "x", 1.0, 2.0, 0.4, None), (1, "A", "y", 3.0, 1.0, 0.6, None), (2, "B", "x", 1.0, 1.0, 0.1, None)]
    out = R.process_results(spark.createDataFrame(rows, ROW), ["n"])
    assert {r["Synthesizer"]: (r["Adjusted_Total_Time"], r["Adjusted_Quality_Score"]) for r in out.collect()} == {
        "x": (3.0, 0.4), "y": (4.0, 0.6)}
    with pytest.raises(ValueError, match="every synthesizer"):
        R.process_results(spark.createDataFrame([rows[0], (1, "B", "y", 1.0, 1.0, 0.5, None)], ROW), ["n"], require=True)


def test_plot_data(spark):
    rows = [("A", "GaussianCopulaSynthesizer", .81, 1.1), ("B", "GaussianCopulaSynthesizer", .83, 2.2),
            ("A", "CTGANSynthesizer", .91, 3.3), ("B", "CTGANSynthesizer", .89, 4.4),
            ("A", "TVAESynthesizer", .45, 5.5), ("B", "TVAESynthesizer", .50, 6.6)]
    out = Y.plot_data(spark.createDataFrame(rows, SCORED)).orderBy("Aggregated_Time").collect()
    points = [(r["Synthesizer"], round(r["Aggregated_Time"], 8), round(r["Quality_Score"], 8), r["Pareto"], r["Marker"]) for r in out]
    assert points == [
        (None, 1.85572637, 0.76564875, True, None), ("GaussianCopula", 3.3, 0.82, True, "circle"),
        ("CTGAN", 7.7, 0.90, True, "square"), ("TVAE", 12.1, 0.475, False, "diamond"),
        (None, 21.51718086, 0.9970267, True, None)]
    one = Y.plot_data(spark.createDataFrame(rows[:2], SCORED))
    assert one.count() == 1


def test_evaluate_time(spark):
    row = spark.createDataFrame([(1.0, 3.0, 4.0, 6.0, 5.0, float("nan"))], "a double, b double, c double, d double, e double, f double")
    assert row.select(R.evaluate_time([F.col(c) for c in "abcdef"])).first()[0] == 19.0
    none = row.select(R.evaluate_time([F.lit(None).cast("double")] * 2)).first()[0]
    assert none is None


def test_upsert_best_model_and_missing_jobs(spark):
    old = spark.createDataFrame([("A", 10), ("B", 20)], "k string, v int")
    new = spark.createDataFrame([("B", 999), ("C", 30)], "k string, v int")
    assert {r["k"]: r["v"] for r in J.upsert(old, new, "k").collect()} == {"A": 10, "B": 999, "C": 30}
    rows = [("A", "GaussianCopula", .7, 1.0), ("A", "TVAE", .9, 1.0), ("B", "GaussianCopula", .8, 1.0), ("C", "CTGAN", .6, 1.0)]
    best = R.best_model(spark.createDataFrame(rows, SCORED))
    assert {r["Dataset"]: r["Best_Model"] for r in best.collect()} == {"A": "TVAE", "B": "GaussianCopula", "C": "CTGAN"}
    with pytest.raises(ValueError, match="Unknown datasets: z"):
        J.select_datasets(spark.createDataFrame([("a",)], "Dataset string"), ["a", "z"])


def test_error_counts(spark):
    rows = [(0, "D1", "x", None, None, None, "Synthesizer Timeout"), (1, "D2", "x", None, None, None, "Other"),
            (2, "D3", "x", 1.0, 1.0, 1.0, None), (3, "D2", "x", None, None, None, "Again")]
    r = R.error_counts(spark.createDataFrame(rows, ROW)).first()
    assert (r["Timeouts"], r["Errors"]) == (1, 1)


def test_schema_depth_and_branches(spark):
    edges = [("district", "account"), ("district", "client"), ("client", "disp"), ("account", "disp"), ("account", "loan"),
             ("account", "order"), ("account", "trans"), ("disp", "card")]
    frame = spark.createDataFrame([("finance", p, c) for p, c in edges] + [("x", "a", "b"), ("x", "a", "c"), ("x", "a", "c"), ("x", "a", "c"), ("x", "b", "d")],
                                  "dataset string, parent_table string, child_table string")
    catalog = spark.createDataFrame([("finance",), ("x",), ("flat",)], "dataset string")
    assert {r[0]: r[1] for r in C.schema_depth(catalog, frame).collect()} == {"finance": 4, "x": 3, "flat": 1}
    assert {r["dataset"]: (r["Num_Relationships"], r["Max_Schema_Branch"]) for r in C.relationships(frame).collect()} == {
        "finance": (8, 4), "x": (5, 4)}
    looped = spark.createDataFrame([("l", "r", "a"), ("l", "a", "b"), ("l", "b", "a")], frame.schema)
    with pytest.raises(ValueError, match="cycle"):
        C.schema_depth(spark.createDataFrame([("l",)], "dataset string"), looped)
    for rootless in ([("l", "a", "b"), ("l", "b", "a"), ("l", "b", "c")], [("l", "a", "a")]):
        with pytest.raises(ValueError, match="cycle"):
            C.schema_depth(spark.createDataFrame([("l",)], "dataset string"), spark.createDataFrame(rootless, frame.schema))


def test_schema_depth_of_long_chains_and_of_random_schemas(spark):
    rng = random.Random(3)
    edges = [("chain", f"t{i}", f"t{i + 1}") for i in range(1499)]
    # Two branches of unlike length meet again, over and over.
    for i in range(40):
        edges += [("ladder", f"n{i}", f"n{i}x"), ("ladder", f"n{i}x", f"n{i + 1}"), ("ladder", f"n{i}", f"n{i + 1}")]
    depths = {"chain": 1500, "ladder": 81, "flat": 1}
    for d in range(30):
        size = rng.randint(2, 12)
        own = {(a, b) for a in range(size) for b in range(a + 1, size) if rng.random() < 0.3}
        edges += [(f"r{d}", f"t{a}", f"t{b}") for a, b in own]
        longest = [1] * size
        for a, b in sorted(own, reverse=True):
            longest[a] = max(longest[a], longest[b] + 1)
        depths[f"r{d}"] = max(longest)
    catalog = spark.createDataFrame([(d,) for d in depths], "dataset string")
    found = C.schema_depth(catalog, spark.createDataFrame(edges, "dataset string, parent_table string, child_table string"))
    assert {r[0]: r[1] for r in found.collect()} == depths


def test_column_counts(spark):
    rows = [("d", "t1", "id", "id", True), ("d", "t1", "another_id", "id", False), ("d", "t1", "category", "categorical", False),
            ("d", "t1", "value", "numerical", False), ("d", "t2", "date", "datetime", False), ("d", "t2", "pii_col", "email", True),
            ("d", "t2", "address", "address", False)]
    r = C.metadata_counts(spark.createDataFrame(rows, "dataset string, table_name string, column_name string, sdtype string, is_primary_key boolean")).first()
    assert (r["Total_Num_Columns"], r["Total_Num_Columns_Categorical"], r["Total_Num_Columns_Numerical"], r["Total_Num_Columns_Datetime"],
            r["Total_Num_Columns_ID_NonKey"], r["Total_Num_Columns_PII"], r["Max_Num_Columns_Per_Table"]) == (7, 1, 1, 1, 1, 1, 4)


def test_column_trim():
    columns = [f"c{i}" for i in range(20)]
    assert subset.trimmed_columns(columns, ["c10", "c11", "c19"]) == ["c10", "c11", "c19", *[f"c{i}" for i in range(10)]]


def test_texts(spark):
    names = spark.createDataFrame([("CTGANSynthesizer (12)",), ("Par(1) ",), ("VanillaGANSynthesizer",), ("Own",)], "n string")
    out = names.select(S.plain_name(F.col("n")).alias("p"), S.library_of(F.col("n")).alias("l")).collect()
    assert [tuple(r) for r in out] == [("CTGANSynthesizer", "In-house"), ("Par", "In-house"), ("VanillaGANSynthesizer", "YData"), ("Own", "Other")]
    assert S.spark_pattern("%d %b %Y at %H:%M") == "dd MMM yyyy 'a''t' HH:mm"
    dates = spark.createDataFrame([("results_01_02_2026",), ("results_99_99_2026",), ("other",)], "f string")
    assert [r[0] is not None for r in dates.select(S.run_date(F.col("f"))).collect()] == [True, False, False]
