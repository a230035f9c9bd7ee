import pytest
from pyspark.sql import functions as F

from mirrorframe.metrics import report, validity
from mirrorframe.plans.synth_queries import star
from mirrorframe.sources.metadata import ColumnSpec, Metadata, TableSpec, infer_table
from mirrorframe.synth import encoder, simple
from mirrorframe.synth.base import create_synthesizer_variant
from mirrorframe.synth.copula import GaussianCopulaSynthesizer, SegmentSynthesizer
from mirrorframe.synth.registry import resolve
from mirrorframe.synth.tables import HierarchicalSynthesizer


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.range(3000).select(
        F.when(F.col("id") % 10 > 0, F.col("id") / 7).alias("num"), (F.col("id") % 9).alias("whole"),
        F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("cat"), (F.col("id") % 2 == 0).alias("flag"),
        F.timestamp_seconds(F.col("id") * 3600).alias("at"), F.lit(4.5).alias("constant"),
        F.lit(None).cast("double").alias("nothing")).coalesce(1)


def test_uniform_spreads_evenly_within_bounds(spark, mixed):
    maker = simple.UniformSynthesizer(1)
    out = maker.sample(maker.fit(mixed), 6000)
    assert out.dtypes == mixed.dtypes and out.count() == 6000
    bounds = mixed.agg(F.min("num"), F.max("num"), F.min("at"), F.max("at")).first()
    third = (bounds[1] - bounds[0]) / 3
    parts = out.groupBy(F.floor((F.col("num") - bounds[0]) / third)).count().collect()
    assert len(parts) == 3 and all(abs(p["count"] - 2000) < 200 for p in parts)
    assert out.where(~F.col("at").between(bounds[2], bounds[3])).count() == 0
    cats = {r["cat"]: r["count"] for r in out.groupBy("cat").count().collect()}
    assert set(cats) == {None, "a", "b"} and all(abs(c - 2000) < 200 for c in cats.values())
    assert {r[0] for r in out.select("whole").distinct().collect()} == set(range(9))
    again = maker.sample(maker.fit(mixed.repartition(5)), 6000)
    assert out.exceptAll(again).count() == 0


def test_quality_orders_synthesizers(spark, sf):
    data = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus", "l_shipdate")
    # Related columns, so that independence costs something.
    data = data.withColumn("l_returnflag", F.when(F.col("l_quantity") > 12, "N").otherwise(F.col("l_returnflag")))
    table, n = infer_table(data), data.count()
    scores = {}
    for maker in (simple.UniformSynthesizer(), simple.ColumnSynthesizer(), GaussianCopulaSynthesizer(), simple.IdentitySynthesizer()):
        made = maker.sample(maker.fit(data, table), n)
        assert made.dtypes == data.dtypes
        scores[maker.name] = report.overall(report.quality_report(data, made, table))
    assert scores["UniformSynthesizer"] < scores["ColumnSynthesizer"] < scores["IdentitySynthesizer"] == 1.0
    assert scores["ColumnSynthesizer"] < scores["GaussianCopulaSynthesizer"]


def test_copula_keeps_types_nulls_and_constants(spark, mixed):
    for maker in (GaussianCopulaSynthesizer(2), SegmentSynthesizer(2, segments=2), simple.ColumnSynthesizer(2)):
        out = maker.sample(maker.fit(mixed), 2000)
        assert out.schema.simpleString() == mixed.schema.simpleString() and out.count() == 2000
        r = out.agg(F.avg(F.col("num").isNull().cast("int")), F.count_distinct("constant"), F.count("nothing"),
                    F.count_distinct("cat"), F.min("num"), F.max("num")).first()
        assert abs(r[0] - 0.1) < 0.05 and r[1] == 1 and r[2] == 0 and r[3] == 2 and r[4] >= 0 and r[5] <= 3000 / 7


def test_hierarchy_has_valid_keys_and_similar_cardinality(spark, sf):
    data, metadata = star(spark, sf)
    names = ["nation", "customer", "orders"]
    part = Metadata({n: metadata.tables[n] for n in names},
                    [r for r in metadata.relationships if r.parent_table in names and r.child_table in names])
    maker = HierarchicalSynthesizer(3)
    made = maker.sample(maker.fit({n: data[n] for n in names}, part), 1.0)
    assert made["orders"].columns == data["orders"].columns
    for e in part.relationships:
        score = validity.referential_integrity(made[e.child_table], e.child_key, made[e.parent_table], e.parent_key).first()
        assert score["score"] == 1.0
    assert validity.key_uniqueness(made["orders"], "o_orderkey").first()["score"] == 1.0
    shape = validity.cardinality_shape((data["customer"], data["orders"]), (made["customer"], made["orders"]), "c_custkey", "o_custkey")
    assert shape.first()["score"] > 0.85


def test_encoder_round_trip(spark):
    rows = [(1, "x", 1.5, "01 Jan 2020", True), (2, None, None, "15 Mar 2021", None), (3, "y", 2.5, "bad", False)]
    data = spark.createDataFrame(rows, "key string, c string, v double, d string, b boolean")
    table = TableSpec({"key": ColumnSpec("id"), "c": ColumnSpec("categorical"), "v": ColumnSpec("numerical"),
                       "d": ColumnSpec("datetime", datetime_format="%d %b %Y"), "b": ColumnSpec("boolean")})
    model = encoder.fit(data, table, normal_scores=False)
    coded = encoder.encode(data, model, keep=("key",)).withColumn("id", F.col("key").cast("int") - 1)
    back = {r["id"]: r for r in encoder.decode(coded, model).collect()}
    assert [back[i]["key"] for i in range(3)] == ["key_0", "key_1", "key_2"]
    assert [back[i]["c"] for i in range(3)] == ["x", None, "y"] and [back[i]["b"] for i in range(3)] == [True, None, False]
    assert back[1]["v"] == 2.0 and back[0]["d"] == "01 Jan 2020"
    scores = encoder.fit(spark.range(1000).select(F.col("id").cast("double").alias("x")), TableSpec({"x": ColumnSpec("numerical")}))
    z = encoder.encode(spark.range(1000).select(F.col("id").cast("double").alias("x")), scores).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(z[0]) < 0.05 and abs(z[1] - 1) < 0.1


def test_names_are_checked():
    with pytest.raises(ValueError, match="Unknown synthesizer"):
        resolve(["Nope"], "single_table")
    with pytest.raises(ValueError, match="unique"):
        resolve(["UniformSynthesizer", simple.UniformSynthesizer], "single_table")
    with pytest.raises(ValueError, match="Not single_table"):
        resolve(["HierarchicalSynthesizer"], "single_table")
    assert create_synthesizer_variant("fast", simple.ColumnSynthesizer, iterations=2).name == "Variant:fast"


def test_draws_reach_rows_beyond_32_bits(spark):
    from pyspark.sql import functions as F

    from mirrorframe.functions import random as R

    drawn = spark.range(20_000).select(R.index(1, "x", F.col("id"), F.lit(2**40)).alias("i"))
    low = drawn.select(F.count_distinct(F.col("i") % 256).alias("n"), F.max("i").alias("top")).first()
    assert low["n"] == 256 and low["top"] > 2**39
