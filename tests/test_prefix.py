from pyspark.sql import functions as F

from mirrorframe.operators import prefix
from mirrorframe.operators.prefix import Running
from mirrorframe.synth import lookup


def test_ranged_path_equals_one_window(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    # One group holds a third of the rows.
    rows = lines.select(
        F.when(F.col("l_orderkey") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("l_suppkey") % 5)).alias("g"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("k"), "l_extendedprice",
        F.when(F.col("l_quantity") > 10, F.col("l_quantity")).alias("q"))
    specs = [Running("s", "sum", "q"), Running("before", "max", "l_extendedprice", inclusive=False), Running("low", "min", "q")]
    one = prefix.running(rows, ["g"], [F.col("k")], specs)
    many = prefix.running(rows, ["g"], [F.col("k")], specs, window_rows=100)
    assert one.count() == lines.count()
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    a = prefix.numbered(rows.select("k"), [], [F.col("k")])
    b = prefix.numbered(rows.select("k"), [], [F.col("k")], window_rows=500)
    assert a.exceptAll(b).count() == 0 and a.agg(F.max("idx")).first()[0] == lines.count() - 1


def test_hash_numbers_are_dense_and_null_comes_first(spark):
    values = spark.range(5000).select(F.concat(F.lit("v"), "id").alias("v")).union(spark.sql("select cast(null as string)"))
    rows = prefix.hash_numbered(values, [], "v")
    assert rows.where("v is null").first()["idx"] == 0
    assert rows.agg(F.count_distinct("idx"), F.min("idx"), F.max("idx")).first() == (5001, 0, 5000)


def test_range_lookup_is_exact_under_skew(spark):
    values = spark.range(3000).select(
        F.lit("c").alias("column"), F.col("id").cast("string").alias("value"),
        F.when(F.col("id") == 7, 30_000).otherwise(F.col("id") % 5 + 1).cast("bigint").alias("n"))
    ranges, sizes = lookup.frequency_ranges(values, ["column"])
    (total, distinct), = sizes.values()
    every = spark.range(total).select("id", F.col("id").alias("d"))
    found = lookup.range_lookup(every, "d", ranges, total, distinct, "v")
    counted = found.groupBy("v").count()
    assert found.count() == total
    assert counted.join(values, F.col("v") == F.col("value")).where("count <> n").count() == 0


def test_long_ranges_are_split(spark):
    rows = spark.createDataFrame([(1, 5, 4), (2, 0, 200_000), (3, 9, 9)], "k int, a long, b long")
    out = lookup.explode_range(rows, F.col("a"), F.col("b"), "i", longest=200_001)
    assert {r["k"]: r["n"] for r in out.groupBy("k").agg(F.count_distinct("i").alias("n")).collect()} == {2: 200_001, 3: 1}


def test_large_domains_are_joined_with_the_same_result(spark, monkeypatch):
    names = spark.range(500).select(F.concat(F.lit("n"), F.col("id") % 200).alias("name"))
    table, sizes = lookup.domains(names, ["name"])
    draws = spark.range(1000).select("id", (F.col("id") % sizes["name"]).alias("name"))
    small = lookup.pick(draws, "name", table, "name", sizes["name"], "name")
    monkeypatch.setattr(lookup, "SMALL_DOMAIN", 10)
    large = lookup.pick(draws, "name", table, "name", sizes["name"], "name")
    assert small.exceptAll(large.select(*small.columns)).count() == 0 and large.count() == 1000
