"""What a task of the copulas keeps busy, and which numbers are drawn."""

import math

from pyspark.sql import functions as F

from mirrorframe.synth.copula import fit_scored, sample_copula


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(spark, n=400):
    return spark.range(n).select(
        (F.col("id") % 37).cast("double").alias("x"), (F.col("id") / 3.0).alias("y"),
        F.when(F.col("id") % 5 == 0, "a").when(F.col("id") % 5 == 1, "b").alias("c"), F.lit("k").alias("d"))


def test_scores_of_a_copula_take_one_python_process_a_task(spark):
    data = _rows(spark)
    model, scored = fit_scored(data.withColumn("_segment", F.lit(0)), data.schema, ("x",))
    plan = _plan(scored)
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan
    rows = scored.collect()
    assert len(rows) == 400 and all(math.isfinite(r[c]) for r in rows for c in ("x", "y", "c", "d"))
    assert {r["_keep_x"] for r in rows} == set(map(float, range(37)))


def test_only_columns_with_nulls_draw_for_them(spark):
    data = _rows(spark).withColumn("z", F.when(F.col("x") > 3, F.col("y")))
    model, _ = fit_scored(data.withColumn("_segment", F.lit(0)), data.schema)
    out = sample_copula(model, spark.range(2000), 1)
    assert "z#null" in _plan(out) and "x#null" not in _plan(out) and "MapInPandas" not in _plan(out)
    found = out.agg(F.count("x").alias("x"), F.count("y").alias("y"), F.count("z").alias("z")).first()
    assert found["x"] == found["y"] == 2000 and abs(found["z"] - 2000 * 33 / 37) < 150
