import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mirrorframe.metrics import likelihood, pairs, report, shapes, validity
from mirrorframe.metrics.registry import METRICS, select_metrics
from mirrorframe.plans import views as V
from mirrorframe.sources.metadata import infer_table


def test_ks_on_hot_columns_in_slices(spark, sf):
    real, synthetic = V.real_and_synthetic(spark, sf)
    synthetic = synthetic.withColumn("l_quantity", F.when(F.col("l_orderkey") % 3 == 1, 7.0).otherwise(F.col("l_quantity")))
    one = shapes.ks_complement(real, synthetic, V.NUMERIC).collect()
    many = shapes.ks_complement(real, synthetic, V.NUMERIC, window_rows=50).collect()
    assert {r["column"]: round(r["score"], 12) for r in one} == {r["column"]: round(r["score"], 12) for r in many}


def test_chi_square_tail():
    # Textbook quantiles: P(X >= 3.841) with 1 degree, 18.307 with 10, 124.342 with 100.
    for dof, x in ((1, 3.841458820694124), (10, 18.307038053275146), (100, 124.34211340400407)):
        assert shapes.upper_gamma(dof / 2, x / 2) == pytest.approx(0.05, abs=1e-9)
    assert shapes.upper_gamma(5, 0) == 1.0 and shapes.upper_gamma(0.5, 400) < 1e-100


def test_identical_tables_score_one(spark, sf):
    data = V.table(spark, sf, "customer")
    table = infer_table(data, "c_custkey")
    assert report.overall(report.quality_report(data, data, table)) == pytest.approx(1.0)
    assert report.overall(report.diagnostic_report(data, data, table)) == pytest.approx(1.0)
    new = validity.new_row_synthesis(data, data, ["c_name", "c_mktsegment"], ["c_acctbal"]).first()["score"]
    assert new == 0.0
    assert validity.structure(data, data.withColumn("c_acctbal", F.col("c_acctbal").cast("string"))) == pytest.approx(4 / 6)


def test_missing_values_do_not_break_shapes(spark):
    real = spark.createDataFrame([(1.0, "a"), (None, None), (float("nan"), "b")], "x double, t string")
    made = spark.createDataFrame([(1.0, "a"), (2.0, "z")], "x double, t string")
    assert shapes.ks_complement(real, made, ["x"]).first()["score"] == 0.5
    assert shapes.tv_complement(real, made, ["t"]).first()["score"] == 0.5
    assert validity.boundary_adherence(real, made, ["x"]).first()["score"] == 0.5
    assert validity.category_adherence(real, made, ["t"]).first()["score"] == 0.5


def test_dependency_tree_follows_the_strongest_link(spark):
    rows = spark.range(4000).select(
        F.pmod(F.xxhash64("id"), F.lit(4)).cast("string").alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(3)).cast("string").alias("b"))
    rows = rows.withColumn("c", F.concat(F.lit("c"), F.col("a")))
    assert likelihood.dependency_tree(rows, ["a", "b", "c"])[1] == ("a", "c")
    alike = likelihood.bn_log_likelihood(rows, rows, ["a", "b", "c"]).first()["score"]
    shuffled = rows.withColumn("c", F.concat(F.lit("c"), F.pmod(F.xxhash64("a", "b", F.rand(1)), F.lit(4)).cast("string")))
    assert alike > likelihood.bn_log_likelihood(rows, shuffled, ["a", "b", "c"]).first()["score"]


def test_mixture_likelihood_prefers_the_real_data(spark, sf):
    real, _ = V.real_and_synthetic(spark, sf)
    far = real.withColumn("l_quantity", F.col("l_quantity") + 60)
    near, away = (likelihood.gm_log_likelihood(real, d, ["l_quantity", "l_tax"], 3, 1, 5)[0] for d in (real, far))
    assert near > away


def test_constant_columns_have_no_correlation(spark):
    rows = spark.range(50).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("k"))
    assert pairs.correlation_similarity(rows, rows, ["x", "k"]).first()["score"] is None


def test_metric_selection():
    assert [m.name for m, _ in select_metrics([], "single_table")] == ["CSTest", "KSComplement"]
    (metric, kwargs), = select_metrics([("NewRowSynthesis", {"synthetic_sample_size": 10})], "single_table")
    assert metric is METRICS["single_table"]["NewRowSynthesis"] and kwargs == {"synthetic_sample_size": 10}
    with pytest.raises(ValueError, match="Unknown multi_table metric"):
        select_metrics(["Nope"], "multi_table")
    assert METRICS["single_table"]["LinearRegression"].normalize(1.0) == 1.0
    assert METRICS["single_table"]["GMLogLikelihood"].normalize(0.0) == 0.5


def _row_is_new(row, real, tolerances):
    def close(a, b, most):
        return (a is None and b is None) or (a is not None and b is not None and abs(a - b) <= most)
    return not any(row[0] == r[0] and all(close(a, b, m) for a, b, m in zip(row[1:], r[1:], tolerances)) for r in real)


def test_new_rows_agree_with_brute_force(spark):
    draw = random.Random(5)
    def rows(n):
        crowd = [("t", 3.0 + draw.random() / 40, 50 + draw.random() * 2, 0.5, 1.0, 7.0) for _ in range(n)]
        spread = [(draw.choice(["t", "u", None]), draw.choice([None, draw.random() * 8, 4.0]), draw.random() * 100, draw.choice([0.0, -0.0, 0.5, 1.0]), 1.0, draw.choice([7.0, 7.25])) for _ in range(n)]
        return crowd + spread
    real, made = rows(150), rows(150) + [("t", 1e300, 5.0, 0.5, 1.0, 7.0), ("t", 3.0, 50.0, 0.5, 2.0, 7.0)]
    real += [("edge", 0.0, 0.0, 0.0, 1.0, 7.0), ("edge", 8.0, 100.0, 1.0, 1.0, 7.0)]
    made += [("edge", 0.08, 1.0, 0.01, 1.0, 7.0), ("edge", 7.9, 100.0, 1.0, 1.0, 7.0), ("edge", 7.93, 99.1, 1.0, 1.0, 7.0)]
    schema = "t string, a double, b double, c double, k double, e double"
    for tolerance in (0.01, 0.003):
        spans = [[r[i] for r in real if r[i] is not None] for i in range(1, 6)]
        most = [(max(s) - min(s)) * tolerance for s in spans]
        want = sum(_row_is_new(r, real, most) for r in made) / len(made)
        got = validity.new_row_synthesis(spark.createDataFrame(real, schema), spark.createDataFrame(made, schema), ["t"], ["a", "b", "c", "k", "e"], tolerance).first()["score"]
        assert got == pytest.approx(want) and 0.1 < want < 0.9


def test_new_rows_across_a_cell_edge_and_without_rows(spark):
    real = spark.createDataFrame([(0.0,), (1.0,), (0.4999,)], "x double")
    score = lambda made, tolerance=0.01: validity.new_row_synthesis(real, spark.createDataFrame(made, "x double"), [], ["x"], tolerance).first()["score"]
    assert score([(0.5001,), (0.4901,), (0.52,), (None,)]) == 0.5
    assert score([(1.0,), (0.9999,)], 0.0) == 0.5
    assert score([]) is None


def test_pair_tallies_of_narrow_and_wide_columns(spark):
    draw = random.Random(9)
    rows = [(draw.choice(["a", "b", None]), str(i // 12_000 * 50 + draw.randrange(50)), str(draw.randrange(900)), "k") for i in range(36_000)]
    frame = spark.createDataFrame(rows, "a string, grows string, wide string, k string").coalesce(1)
    asked = [("a", "grows"), ("a", "wide"), ("grows", "wide"), ("k", "a")]
    found = pairs.pair_tallies(frame, asked).groupBy("pair", "value_a", "value_b").agg(F.sum("n").alias("n")).collect()
    place = {"a": 0, "grows": 1, "wide": 2, "k": 3}
    want = Counter((p, r[place[a]], r[place[b]]) for r in rows for p, (a, b) in enumerate(asked))
    assert {(r.pair, r.value_a, r.value_b): r.n for r in found} == want
    assert pairs.pair_tallies(frame.limit(0), asked).count() == 0
