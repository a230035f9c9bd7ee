"""Registered queries that are to do the whole of their job."""

import math

import __spark_entry__ as entry


def test_mixtures_of_both_sizes_have_ten_fits_each(spark, sf):
    rows = entry.queries()["gm_log_likelihood"](spark, sf).collect()
    assert sorted((r.components, r.seed) for r in rows) == [(k, s) for k in (10, 30) for s in range(10)]
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    for k in (10, 30):
        own = [r for r in rows if r.components == k]
        assert all(math.isfinite(r.score) and r.num_rows == lines.where("l_orderkey % 2 = 1").count() for r in own)
        assert all(math.isclose(r.mean_score, sum(x.score for x in own) / 10) for r in own)
