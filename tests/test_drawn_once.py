"""Samples that a report reads several times are drawn once."""

import __spark_entry__ as entry


def test_uniform_quality_draws_its_sample_once(spark, sf):
    assert "md5" not in entry.queries()["uniform_quality"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
