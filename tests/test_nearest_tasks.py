"""What a task of the closest-record search holds, and which rows descend."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.metrics import nearest, privacy


def _rows(spark, n=400):
    return spark.range(n).select(
        (F.col("id") % 37).cast("double").alias("x"), (F.col("id") / 3.0).alias("y"),
        F.when(F.col("id") % 5 == 0, "a").when(F.col("id") % 5 == 1, "b").alias("c"), F.lit("k").alias("d"))


def test_a_busy_page_is_dealt_to_tasks_that_keep_a_million_rows(spark):
    candidates = spark.range(50_000).select(F.col("id").alias("q"), F.lit(0).cast("bigint").alias("node"))
    box = F.array(F.lit(0.0))
    children = spark.range(nearest.FANOUT).select("id", F.lit(0).cast("bigint").alias("parent"), box.alias("low"), box.alias("high")).withColumnRenamed("id", "node")
    left, _ = nearest._spread_visits(candidates, children, nearest.VISITS)
    most = left.groupBy("node", "salt").count().agg(F.max("count")).first()[0]
    assert most * nearest.FANOUT <= 1_300_000


def test_a_row_in_several_iterations_descends_once(spark, monkeypatch):
    real, synthetic = _rows(spark, 300), _rows(spark, 200).withColumn("y", F.col("y") + 0.1)
    asked, plain = [], nearest.closest

    def closest(queries, levels, space, visits):
        asked.append(queries.count())
        return plain(queries, levels, space, visits)

    monkeypatch.setattr(nearest, "closest", closest)
    out = privacy.baseline_protection(real, synthetic, ["x", "y"], ["c"]).collect()
    assert sorted(r["iteration"] for r in out) == [0, 1] and all(0 <= r["score"] <= 1 for r in out)
    assert asked[0] <= 2 * 200


def test_a_query_is_compared_with_few_records(monkeypatch):
    """3,000 queries, most of them between the records: all pages nearer than the record of one nearest page were hundreds of rows each."""
    rng = np.random.default_rng(3)

    def rows(n):
        return np.column_stack([rng.integers(0, 50, n) / 49, rng.random(n), rng.integers(0, 11, n) / 10, rng.integers(0, 4, n)])

    records, queries = rows(40_000), rows(3_000)
    queries[:5, 0], queries[5:9, 3] = nearest._MISSING, -1
    seen, plain = [], nearest.Block._least

    def least(self, x, q, leaf):
        seen.append(len(q) * self.leaves.shape[2])
        return plain(self, x, q, leaf)

    monkeypatch.setattr(nearest.Block, "_least", least)
    found = nearest.Block(nearest._tree_order(records, 3), 3).search(queries.T, np.full(len(queries), 2.0), 500)
    assert sum(seen) < 300 * len(queries)
    for q in range(0, len(queries), 100):
        gaps = np.minimum(np.abs(records[:, :3] - queries[q, :3]), 1).sum(axis=1) + (records[:, 3] != queries[q, 3])
        assert found[q] == pytest.approx(gaps.min() / 4, abs=1e-12)


def test_rows_do_not_travel_to_many_blocks(spark, monkeypatch):
    """Blocks hold thousands of records, and a query asks its own and the few others that reach nearer."""
    real = spark.range(20_000).select((F.rand(1) * 9).alias("x"), F.rand(2).alias("y"), F.col("id").cast("string").substr(1, 1).alias("c"))
    asked = real.select((F.col("x") + 0.001).alias("x"), "y", "c")
    space = nearest.fit_space(real, ["x", "y"], ["c"])
    blocks = nearest.pack(real, space, 32)
    visits, plain = [], nearest._searched
    monkeypatch.setattr(nearest, "_searched", lambda candidates, *rest: visits.append(candidates.count()) or plain(candidates, *rest))
    found = nearest.closest(privacy.numbered_points(asked, space), blocks, space)
    assert found.count() == 20_000 and len(blocks.nodes) >= 10
    assert visits[0] == 20_000 and visits[1] < 2_000


def test_no_records_and_no_queries(spark):
    rows = _rows(spark, 50)
    space = nearest.fit_space(rows, ["x", "y"], ["c"])
    some = privacy.numbered_points(rows, space)
    assert {r["distance"] for r in nearest.closest(some, nearest.pack(rows.limit(0), space), space).collect()} == {2.0}
    assert nearest.closest(some.limit(0), nearest.pack(rows, space), space).count() == 0
