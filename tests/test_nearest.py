import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.metrics import nearest, privacy


def brute_force(real, queries, numbers, texts, bounds):
    out = []
    for q in queries:
        best = np.inf
        for r in real:
            total = 0.0
            for c in numbers:
                low, high = bounds[c]
                if q[c] is None or r[c] is None:
                    total += 0.0 if q[c] is None and r[c] is None else 1.0
                else:
                    total += min(1.0, abs(q[c] - r[c]) / (high - low))
            total += sum(q[c] != r[c] for c in texts)
            best = min(best, total / (len(numbers) + len(texts)))
        out.append(best)
    return out


@pytest.mark.parametrize(("fanout", "visits"), [(256, 50_000), (8, 7)])
def test_closest_equals_brute_force(spark, sf, fanout, visits):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("l_tax", F.when(F.col("l_tax") > 0.01, F.col("l_tax")))
    numbers, texts = ["l_quantity", "l_extendedprice", "l_tax"], ["l_returnflag", "l_linestatus"]
    real = lines.where("l_orderkey % 20 = 0").select(*numbers, *texts)
    # A third of the records are copies of one row.
    hot = real.limit(1)
    for _ in range(6):
        hot = hot.union(hot)
    real = real.union(hot).coalesce(2)
    asked = lines.where("l_orderkey % 20 = 1").select(*numbers, *texts).withColumn(
        "l_returnflag", F.when(F.col("l_quantity") == 7, F.lit("Z")).otherwise(F.col("l_returnflag")))
    space = nearest.fit_space(real, numbers, texts)
    queries = privacy.numbered_points(asked, space)
    found = nearest.closest(queries, nearest.pack(real, space, fanout), space, visits).collect()
    assert len(found) == asked.count()
    expected = brute_force(real.distinct().collect(), asked.collect(), numbers, texts, space.bounds)
    np.testing.assert_allclose(sorted(r["distance"] for r in found), sorted(expected), atol=1e-12)


def test_protection_is_zero_for_copies_and_one_for_noise(spark, sf):
    real = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey % 4 = 0")
    numbers, texts = ["l_quantity", "l_extendedprice"], ["l_returnflag"]
    same = privacy.baseline_protection(real, real, numbers, texts).collect()
    assert [r["score"] for r in same] == [0.0, 0.0]
    far = real.withColumn("l_quantity", F.col("l_quantity") + 1000)
    away = privacy.baseline_protection(real, far, numbers, texts).collect()
    assert [r["score"] for r in away] == [1.0, 1.0]
