import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.metrics import sequences as Q


def test_intervals_of_a_busy_sequence_agree_with_a_plain_version(spark):
    rng = np.random.default_rng(2)
    rows = [(0 if i % 2 else int(rng.integers(1, 9)), int(rng.integers(0, 10**6)), float(rng.normal(5, 2))) for i in range(4000)]
    rows += [(20, 5, 1.0), (21, 0, 2.0), (21, 10, 2.0), (21, 20, 2.0), (22, None, 1.0), (None, 3, 1.0), (20, 9, None), (20, 9, float("nan"))]
    frame = spark.createDataFrame(rows, "k int, t long, v double").withColumn("ts", F.timestamp_micros("t"))
    intervals = Q.random_intervals(10, 3)
    found = {(r.key, r.interval): r for r in Q.random_interval_features(Q.micro_buckets(frame, "k", "ts", "v"), intervals).collect()}
    kept = [(k, t, v) for k, t, v in rows if None not in (k, t, v) and v == v]
    keys = {k for k, _, _ in kept}
    assert set(found) == {(k, i) for k in keys for i in range(10)}
    for k in keys:
        t, v = np.array([(t, v) for key, t, v in kept if key == k]).T
        x = (t - t.min()) / max(t.max() - t.min(), 1)
        part = np.minimum(np.floor(x * Q.BUCKETS), Q.BUCKETS - 1)
        for i, (a, b) in enumerate(intervals):
            own, r = (part >= a) & (part < b), found[k, i]
            assert r.n == own.sum()
            if not r.n:
                assert (r["mean"], r.sd, r.slope) == (None, None, None)
                continue
            assert r["mean"] == pytest.approx(v[own].mean()) and r.sd == pytest.approx(v[own].std(), abs=1e-9)
            if len(set(x[own])) > 1:
                assert r.slope == pytest.approx(np.polyfit(x[own], v[own], 1)[0], rel=1e-5, abs=1e-7)
            else:
                assert r.slope is None


def test_rows_of_a_busy_sequence_are_dealt_over_tasks(spark):
    frame = spark.range(20000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("k"), F.timestamp_micros("id").alias("ts"), F.rand(1).alias("v"))
    salt = F.pmod(F.xxhash64(F.unix_micros("ts"), "v"), F.lit(Q.SALTS))
    sizes = [r["count"] for r in frame.where("k = 0").groupBy(salt).count().collect()]
    assert len(sizes) == Q.SALTS and max(sizes) < 1.2 * 10000 / Q.SALTS


def test_a_forest_sees_a_change_in_the_middle(spark):
    ids = spark.range(120).select(F.col("id").alias("k")).crossJoin(spark.range(40).select(F.col("id").alias("i")))
    flat = ids.select("k", F.timestamp_seconds("i").alias("ts"), F.randn(3).alias("v"))
    bump = flat.withColumn("v", F.col("v") + F.when(F.second("ts").between(15, 22), 4).otherwise(0))
    assert Q.detection(flat, bump, "k", "ts", "v") < 0.2
    assert Q.detection(flat, flat.withColumn("v", F.randn(4)), "k", "ts", "v") > 0.5
