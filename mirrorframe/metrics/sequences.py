"""Sequences: interval features per entity, and forests that classify or tell apart sequences."""

from __future__ import annotations

import random

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions import scalar as S

# Random intervals of a forest, the equal stretches of a sequence's time that they are made of, and the keys that the
# rows of a sequence are dealt over.
INTERVALS = 24
BUCKETS = 64
SALTS = 16
STATISTICS = ("mean", "sd", "slope")


def interval_features(
    df: DataFrame, key: str, index: str, value: str, intervals: int = 4
) -> DataFrame:
    """Mean, deviation and slope of `value` in equal time intervals of each sequence.

    Intervals come from the sequence's first and last time, so nothing is sorted and a long sequence is
    summed up where it is read. The slope is per interval length.
    """
    timed = df.select(F.col(key).alias("key"), S.to_micros(F.col(index)).alias("t"), F.col(value).cast("double").alias("v"))
    spans = timed.groupBy("key").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    where = (F.col("t") - F.col("t0")).cast("double") / F.greatest(F.col("t1") - F.col("t0"), F.lit(1)).cast("double") * intervals
    placed = timed.join(spans, "key").select("key", "v", where.alias("x"), F.least(F.floor(where), F.lit(intervals - 1)).cast("int").alias("interval"))
    return placed.groupBy("key", "interval").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd"), S.slope(F.col("v"), F.col("x")).alias("slope"),
        F.count(F.lit(1)).alias("n"),
    )


def micro_buckets(df: DataFrame, key: str, index: str, value: str, buckets: int = BUCKETS, salts: int = SALTS) -> DataFrame:
    """(key, parts): per sequence, what is needed of each of `buckets` equal stretches of its time, in order.

    A part holds the number `n` of rows, the sums `x` of their places in time (0 to 1) and `v` of their values, and the sums
    `xx`, `vv` and `xv` of squared and joint deviations from the part's means. Rows without a time or value are left out.
    Tasks sum up what they read, so a busy sequence leaves each with at most `buckets` rows; to learn a sequence's
    first and last time its rows are dealt over `salts` keys.
    """
    timed = df.select(
        F.col(key).alias("key"), S.to_micros(F.col(index)).alias("t"), S.no_nan(F.col(value).cast("double")).alias("v")
    ).where("key is not null and t is not null and v is not null")
    spans = timed.groupBy("key").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    spans = spans.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = timed.withColumn("salt", F.pmod(F.xxhash64("t", "v"), F.lit(salts)).cast("int")).join(spans, ["key", "salt"])
    place = (F.col("t") - F.col("t0")).cast("double") / F.greatest(F.col("t1") - F.col("t0"), F.lit(1)).cast("double")
    placed = dealt.select("key", "v", place.alias("x")).withColumn("part", F.least(F.floor(F.col("x") * buckets), F.lit(buckets - 1)).cast("int"))
    sums = placed.groupBy("key", "part").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum("v").alias("v"), (F.var_pop("x") * F.count(F.lit(1))).alias("xx"),
        (F.var_pop("v") * F.count(F.lit(1))).alias("vv"), (F.covar_pop("x", "v") * F.count(F.lit(1))).alias("xv"),
    )
    return sums.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "n", "x", "v", "xx", "vv", "xv"))).alias("parts"))


def random_intervals(number: int, seed: int, buckets: int = BUCKETS) -> list[tuple[int, int]]:
    """Stretches [begin, end) of buckets, drawn from a seed; at least two buckets long."""
    rng = random.Random(seed)
    return [tuple(sorted(rng.sample(range(0, buckets + 1, 2), 2))) for _ in range(number)]


def random_interval_features(parts: DataFrame, intervals: list[tuple[int, int]]) -> DataFrame:
    """(key, interval, n, mean, sd, slope): of each sequence's rows in each interval, all made from its one row of `parts`.

    `slope` is that of the value over the whole of the sequence's time. Without rows in an interval only `n` is not null, and
    where all of them are at one time there is no slope.
    """
    known = F.array(*[F.struct(F.lit(i).alias("interval"), F.lit(a).alias("a"), F.lit(b).alias("b")) for i, (a, b) in enumerate(intervals)])
    each = parts.select("key", "parts", F.explode(known).alias("k")).select(
        "key", F.col("k.interval").alias("interval"), F.filter("parts", lambda p: (p["part"] >= F.col("k.a")) & (p["part"] < F.col("k.b"))).alias("in"))

    def summed(term) -> Column:
        return F.aggregate("in", F.lit(0.0), lambda total, p: total + term(p))

    first = each.withColumn("n", summed(lambda p: p["n"]))
    means = first.withColumns({c: F.try_divide(summed(lambda p, c=c: p[c]), F.col("n")) for c in ("x", "v")})
    joint = lambda a, b: summed(lambda p: p[a + b] + p["n"] * (p[a] / p["n"] - F.col(a)) * (p[b] / p["n"] - F.col(b)))
    spread = means.withColumns({a + b: joint(a, b) for a, b in (("x", "x"), ("v", "v"), ("x", "v"))})
    return spread.select(
        "key", "interval", F.col("n").cast("bigint").alias("n"), F.col("v").alias("mean"),
        F.sqrt(F.try_divide("vv", "n")).alias("sd"), F.when(F.col("xx") > 1e-18, F.col("xv") / F.col("xx")).alias("slope"),
    )


def feature_table(df: DataFrame, key: str, index: str, value: str, intervals: int = INTERVALS, seed: int = 17) -> DataFrame:
    """One row per sequence with the statistics of random intervals of its time; what an interval lacks is 0."""
    long = random_interval_features(micro_buckets(df, key, index, value), random_intervals(intervals, seed))
    wide = [F.coalesce(F.max(F.when(F.col("interval") == i, F.col(s))), F.lit(0.0)).alias(f"{s}_{i}")
            for i in range(intervals) for s in STATISTICS]
    return long.groupBy("key").agg(*wide)


def _vectors(df: DataFrame, intervals: int) -> DataFrame:
    names = [f"{s}_{i}" for i in range(intervals) for s in STATISTICS]
    return VectorAssembler(inputCols=names, outputCol="features").transform(df)


def classifier_efficacy(
    real: DataFrame, synthetic: DataFrame, labels: tuple[DataFrame, DataFrame], key: str, index: str, value: str,
    intervals: int = INTERVALS,
) -> float:
    """F1 on real sequences of a forest trained on synthetic ones; `labels` are (key, label) per side."""
    sides = [
        _vectors(feature_table(df, key, index, value, intervals).join(known.select(F.col(key).alias("key"), F.col("label").cast("string").alias("_l")), "key"), intervals)
        for df, known in zip((real, synthetic), labels, strict=True)
    ]
    indexer = StringIndexer(inputCol="_l", outputCol="y", handleInvalid="keep").fit(sides[1])
    model = RandomForestClassifier(labelCol="y", seed=17, numTrees=30).fit(indexer.transform(sides[1]))
    scored = model.transform(indexer.transform(sides[0]))
    return float(MulticlassClassificationEvaluator(labelCol="y", metricName="f1").evaluate(scored))


def detection(
    real: DataFrame, synthetic: DataFrame, key: str, index: str, value: str, intervals: int = INTERVALS
) -> float:
    """1 when a forest cannot tell real from synthetic sequences, 0 when it always can (held-out third)."""
    both = feature_table(real, key, index, value, intervals).withColumn("y", F.lit(1.0)).unionByName(
        feature_table(synthetic, key, index, value, intervals).withColumn("y", F.lit(0.0)))
    rows = _vectors(both, intervals).withColumn("fold", F.pmod(F.xxhash64("key", "y"), F.lit(3)))
    model = RandomForestClassifier(labelCol="y", seed=17, numTrees=30).fit(rows.where("fold > 0"))
    area = BinaryClassificationEvaluator(labelCol="y").evaluate(model.transform(rows.where("fold = 0")))
    return 1.0 - max(0.0, 2 * area - 1)
