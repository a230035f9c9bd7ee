"""Privacy: is synthetic data further from the real rows than random data is?"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions import random as rnd
from mirrorframe.metrics import nearest
from mirrorframe.session import materialize
from mirrorframe.synth.simple import UniformSynthesizer

# Share of rows per iteration and number of iterations.
SUBSAMPLE = 0.6
ITERATIONS = 2
MEDIAN_ACCURACY = 100_000


def numbered_points(df: DataFrame, space: nearest.Space) -> DataFrame:
    """Query rows (q, p), written once so that numbers and rows stay together."""
    return materialize(nearest.points(df, space).withColumn("q", F.monotonically_increasing_id()))


def baseline_protection(
    real: DataFrame,
    synthetic: DataFrame,
    numbers: list[str],
    texts: list[str],
    share: float = SUBSAMPLE,
    iterations: int = ITERATIONS,
    fanout: int = nearest.FANOUT,
    visits: int = nearest.VISITS,
) -> DataFrame:
    """Median distance to the closest real row, of synthetic and of uniform random rows, and their ratio
    capped at 1; one row per iteration, the mean of `score` is the result."""
    real, synthetic = real.select(*numbers, *texts), synthetic.select(*numbers, *texts)
    space = nearest.fit_space(real, numbers, texts)
    levels = nearest.pack(real, space, fanout)
    maker = UniformSynthesizer("privacy")
    random = maker.sample(maker.fit(real), synthetic.count())
    # Both kinds descend together; the remainder of a query's number tells them apart. A row that several iterations draw
    # descends once: which ones do is a function of its number.
    kinds = ("synthetic", "random")
    base = {"synthetic": numbered_points(synthetic, space), "random": numbered_points(random, space)}

    def drawn(kind, number):
        return [rnd.uniform(f"{kind}.{i}", "subsample", number) < share for i in range(iterations)]

    queries = None
    for tag, kind in enumerate(kinds):
        chosen = base[kind].where(reduce(or_, drawn(kind, F.col("q"))))
        chosen = chosen.select((F.col("q") * len(kinds) + tag).alias("q"), "p")
        queries = chosen if queries is None else queries.unionByName(chosen)
    tag, number = F.pmod(F.col("q"), F.lit(len(kinds))), F.floor(F.col("q") / len(kinds)).cast("bigint")
    within = {kind: F.array(*[F.when(d, F.lit(i)) for i, d in enumerate(drawn(kind, number))]) for kind in kinds}
    found = nearest.closest(queries, levels, space, visits).select(
        F.when(tag == 0, kinds[0]).otherwise(kinds[1]).alias("kind"), "distance",
        F.when(tag == 0, within[kinds[0]]).otherwise(within[kinds[1]]).alias("_in"))
    rows = found.select("kind", "distance", F.explode(F.array_compact("_in")).alias("iteration"))

    def median(kind):
        return F.percentile_approx(F.when(F.col("kind") == kind, F.col("distance")), 0.5, MEDIAN_ACCURACY)

    medians = rows.groupBy("iteration").agg(
        median("synthetic").alias("synthetic_median"), median("random").alias("random_median"))
    ratio = F.when(F.col("random_median") > 0, F.least(F.col("synthetic_median") / F.col("random_median"), F.lit(1.0)))
    return medians.withColumn("score", ratio)
