"""Rows that lie within a tolerance of another table's, through a grid that is refined only where it leaves a doubt."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions import scalar as S
from mirrorframe.session import materialize
from mirrorframe.synth.simple import as_number

# Neighbour cells are probed in so many numbers (3 to that power); the others only bound the boxes.
PROBED = 4
# Halvings of a cell before the rows themselves are compared.
HALVINGS = 12
# Cells are a little wider than the tolerance, so that rounding never puts two close values two cells apart.
SLACK = 1.0001


def points(df: DataFrame, texts: list[str], numbers: list[str], bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """(key, at, n): distinct rows and how often each is there.

    `key` holds what has to be equal: texts, which numbers are missing, and numbers that are constant in the real table.
    `at` holds the other numbers, 0 for a missing one.
    """
    values = {c: S.no_nan(as_number(df.schema, c).cast("double")) + F.lit(0.0) for c in numbers}
    close = [c for c in numbers if wide(bounds[c])]
    parts = [F.col(c).cast("string").alias(f"t{i}") for i, c in enumerate(texts)]
    parts += [(values[c].isNull() if c in close else values[c].cast("string")).alias(f"n{i}") for i, c in enumerate(numbers)]
    key = F.to_json(F.struct(*parts)) if parts else F.lit("")
    at = F.array(*[F.coalesce(values[c], F.lit(0.0)) for c in close]).cast("array<double>")
    return df.select(key.alias("key"), at.alias("at")).groupBy("key", "at").agg(F.count(F.lit(1)).alias("n"))


def wide(bound: tuple[float | None, float | None]) -> bool:
    return bound[0] is not None and bound[1] > bound[0]


def _boxes(rows: DataFrame, by: list[str], dims: int) -> DataFrame:
    edge = lambda f: F.array(*[f(F.col("at")[i]) for i in range(dims)]).cast("array<double>")
    return rows.groupBy(*by).agg(edge(F.min).alias("low"), edge(F.max).alias("high"), F.sum("n").alias("n"))


def matched_counts(made: DataFrame, known: DataFrame, lows: list[float], gaps: list[float]) -> DataFrame:
    """(n): parts of the number of `made` rows that some `known` row matches; both sides are points().

    Rows match if their keys are equal and no number differs by more than its entry of `gaps` (all above 0). Both sides are
    reduced to cells with the box of their rows. A pair of neighbour cells whose boxes are close throughout settles all
    rows of the made cell; one whose boxes are apart is dropped; only the pairs in between are cut in halves and met again, the
    last time as single rows. Rows of a crowded cell are thus never compared with all of its neighbours' rows.
    """
    dims = len(gaps)

    def cell(level: int, shown: int) -> Column:
        def place(i: int) -> Column:
            q = (F.col("at")[i] - F.lit(lows[i])) / F.lit(gaps[i] * SLACK) * F.lit(float(2**level))
            return F.floor(F.least(F.greatest(q, F.lit(-(2.0**52))), F.lit(2.0**52)))
        return F.array(*[place(i) for i in range(shown)]).cast("array<bigint>")

    def judged(pairs: DataFrame) -> DataFrame:
        """The pairs that may match, and whether all their rows do."""
        def within(a: str, b: str, c: str, d: str) -> Column:
            tests = [F.greatest(F.col(a)[i] - F.col(b)[i], F.col(c)[i] - F.col(d)[i]) <= F.lit(gaps[i]) for i in range(dims)]
            return reduce(lambda x, y: x & y, tests, F.lit(True))
        near = pairs.where(within("low", "known_high", "known_low", "high"))
        return near.select("key", "cell", "other", "n", within("high", "known_low", "known_high", "low").alias("sure"))

    def renamed(boxes: DataFrame, outer: str) -> DataFrame:
        return boxes.select("key", *([outer] if outer in boxes.columns else []), F.col("cell").alias("other"), F.col("low").alias("known_low"), F.col("high").alias("known_high"))

    probed = min(dims, PROBED)
    around = F.array(*[F.array(*[F.lit(x) for x in o]).cast("array<bigint>") for o in product((-1, 0, 1), repeat=probed)])
    start = [_boxes(side.withColumn("cell", cell(0, probed)), ["key", "cell"], dims) for side in (made, known)]
    probes = start[0].withColumn("other", F.explode(F.transform(around, lambda o: F.zip_with(F.col("cell"), o, lambda a, b: a + b))))
    pairs = materialize(judged(probes.join(renamed(start[1], ""), ["key", "other"])))
    hits = []
    for level in range(1, HALVINGS + 2):
        sure = pairs.where("sure").groupBy("key", "cell").agg(F.max("n").alias("n"))
        hits.append(sure.select("n"))
        doubt = pairs.where("not sure").join(sure, ["key", "cell"], "left_anti").select("key", F.col("cell").alias("outer"), F.col("other").alias("known_outer"))
        if level > HALVINGS or doubt.isEmpty():
            break
        above = cell(level - 1, probed if level == 1 else dims)
        inner = cell(level, dims) if level < HALVINGS else F.col("at")
        left = _boxes(made.select("key", "at", "n", above.alias("outer"), inner.alias("cell")), ["key", "outer", "cell"], dims)
        right = _boxes(known.select("key", "at", "n", above.alias("known_outer"), inner.alias("cell")), ["key", "known_outer", "cell"], dims)
        pairs = materialize(judged(doubt.join(left, ["key", "outer"]).join(renamed(right, "known_outer"), ["key", "known_outer"])))
    return reduce(DataFrame.unionByName, hits)
