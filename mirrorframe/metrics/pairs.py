"""Column pairs: correlations, contingency tables and mutual information."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions import scalar as S
from mirrorframe.metrics.shapes import share
from mirrorframe.session import spread
from mirrorframe.synth.simple import as_number

BINS = 10
# Values of a column up to which a task counts its pairs in matrices (32 KB a pair).
NARROW = 64
# Rows that wait to be counted for each pair with a wider column, and different pairs of values that a task holds of all such pairs.
WAITING = 1 << 17
HELD = 1 << 20
# Bins that a long holds, four bits each, and the one that stands for null.
PACKED, NO_BIN = 15, 15


def correlation_similarity(
    real: DataFrame, synthetic: DataFrame, columns: list[str], pairs: list[tuple[str, str]] | None = None
) -> DataFrame:
    """1 minus half the difference of Pearson correlations; all pairs in one aggregation per side.

    Each side is added up by itself: a side that is the same as the other is read once, by Spark's reuse of exchanges.
    """
    pairs = pairs or list(combinations(columns, 2))

    def added(df):
        numbers = df.select(F.lit(0).alias("one"), *[S.no_nan(as_number(df.schema, c).cast("double")).alias(c) for c in columns])
        return numbers.groupBy("one").agg(F.array(*[
            F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), S.correlation(F.col(a), F.col(b)).alias("rho")) for a, b in pairs
        ]).alias("all"))

    rows = added(real).withColumn("side", F.lit("real")).unionByName(added(synthetic).withColumn("side", F.lit("synthetic")))
    flat = rows.select("side", F.explode("all").alias("p")).select("side", "p.*")
    rho = {s: F.max(F.when(F.col("side") == s, S.no_nan(F.col("rho")))) for s in ("real", "synthetic")}
    return flat.groupBy("column_a", "column_b").agg(
        (1.0 - F.abs(rho["real"] - rho["synthetic"]) / 2).alias("score")
    )


def numeric_bounds(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """[min, max] per column: one row of two numbers per column."""
    return bounds_of({"": (df, columns)})[""]


def bounds_of(tables: dict[str, tuple[DataFrame, list[str]]]) -> dict[str, dict[str, tuple[float, float]]]:
    """Bounds of the columns of several tables in one job."""
    frames = None
    for name, (df, columns) in tables.items():
        if not columns:
            continue
        value = {c: S.no_nan(as_number(df.schema, c).cast("double")) for c in columns}
        one = df.agg(F.array(*[F.struct(F.lit(c).alias("column"), F.min(v).alias("lo"), F.max(v).alias("hi"))
                               for c, v in value.items()]).alias("all")).select(F.lit(name).alias("name"), "all")
        frames = one if frames is None else frames.unionByName(one)
    found = {name: {} for name in tables}
    for row in frames.collect() if frames is not None else []:
        found[row["name"]] = {b["column"]: (b["lo"], b["hi"]) for b in row["all"]}
    return found


def _bin(df: DataFrame, column: str, bounds: tuple[float, float]) -> Column:
    """Ten equal bins over the real range, from 1, and two outer ones for values beyond it."""
    low, high = bounds
    value = S.no_nan(as_number(df.schema, column).cast("double"))
    if low is None:
        return F.lit(None).cast("int")
    width = (high - low) / BINS
    inside = F.least(F.floor((value - low) / width), F.lit(BINS - 1)) + 1 if width > 0 else F.lit(1)
    bin_no = F.when(value < low, F.lit(0)).when(value > high, F.lit(BINS + 1)).otherwise(inside)
    return F.when(value.isNotNull(), bin_no.cast("int"))


def binned(df: DataFrame, column: str, bounds: tuple[float, float]) -> Column:
    """The bin as text."""
    return _bin(df, column, bounds).cast("string")


def packed_bins(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> list[Column]:
    """The bins of the columns of `bounds`, in whole numbers of PACKED bins each."""
    names, out = list(bounds), []
    for start in range(0, len(names), PACKED):
        bins = [F.coalesce(_bin(df, c, bounds[c]), F.lit(NO_BIN)).cast("bigint") for c in names[start : start + PACKED]]
        packed = bins[0]
        for place, one in enumerate(bins[1:], 1):
            packed = packed.bitwiseOR(F.shiftleft(one, 4 * place))
        out.append(packed)
    return out


def discretized(df: DataFrame, texts: list[str], bounds: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in texts],
                     *[binned(df, c, b).alias(c) for c, b in bounds.items()])


def pair_tallies(df: DataFrame, pairs: list[tuple[str, str]], packed: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """(pair, value_a, value_b, n): partial joint counts of text columns; `pair` is a position in `pairs`.

    Names in `packed` are bins: the column of `packed_bins` that holds them, and the place in it.

    Each task counts its rows in a matrix a pair and emits the matrices once, instead of a row for each pair of each row.
    A column with more than NARROW values in a task would make its matrices large; the codes of its pairs are counted by
    sorting, and emitted once the task holds HELD different ones. What a task holds depends on the number of pairs, not of
    rows. Null is a value.
    """
    names = sorted({c for pair in pairs for c in pair})
    at = [(names.index(a), names.index(b)) for a, b in pairs]
    bins = {names.index(c): (column, 4 * place) for c, (column, place) in (packed or {}).items() if c in names}
    read = [c for place, c in enumerate(names) if place not in bins] + sorted({column for column, _ in bins.values()})
    labels = {**{str(i): i for i in range(NO_BIN)}, None: NO_BIN}

    def emitted(pair: int, a: np.ndarray, b: np.ndarray, n: np.ndarray, left: list, right: list) -> pa.RecordBatch:
        values = [pa.array(side, pa.string()).take(pa.array(at)) for side, at in ((left, a), (right, b))]
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(n), pair, np.int32)), *values, pa.array(n.astype(np.int64))], names=["pair", "value_a", "value_b", "n"])

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: list[dict] = [dict(labels) if place in bins else {} for place in range(len(names))]
        wide = [False] * len(names)
        matrices = [np.zeros((NARROW, NARROW), np.int64) for _ in at]
        waiting: list[list[np.ndarray]] = [[] for _ in at]
        counted = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in at]

        def count(pair: int) -> None:
            if waiting[pair]:
                codes, n = np.unique(np.concatenate(waiting[pair]), return_counts=True)
                waiting[pair] = []
                both, place = np.unique(np.concatenate([counted[pair][0], codes]), return_inverse=True)
                total = np.zeros(len(both), np.int64)
                np.add.at(total, place, np.concatenate([counted[pair][1], n]))
                counted[pair] = both, total

        def flushed() -> Iterator[pa.RecordBatch]:
            values = [list(k) for k in known]
            for pair, (i, j) in enumerate(at):
                count(pair)
                codes, n = counted[pair]
                if len(n):
                    yield emitted(pair, codes >> 32, codes & 0xFFFFFFFF, n, values[i], values[j])
                counted[pair] = np.zeros(0, np.int64), np.zeros(0, np.int64)
            for place in np.flatnonzero(wide):
                known[place] = {}

        for batch in batches:
            if batch.num_rows == 0:
                continue
            codes = []
            for place, name in enumerate(names):
                if place in bins:
                    column, shift = bins[place]
                    codes.append(batch.column(read.index(column)).to_numpy() >> shift & 15)
                    continue
                coded = batch.column(read.index(name)).dictionary_encode(null_encoding="encode")
                found, own = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
                numbers = [known[place].setdefault(v, len(known[place])) for v in found]
                if len(known[place]) > NARROW and not wide[place]:
                    # From here on the column is wide. Values numbered beyond the matrix are in no matrix yet.
                    wide[place] = True
                    for pair, (i, j) in enumerate(at):
                        if place in (i, j) and matrices[pair] is not None:
                            yield from held(pair, matrices[pair], list(known[i])[:NARROW], list(known[j])[:NARROW])
                            matrices[pair] = None
                codes.append(np.array(numbers, np.int64)[own])
            for pair, (i, j) in enumerate(at):
                if matrices[pair] is not None:
                    matrices[pair] += np.bincount(codes[i] * NARROW + codes[j], minlength=NARROW * NARROW).reshape(NARROW, NARROW)
                else:
                    waiting[pair].append(codes[i] << 32 | codes[j])
                    if sum(map(len, waiting[pair])) >= WAITING:
                        count(pair)
            if sum(len(n) for _, n in counted) > HELD or max(map(len, known)) > HELD:
                yield from flushed()
        yield from flushed()
        for pair, (i, j) in enumerate(at):
            if matrices[pair] is not None:
                yield from held(pair, matrices[pair], list(known[i]), list(known[j]))

    def held(pair: int, matrix: np.ndarray, left: list, right: list) -> Iterator[pa.RecordBatch]:
        counted = matrix[: len(left), : len(right)].ravel()
        some = np.flatnonzero(counted)
        if len(some):
            yield emitted(pair, *np.divmod(some, len(right)), counted[some], left, right)

    return spread(df.select(*read)).mapInArrow(tally, "pair int, value_a string, value_b string, n bigint")


def named_pairs(counts: DataFrame, pairs: list[tuple[str, str]], prefix: str = "") -> DataFrame:
    """Names in place of positions, once the rows have been counted."""
    def name(side):
        return F.element_at(F.array(*[F.lit((prefix if side == 0 else "") + p[side]) for p in pairs]), F.col("pair") + 1)

    return counts.withColumns({"column_a": name(0), "column_b": name(1)}).drop("pair")


def contingency_similarity(
    real: DataFrame,
    synthetic: DataFrame,
    texts: list[str],
    numbers: list[str] = (),
    pairs: list[tuple[str, str]] | None = None,
) -> DataFrame:
    """1 minus the total variation distance of the joint frequencies; numbers in bins, null is a value.

    The pair counts are small next to the rows, so they are combined in the tasks that read them.
    """
    pairs = pairs or list(combinations([*texts, *numbers], 2))
    bounds = numeric_bounds(real, list(numbers))
    cut = [discretized(df, texts, bounds) for df in (real, synthetic)]
    return contingency_of_counts(pair_counts(*cut, pairs))


def pair_counts(
    real: DataFrame, synthetic: DataFrame, pairs: list[tuple[str, str]], prefix: str = "", packed: dict[str, tuple[str, int]] | None = None
) -> DataFrame:
    """Joint counts of discretized columns on both sides.

    Each side is added up by itself: a side that is the same as the other is counted once, by Spark's reuse of exchanges.
    """
    key = ["pair", "value_a", "value_b"]
    sides = [pair_tallies(df, pairs, packed).groupBy(*key).agg(F.sum("n").alias("n")) for df in (real, synthetic)]
    both = sides[0].withColumn("is_real", F.lit(1)).unionByName(sides[1].withColumn("is_real", F.lit(0)))
    counts = both.groupBy(*key).agg(
        F.sum(F.col("n") * F.col("is_real")).alias("n_real"), F.sum(F.col("n") * (1 - F.col("is_real"))).alias("n_synthetic")
    )
    return named_pairs(counts, pairs, prefix)


def contingency_of_counts(counts: DataFrame) -> DataFrame:
    totals = counts.groupBy("column_a", "column_b").agg(
        F.sum("n_real").alias("t_real"), F.sum("n_synthetic").alias("t_synthetic")
    )
    gap = F.abs(share(F.col("n_real"), F.col("t_real")) - share(F.col("n_synthetic"), F.col("t_synthetic")))
    return counts.join(totals, ["column_a", "column_b"]).groupBy("column_a", "column_b").agg(
        (1.0 - F.sum(gap) / 2).alias("score")
    )


def mutual_information(df: DataFrame, texts: list[str], numbers: list[str] = ()) -> DataFrame:
    """Mutual information (nats) of every pair of columns, from joint counts."""
    table = discretized(df, texts, numeric_bounds(df, list(numbers)))
    pairs = list(combinations([*texts, *numbers], 2))
    joint = named_pairs(
        pair_tallies(table, pairs).groupBy("pair", "value_a", "value_b").agg(F.sum("n").alias("n")), pairs)
    key = ["column_a", "column_b"]
    left = joint.groupBy(*key, F.col("value_a").alias("_a")).agg(F.sum("n").alias("n_a"))
    right = joint.groupBy(*key, F.col("value_b").alias("_b")).agg(F.sum("n").alias("n_b"))
    total = joint.groupBy(*key).agg(F.sum("n").alias("t"))
    joined = (
        joint.join(total, key)
        .join(left.withColumnsRenamed({c: f"l_{c}" for c in key}),
              (F.col("column_a") == F.col("l_column_a")) & (F.col("column_b") == F.col("l_column_b"))
              & F.col("value_a").eqNullSafe(F.col("_a")))
        .join(right.withColumnsRenamed({c: f"r_{c}" for c in key}),
              (F.col("column_a") == F.col("r_column_a")) & (F.col("column_b") == F.col("r_column_b"))
              & F.col("value_b").eqNullSafe(F.col("_b")))
    )
    n, t = F.col("n").cast("double"), F.col("t").cast("double")
    term = n / t * F.log(n * t / (F.col("n_a").cast("double") * F.col("n_b").cast("double")))
    return joined.groupBy(*key).agg(F.sum(term).alias("mutual_information"))
