"""Gaussian mixtures of many sizes, seeds and sets of columns, fitted together: one scan is a round of EM for all of them.

The log-density of a component is linear in the monomials of a point up to degree two. A task therefore needs two
matrix products a block of points: monomials by coefficients for the responsibilities, and responsibilities by monomials
for what the next round is made from. It emits those sums once, and Spark adds them up by their place.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorframe.session import materialize

# Least variance in any direction, and the gain of the mean log-likelihood below which a mixture is left as it is.
RIDGE = 1e-6
TOLERANCE = 1e-3
# Points whose densities are held at once.
BLOCK = 2048
# The place of the log-likelihood and of the number of rows among a mixture's sums.
LOGS, ROWS = -1, -2


@dataclass(frozen=True)
class Wanted:
    """A mixture to fit: the points of one `space`, that many components, and a seed for where they start."""

    space: int
    components: int
    seed: int = 0


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray


def points(df: DataFrame, spaces: Sequence[Sequence[Column]]) -> DataFrame:
    """(space, x, n): each distinct point of each set of columns with its number of rows, written once.

    Columns are to be scaled to about mean 0 and deviation 1. Points with a null are left out. Equal points are counted
    in the tasks first, so a value that a third of the rows hold is one row a task.
    """
    return materialize(each_point(df, spaces).groupBy("space", "x").agg(F.count(F.lit(1)).alias("n")))


def each_point(df: DataFrame, spaces: Sequence[Sequence[Column]]) -> DataFrame:
    """The same with a row per row of `df` and set of columns, not counted and not written."""
    sets = [F.struct(F.lit(i).alias("space"), F.array(*[c.cast("double") for c in columns]).alias("x")) for i, columns in enumerate(spaces)]
    rows = df.select(F.explode(F.array(*sets)).alias("p")).select("p.*")
    return rows.where(~F.exists("x", lambda v: v.isNull())).withColumn("n", F.lit(1).cast("bigint"))


def _monomials(x: np.ndarray) -> np.ndarray:
    above = np.triu_indices(x.shape[1])
    return np.hstack([np.ones((len(x), 1)), x, x[:, above[0]] * x[:, above[1]]])


def _coefficients(mixture: Mixture) -> np.ndarray:
    """A column per component: its weighted log-density as a combination of the monomials."""
    d = mixture.means.shape[1]
    values, vectors = np.linalg.eigh(mixture.covariances)
    precisions = (vectors / values[:, None, :]) @ vectors.transpose(0, 2, 1)
    slopes = np.einsum("kij,kj->ki", precisions, mixture.means)
    constants = (
        np.log(np.maximum(mixture.weights, 1e-300)) - 0.5 * (d * np.log(2 * np.pi) + np.log(values).sum(axis=1))
        - 0.5 * (slopes * mixture.means).sum(axis=1)
    )
    above = np.triu_indices(d)
    squares = precisions[:, above[0], above[1]] * np.where(above[0] == above[1], -0.5, -1.0)
    return np.hstack([constants[:, None], slopes, squares]).T


def _totals(table: DataFrame, chosen: list[tuple[int, int, Mixture]], moments: bool) -> DataFrame:
    """(mixture, place, value): over all points, the log-likelihood, the rows and, with `moments`, the summed monomials.

    `chosen` names mixtures as (number, space, mixture). A task emits each place once, whatever its number of points.
    """
    spaces = defaultdict(list)
    for number, space, mixture in chosen:
        spaces[space].append((number, _coefficients(mixture)))

    def scan(batches):
        held = {}
        for space, members in spaces.items():
            edges = np.cumsum([0, *[c.shape[1] for _, c in members]])
            held[space] = (np.hstack([c for _, c in members]), edges, np.zeros((members[0][1].shape[0], edges[-1])), np.zeros(len(members)), np.zeros(1))
        for batch in batches:
            for space, (coefficients, edges, sums, logs, rows) in held.items():
                own = batch.filter(pc.equal(batch.column(0), space))
                if not own.num_rows:
                    continue
                x = own.column(1).flatten().to_numpy().reshape(own.num_rows, -1)
                n = own.column(2).to_numpy().astype(np.float64)
                rows += n.sum()
                for at in range(0, len(x), BLOCK):
                    phi, weight = _monomials(x[at : at + BLOCK]), n[at : at + BLOCK, None]
                    density = phi @ coefficients
                    for i, (a, b) in enumerate(zip(edges, edges[1:])):
                        part = density[:, a:b]
                        top = part.max(axis=1, keepdims=True)
                        np.exp(part - top, out=part)
                        total = part.sum(axis=1, keepdims=True)
                        logs[i] += ((np.log(total) + top) * weight).sum()
                        part *= weight / total
                    if moments:
                        sums += phi.T @ density
        numbers, places, values = [], [], []
        for space, (_, edges, sums, logs, rows) in held.items():
            for i, (number, _) in enumerate(spaces[space]):
                flat = sums[:, edges[i] : edges[i + 1]].ravel() if moments else np.zeros(0)
                numbers.append(np.full(len(flat) + 2, number))
                places.append(np.concatenate([[LOGS, ROWS], np.arange(len(flat))]))
                values.append(np.concatenate([[logs[i]], rows, flat]))
        columns = [np.concatenate(numbers).astype(np.int32), np.concatenate(places).astype(np.int64), np.concatenate(values)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["mixture", "place", "value"])

    sums = table.select("space", "x", "n").mapInArrow(scan, "mixture int, place long, value double")
    return sums.groupBy("mixture", "place").agg(F.sum("value").alias("value"))


def _next(mixture: Mixture, sums: np.ndarray, rows: float) -> Mixture:
    """The mixture that the sums of a round make; a component without points keeps its place and loses its weight."""
    k, d = mixture.means.shape
    sums = sums.reshape(-1, k).T
    size = sums[:, 0]
    used = size > 1e-9 * rows
    safe = np.where(used, size, 1.0)[:, None]
    means = sums[:, 1 : 1 + d] / safe
    above = np.triu_indices(d)
    squares = np.zeros((k, d, d))
    squares[:, above[0], above[1]] = squares[:, above[1], above[0]] = sums[:, 1 + d :] / safe
    values, vectors = np.linalg.eigh(squares - means[:, :, None] * means[:, None, :])
    covariances = (vectors * (np.maximum(values, 0.0) + RIDGE)[:, None, :]) @ vectors.transpose(0, 2, 1)
    return Mixture(
        size / size.sum(), np.where(used[:, None], means, mixture.means), np.where(used[:, None, None], covariances, mixture.covariances)
    )


def _starts(table: DataFrame, wanted: Sequence[Wanted]) -> list[Mixture]:
    """Components on points drawn by their numbers of rows, all as wide as leaves them side by side.

    Points are drawn by exponential races on their hashes, so the draw depends on the points alone. What is collected
    are as many points as there are components.
    """
    uniform = (F.shiftrightunsigned(F.xxhash64("space", "x"), 11).cast("double") + 1) / F.lit(float(2**53 + 1))
    drawn = None
    for space in sorted({w.space for w in wanted}):
        most = sum(w.components for w in wanted if w.space == space)
        race = table.where(F.col("space") == space).select("space", "x", (-F.log(uniform) / F.col("n")).alias("time"))
        first = race.orderBy("time", "x").limit(most)
        drawn = first if drawn is None else drawn.unionByName(first)
    pools = defaultdict(list)
    for row in sorted(drawn.collect(), key=lambda r: (r["space"], r["time"], r["x"])):
        pools[row["space"]].append(row["x"])
    out = []
    for w in wanted:
        pool = np.array(pools[w.space])
        if not len(pool):
            raise ValueError("There are no points to fit a mixture to.")
        k, d = min(w.components, len(pool)), pool.shape[1]
        means = pool[np.random.default_rng([w.space, w.components, w.seed]).choice(len(pool), k, replace=False)]
        out.append(Mixture(np.full(k, 1 / k), means, np.repeat(np.eye(d)[None] * k ** (-2 / d), k, axis=0)))
    return out


def fit(table: DataFrame, wanted: Sequence[Wanted], max_iter: int = 20) -> list[Mixture]:
    """A mixture for each of `wanted`, over a table of `points`.

    A round is one scan for all mixtures that still gain; there are at most `max_iter`. Where a space has fewer
    points than components are wanted, each point is one.
    """
    mixtures = _starts(table, wanted)
    active, reached = list(range(len(wanted))), {}
    for _ in range(max_iter):
        found = defaultdict(dict)
        for r in _totals(table, [(i, wanted[i].space, mixtures[i]) for i in active], True).collect():
            found[r["mixture"]][r["place"]] = r["value"]
        still = []
        for i in active:
            own = found[i]
            rows, mean = own[ROWS], own[LOGS] / own[ROWS]
            mixtures[i] = _next(mixtures[i], np.array([own[p] for p in range(len(own) - 2)]), rows)
            if i not in reached or mean - reached[i] >= TOLERANCE:
                still.append(i)
            reached[i] = mean
        active = still
        if not active:
            break
    return mixtures


def log_likelihoods(table: DataFrame, wanted: Sequence[Wanted], mixtures: Sequence[Mixture]) -> DataFrame:
    """(mixture, rows, total): the number of rows and their summed log-likelihood under each mixture, in one scan."""
    sums = _totals(table, [(i, w.space, m) for i, (w, m) in enumerate(zip(wanted, mixtures, strict=True))], False)
    at = lambda place: F.sum(F.when(F.col("place") == place, F.col("value")))
    return sums.groupBy("mixture").agg(at(ROWS).cast("long").alias("rows"), at(LOGS).alias("total"))
