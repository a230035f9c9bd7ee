"""Weighted sums and cross products of many columns in one scan: each task sends one small matrix, not a row per pair."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Moments:
    """Of the rows' vectors x with weights w: the sum of w, of w x, and of w x x'."""

    weight: float
    sums: np.ndarray
    products: np.ndarray

    @property
    def means(self) -> np.ndarray:
        return self.sums / self.weight

    @property
    def covariance(self) -> np.ndarray:
        return self.products / self.weight - np.outer(self.means, self.means)


def moments(
    df: DataFrame, columns: list[str], group: Column, weight: Column | None = None,
    prepared: Callable[[np.ndarray, list[np.ndarray]], list[np.ndarray]] | None = None,
) -> dict[int, Moments]:
    """Moments of `columns` (never null) by `group`, a whole number with few values.

    `prepared` turns groups and columns of a batch into other columns of as many rows before they are added up, in the same
    Python process; null is NaN there.

    A task adds up a matrix per group, whose rows are then added over the tasks without rounding in between: the result
    does not depend on their order, and no task or driver gathers more than a row per task.
    """
    side = len(columns) + 1
    chosen = df.select(group.cast("long").alias("g"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("w"),
                       *[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(columns)])

    def scan(batches):
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            groups, weights = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            read = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, side + 1)]
            x = np.column_stack([np.ones(len(groups)), *(prepared(groups, read) if prepared else read)])
            for g in np.unique(groups).tolist():
                own = groups == g
                found[g] = found.get(g, 0) + (x[own] * weights[own, None]).T @ x[own]
        rows = [(g, at, found[g][at].tobytes()) for g in found for at in range(side)]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["g", "at", "row"])

    def add(table: pa.Table) -> pa.Table:
        parts = np.stack([np.frombuffer(r.as_buffer()) for r in table.column("row")])
        total = np.array([math.fsum(c) for c in parts.T])
        return pa.table({"g": table.column("g")[:1], "at": table.column("at")[:1], "row": pa.array([total.tobytes()], pa.binary())})

    schema = "g long, at long, row binary"
    out: dict[int, np.ndarray] = {}
    for r in chosen.mapInArrow(scan, schema).groupBy("g", "at").applyInArrow(add, schema).collect():  # groups x columns
        out.setdefault(r["g"], np.zeros((side, side)))[r["at"]] = np.frombuffer(r["row"])
    return {g: Moments(m[0, 0], m[0, 1:], (m[1:, 1:] + m[1:, 1:].T) / 2) for g, m in out.items()}
