"""Whitening of embeddings: principal components of the whole table, and every vector in units of their deviations.

Entries become whole numbers, so sums and deviations are exact. The covariance is summed over tasks from centred vectors,
its leading eigenvectors are found on the driver (a matrix as wide as a vector), and all vectors are projected on them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.llm import eigen

COMPONENTS = 32
SCALE, SHIFT = 64, 1_000_000
# Scaled entries beyond this are not told apart as whole numbers by a double, and count as not finite.
GREATEST = 2.0**52
# A direction of less variance than this share of the first component's is rounding error and no component.
LEAST_SHARE = 1e-10
# Numbers of a batch that are worked on at once.
CELLS = 1 << 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows whose vector has finite entries only and the most frequent length (the longer of two), and that length."""
    fine = F.forall(vector_col, lambda c: F.coalesce(F.abs(c.cast("double")) * SCALE < GREATEST, F.lit(False)))
    rows = vectors.where(F.col(vector_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    widths = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), F.col("width").desc())
    first = widths.first()
    width = first["width"] if first else 0
    return rows.where(F.size("v") == width), width


def _numbers(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches and their x-vectors: floor(SCALE * c) + SHIFT of each entry, exactly."""
    rows = max(1, CELLS // max(width, 1))
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            entries = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, width)
            yield part, np.floor(entries * SCALE).astype(np.int64) + SHIFT


def totals(rows: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """(n, S): the number of vectors and the exact sum of each entry."""

    def scan(batches):
        n, sums = 0, np.zeros(width, np.int64)
        for part, x in _numbers(batches, width):
            n += part.num_rows
            sums += x.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width)), pa.array(np.append([n], sums))], ["at", "total"])

    summed = rows.mapInArrow(scan, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()  # width + 1 rows
    found = {r["at"]: r["total"] for r in summed}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(width)], np.int64)


def gram(rows: DataFrame, width: int, side: int, centred: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of yy' over all vectors, where y = centred(x) has `side` entries.

    A task sends one matrix, by rows; the rows of all tasks are added without rounding in between, so the result does
    not depend on their order.
    """

    def scan(batches):
        own = np.zeros((side, side))
        for _, x in _numbers(batches, width):
            y = centred(x)
            own += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(side)), pa.array([r.tobytes() for r in own], pa.binary())], ["at", "sums"])

    def add(table: pa.Table) -> pa.Table:
        parts = np.stack([np.frombuffer(x.as_buffer()) for x in table.column("sums")])
        return pa.table({"at": table.column("at")[:1], "sums": pa.array([np.array([math.fsum(c) for c in parts.T]).tobytes()], pa.binary())})

    found = rows.mapInArrow(scan, "at long, sums binary").groupBy("at").applyInArrow(add, "at long, sums binary").collect()  # `side` rows
    out = np.zeros((side, side))
    for r in found:
        out[r["at"]] = np.frombuffer(r["sums"])
    return (out + out.T) / 2


def _deviations(gaps: np.ndarray) -> pa.Array:
    """Sums of squares by row, exact; null where a long does not hold them."""
    greatest = int(np.abs(gaps).max(initial=0))
    if greatest * greatest * gaps.shape[1] < 1 << 63:
        return pa.array((gaps * gaps).sum(axis=1))
    exact = (sum(v * v for v in row) for row in gaps.tolist())
    return pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per vector and component, up to `components`.

    Rows whose vector is null or holds null or non-finite entries (or ones beyond 2^46) are left out, and so are vectors of
    another length than the most frequent one. An entry c becomes x = floor(64 c) + 1000000. The n vectors have sums S and
    the covariance V (divisor n, centred first); component j is a unit eigenvector of V for its j-th greatest eigenvalue e.
    `deviation` is the sum of (n x - S)^2, null where a long does not hold it; `whitened` is x - S / n on the component
    over sqrt(e), `explained` e over the trace of V, and `identity_error` the largest entry of whitened's covariance less
    the identity. Directions along which the vectors do not differ (e of at most 1e-10 of the first) are no components, so equal
    vectors, a single one or an empty table have no rows. Rows that repeat an id, and a null id, count and return like
    any other. Other columns are ignored.
    """
    rows, width = usable(vectors, id_col, vector_col)
    n, sums = totals(rows, width) if width else (0, np.zeros(0, np.int64))

    def centred(x: np.ndarray) -> np.ndarray:
        # n x - S is exact, so the only rounding is that of the quotient, and its sum over all vectors is zero.
        return (n * x - sums) / n

    covariance = gram(rows, width, width, centred) / n if n else np.zeros((0, 0))
    values, units = eigen.leading(covariance, components)
    used = values > LEAST_SHARE * values.max(initial=0.0)
    values, units = values[used], units[:, used]
    k = len(values)
    projection = units / np.sqrt(values)
    of_whitened = gram(rows, width, k, lambda x: centred(x) @ projection) / n if k else np.zeros((0, 0))
    error = float(np.abs(of_whitened - np.eye(k)).max(initial=0.0))

    def scan(batches):
        for part, x in _numbers(batches, width):
            scores = (centred(x) @ projection).ravel() if k else np.zeros(0)
            lists = pa.ListArray.from_arrays(np.arange(0, k * len(x) + 1, max(k, 1), dtype=np.int32)[: len(x) + 1], scores) if k else pa.array([[]] * len(x), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([part.column(0), _deviations(n * x - sums), lists], ["vec_id", "deviation", "scores"])

    share = values / np.trace(covariance) if k else values
    explained = F.array(*[F.lit(float(s)) for s in share]) if k else F.array().cast("array<double>")
    scored = rows.mapInArrow(scan, "vec_id long, deviation long, scores array<double>")
    long = scored.select("vec_id", "deviation", F.posexplode("scores").alias("at", "whitened"))
    return long.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
