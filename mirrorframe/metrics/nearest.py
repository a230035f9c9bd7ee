"""Exact distance to the closest record, without comparing every pair of rows.

The records are split into blocks of about 131,072 rows that do not overlap, at places found with a few of them; within a
block they are put in the order of a k-d tree, so that boxes of boxes need no pointers. A query searches the block nearest to it, then all others
whose box is nearer than the record it has found: the answer is exact. Within a block it first goes down to the few nearest
leaves, which gives a bound that rules out nearly all others. Work is grouped by block; a block that many queries visit is
replicated and its queries salted, so no task holds more than a block and some of its queries.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions import scalar as S
from mirrorframe.metrics.pairs import numeric_bounds
from mirrorframe.operators import prefix
from mirrorframe.session import materialize
from mirrorframe.synth.simple import as_number

FANOUT = 256
# Queries that search a block at once; what they keep meanwhile is bounded too (PIECE).
VISITS = 4_000
# A block has about 2 x FANOUT x FANOUT rows, of which about SEEN say where it ends, and a task so many times VISITS queries of it.
TURNS = 16
SEEN = 64
# Boxes of a box, most rows of a leaf, leaves looked at for a first bound, and pairs of a query and a box that are compared at once.
WIDTH, LEAF, FIRST, PIECE = 16, 32, 4, 1_024
# Where a missing number lies: further than 1 from any scaled value.
_MISSING = 1e6


@dataclass
class Space:
    """Scaled coordinates: numbers over their real range, texts as codes that are equal or not."""

    numbers: list[str]
    texts: list[str]
    bounds: dict[str, tuple[float, float]]
    codes: DataFrame | None

    @property
    def columns(self) -> list[str]:
        return [*self.numbers, *self.texts]


def fit_space(real: DataFrame, numbers: list[str], texts: list[str]) -> Space:
    codes = None
    if texts:
        from mirrorframe.synth.lookup import value_counts

        codes = materialize(prefix.hash_numbered(
            value_counts(real, texts).select("column", "value"), ["column"], "value"))
    return Space(numbers, texts, numeric_bounds(real, numbers), codes)


def points(df: DataFrame, space: Space, keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows as `p`, an array of coordinates; a text the space does not know is -1, equal to no code."""
    def scaled(c):
        low, high = space.bounds[c]
        value = S.no_nan(as_number(df.schema, c).cast("double"))
        width = (high - low) if low is not None else 0.0
        unit = (value - low) / width if width > 0 else F.when(value == low, 0.0).when(value.isNotNull(), 1.0)
        return F.coalesce(unit, F.lit(_MISSING)).cast("double")

    out = df.select(*keep, *[scaled(c).alias(c) for c in space.numbers], *[F.col(c).cast("string").alias(c) for c in space.texts])
    for c in space.texts:
        codes = space.codes.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("idx").alias("_i"))
        out = out.join(codes, F.col(c).eqNullSafe(F.col("_v")), "left")
        out = out.withColumn(c, F.coalesce("_i", F.lit(-1)).cast("double")).drop("_v", "_i")
    return out.select(*keep, F.array(*space.columns).alias("p"))


def _add_gap(total: np.ndarray, x: np.ndarray, low: np.ndarray, high: np.ndarray, number: bool) -> None:
    if number:
        gap = np.maximum(low - x, x - high)
        total += np.clip(gap, 0.0, 1.0, out=gap)
    else:
        total += (x < low) | (x > high)


class Tree:
    """Boxes of boxes, WIDTH to one, above boxes (coordinates x boxes) that lie near those before and after them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, n: int):
        self.n, self.levels, self.counts = n, [], []
        while True:
            count = low.shape[1]
            # The last box fills the last group up; `counts` tells which are there.
            at = np.minimum(np.arange(-(-count // WIDTH) * WIDTH), count - 1).reshape(-1, WIDTH)
            self.levels.insert(0, (low[:, at], high[:, at]))
            self.counts.insert(0, count)
            if count <= WIDTH:
                return
            low, high = low[:, at].min(axis=2), high[:, at].max(axis=2)

    def _gaps(self, level: int, x: np.ndarray, q: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Least possible distance of queries (rows) to the boxes of groups (columns)."""
        low, high = self.levels[level]
        total = np.zeros((len(q), WIDTH))
        for j in range(len(x)):
            _add_gap(total, x[j][q][:, None], low[j][group], high[j][group], j < self.n)
        return total / len(x)

    def nearest(self, x: np.ndarray, most: int = FIRST) -> np.ndarray:
        """A few boxes near each query (rows), the nearest found first; only so many are kept on each level."""
        size = x.shape[1]
        found = np.zeros((size, 1), np.int64)
        for level, count in enumerate(self.counts):
            gap = self._gaps(level, x, np.repeat(np.arange(size), found.shape[1]), found.ravel()).reshape(size, -1)
            box = (found[:, :, None] * WIDTH + np.arange(WIDTH)).reshape(size, -1)
            gap[box >= count] = np.inf
            if gap.shape[1] > (keep := min(most, count)):
                part = np.argpartition(gap, keep - 1, axis=1)[:, :keep]
                gap, box = np.take_along_axis(gap, part, 1), np.take_along_axis(box, part, 1)
            found = box
        return np.take_along_axis(found, np.argsort(gap, axis=1, kind="stable"), 1)

    def within(self, x: np.ndarray, best: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(queries, boxes), some pairs at a time: each box nearer than the query's `best`, which may fall meanwhile."""
        waiting = [(0, np.arange(x.shape[1]), np.zeros(x.shape[1], np.int64))]
        while waiting:
            level, q, group = waiting.pop()
            if len(q) > PIECE:
                waiting.append((level, q[PIECE:], group[PIECE:]))
                q, group = q[:PIECE], group[:PIECE]
            rows, places = np.nonzero(self._gaps(level, x, q, group) < best[q][:, None])
            q, box = q[rows], group[rows] * WIDTH + places
            there = box < self.counts[level]
            q, box = q[there], box[there]
            if len(q) and level + 1 == len(self.counts):
                yield q, box
            elif len(q):
                waiting.append((level + 1, q, box))


def _cuts(rows: int) -> list[np.ndarray]:
    """Where halves, quarters, ... of some rows begin and end, down to leaves; each group of a level becomes WIDTH groups."""
    cuts = [np.array([0, rows])]
    while rows / (len(cuts[-1]) - 1) > LEAF:
        for _ in range(WIDTH.bit_length() - 1):
            a, b = cuts[-1][:-1], cuts[-1][1:]
            cuts.append(np.append(np.stack([a, (a + b) // 2], axis=1).ravel(), rows))
    return cuts


def _tree_order(points: np.ndarray, n: int) -> np.ndarray:
    """The points (rows) such that halves, quarters, ... are split where they are widest: unlike texts first, then numbers."""
    for cuts in _cuts(len(points))[:-1]:
        wide = np.maximum.reduceat(points, cuts[:-1]) - np.minimum.reduceat(points, cuts[:-1])
        wide[:, n:] = np.where(wide[:, n:] > 0, 2 * _MISSING, 0.0)
        part = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
        points = points[np.lexsort((points[np.arange(len(points)), wide.argmax(axis=1)[part]], part))]
    return points


class Block:
    """Records in the order of their tree."""

    def __init__(self, points: np.ndarray, n: int):
        cuts = _cuts(len(points))[-1]
        self.tree = Tree(np.minimum.reduceat(points, cuts[:-1]).T, np.maximum.reduceat(points, cuts[:-1]).T, n)
        # Leaves of unequal size are filled up with their last point.
        at = np.minimum(cuts[:-1, None] + np.arange(np.diff(cuts).max()), cuts[1:, None] - 1)
        self.leaves, self.n = points.T[:, at], n

    def _least(self, x: np.ndarray, q: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Distance of each query to the closest point of a leaf."""
        found = np.zeros(len(q))
        for start in range(0, len(q), PIECE):
            part = slice(start, start + PIECE)
            total = np.zeros((len(q[part]), self.leaves.shape[2]))
            for j in range(len(x)):
                point = self.leaves[j][leaf[part]]
                _add_gap(total, x[j][q[part]][:, None], point, point, j < self.n)
            found[part] = total.min(axis=1) / len(x)
        return found

    def search(self, x: np.ndarray, best: np.ndarray, visits: int) -> np.ndarray:
        """`best`, or the distance of each query (columns of `x`) to the closest point if that is less."""
        best = best.copy()
        first = np.zeros(len(best), np.int64)
        for start in range(0, len(best), PIECE):
            part = slice(start, start + PIECE)
            near = self.tree.nearest(x[:, part])
            q = np.repeat(np.arange(near.shape[0]), near.shape[1])
            best[part] = np.minimum(best[part], self._least(x[:, part], q, near.ravel()).reshape(near.shape).min(axis=1))
            first[part] = near[:, 0]
        # Neighbours go down together: they look at the same boxes.
        order = np.argsort(first, kind="stable")
        for start in range(0, len(order), visits):
            own = order[start : start + visits]
            mine, bound = x[:, own], best[own]
            for q, leaf in self.tree.within(mine, bound):
                np.minimum.at(bound, q, self._least(mine, q, leaf))
            best[own] = bound
        return best


class Splits:
    """A k-d tree of half spaces, made from some points: parts hold at most `most` of them unless they are all alike."""

    def __init__(self, points: np.ndarray, n: int, most: int):
        self.axis, self.value, self.below = [], [], []
        self.parts = 0
        self._split(points, n, most)
        self.axis, self.value, self.below = (np.array(x) for x in (self.axis, self.value, self.below))

    def _split(self, points: np.ndarray, n: int, most: int) -> int:
        """Where the part or node is: nodes from 0, parts from -1 downwards, in the order of the space."""
        wide = np.ptp(points, axis=0) if len(points) > most else np.zeros(points.shape[1])
        wide[n:] = np.where(wide[n:] > 0, 2 * _MISSING, 0.0)
        axis = int(wide.argmax())
        if not wide[axis] > 0:
            self.parts += 1
            return -self.parts
        values, at = np.unique(points[:, axis], return_inverse=True)
        counts = np.cumsum(np.bincount(at))
        value = values[np.abs(counts[:-1] - len(points) / 2).argmin()]
        node = len(self.axis)
        self.axis.append(axis), self.value.append(value), self.below.append(None)
        self.below[node] = tuple(self._split(points[side], n, most) for side in (points[:, axis] <= value, points[:, axis] > value))
        return node

    def __call__(self, points: np.ndarray) -> np.ndarray:
        """The part of each point."""
        at = np.full(len(points), 0 if len(self.axis) else -1)
        while len(inner := np.flatnonzero(at >= 0)):
            node = at[inner]
            above = points[inner, self.axis[node]] > self.value[node]
            at[inner] = self.below[node, above.astype(np.int64)]
        return -1 - at


@dataclass
class Blocks:
    """Blocks of records (node, points) and their boxes, neighbours side by side; no tree if there are no records."""

    table: DataFrame
    nodes: np.ndarray
    tree: Tree | None


def _blocks(records: DataFrame, space: Space, fanout: int) -> Blocks:
    n, k, size = len(space.numbers), len(space.columns), 2 * fanout * fanout
    distinct = materialize(records.select("p").distinct())
    # Some of the points, SEEN a block, only say where blocks end; all points are dealt to them.
    few = distinct.where(F.pmod(F.xxhash64("p"), F.lit(max(1, size // SEEN))) == 0).select("p").toArrow().column("p").combine_chunks()
    splits = Splits(few.flatten().to_numpy().reshape(-1, k), n, SEEN)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).flatten().to_numpy().reshape(-1, k)
            yield pa.RecordBatch.from_arrays([pa.array(splits(points)), batch.column(0)], ["node", "p"])

    def block(table: pa.Table) -> pa.Table:
        points = _tree_order(table.column("p").combine_chunks().flatten().to_numpy().reshape(-1, k), n)
        parts = [points, points.min(axis=0), points.max(axis=0)]
        return pa.table({"node": table.column("node")[:1]} | {
            c: pa.array([x.tobytes()], pa.binary()) for c, x in zip(("points", "low", "high"), parts, strict=True)})

    dealt = distinct.mapInArrow(deal, "node bigint, p array<double>")
    table = materialize(dealt.groupBy("node").applyInArrow(block, "node bigint, points binary, low binary, high binary"))
    # A row for each block of rows.
    boxes = sorted(table.select("node", "low", "high").collect(), key=lambda r: r["node"])
    low, high = (np.array([np.frombuffer(r[side]) for r in boxes]).reshape(-1, k).T for side in ("low", "high"))
    return Blocks(table.select("node", "points"), np.array([r["node"] for r in boxes], np.int64), Tree(low, high, n) if boxes else None)


def _coordinates(k: int) -> list[str]:
    return [f"p{i}" for i in range(k)]


def _spread_visits(candidates: DataFrame, children: DataFrame, visits: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: queries of a busy node are split, the node's children copied per salt."""
    loads = candidates.groupBy("node").agg(F.count(F.lit(1)).alias("load"))
    salts = loads.select("node", F.ceil(F.col("load") / visits).cast("int").alias("salts"))
    left = candidates.join(salts, "node").withColumn("salt", F.pmod(F.hash("q"), F.col("salts"))).drop("salts")
    copies = salts.select(F.col("node").alias("parent"), F.col("salts").alias("copies"))
    right = children.withColumnRenamed("node", "child").join(copies, "parent").select(
        "parent", *[c for c in ("child", "low", "high", "points") if c == "child" or c in children.columns],
        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    return left, right


def _numbers(table: pa.Table | pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Columns without nulls as rows of a matrix."""
    return np.array([np.asarray(table.column(c)) for c in columns]).reshape(len(columns), -1)


def _searched(candidates: DataFrame, blocks: Blocks, n: int, k: int, visits: int) -> DataFrame:
    """(q, p0.., best, node): `best` lowered to the distance of the closest record of the block, if that is nearer."""
    children = blocks.table.withColumn("parent", F.col("node"))
    left, right = _spread_visits(candidates, children, visits * TURNS)
    at = _coordinates(k)
    columns = ["q", *at, "best", "node"]

    def search(queries: pa.Table, block: pa.Table) -> pa.Table:
        queries = queries.select(columns)
        if not queries.num_rows or not block.num_rows:
            return queries
        points = np.frombuffer(block.column("points").combine_chunks()[0].as_buffer()).reshape(-1, k)
        best = Block(points, n).search(_numbers(queries, at), _numbers(queries, ["best"])[0], visits)
        return queries.set_column(columns.index("best"), "best", pa.array(best))

    return left.groupBy("node", "salt").cogroup(right.groupBy("parent", "salt")).applyInArrow(search, _schema(at))


def _schema(at: list[str]) -> str:
    return "q bigint, " + ", ".join(f"{c} double" for c in at) + ", best double, node bigint"


def _visits(candidates: DataFrame, blocks: Blocks, k: int, others: bool) -> DataFrame:
    """Each query with the block nearest to it, or with every other block that is nearer than its `best`."""
    at, tree, nodes = _coordinates(k), blocks.tree, blocks.nodes
    columns = ["q", *at, "best", "node"]

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, PIECE):
                batch = whole.slice(start, PIECE).select(columns)
                x = _numbers(batch, at)
                if not others:
                    yield batch.set_column(columns.index("node"), "node", pa.array(nodes[tree.nearest(x)[:, 0]]))
                    continue
                best, home = _numbers(batch, ["best"])[0], _numbers(batch, ["node"])[0]
                for q, box in tree.within(x, best):
                    away = np.flatnonzero(nodes[box] != home[q])
                    yield batch.take(pa.array(q[away])).set_column(columns.index("node"), "node", pa.array(nodes[box[away]]))

    return candidates.select(columns).mapInArrow(visit, _schema(at))


def closest(
    queries: DataFrame, levels: Blocks, space: Space, visits: int = VISITS
) -> DataFrame:
    """(q, distance) for queries (q, p) against packed records."""
    n, k = len(space.numbers), len(space.columns)
    spread = [F.col("p")[i].alias(c) for i, c in enumerate(_coordinates(k))]
    # A distance is at most 1.
    top = queries.select("q", *spread, F.lit(2.0).alias("best"), F.lit(0).cast("bigint").alias("node"))
    if levels.tree is None:
        return top.select("q", F.col("best").alias("distance"))
    # First the nearest block: its closest record rules out most others. Then every block that could hold a closer one.
    home = materialize(_visits(top, levels, k, others=False))
    first = materialize(_searched(home, levels, n, k, visits))
    away = materialize(_visits(first, levels, k, others=True))
    found = first.select("q", "best").unionByName(_searched(away, levels, n, k, visits).select("q", "best"))
    return found.groupBy("q").agg(F.min("best").alias("distance"))


def pack(records: DataFrame, space: Space, fanout: int = FANOUT) -> Blocks:
    return _blocks(points(records, space), space, fanout)
