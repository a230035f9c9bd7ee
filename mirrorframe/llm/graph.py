"""Connected components of a graph too large for any one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.session import materialize


def components(edges: DataFrame, level: int = 0) -> DataFrame:
    """(node, root) for the nodes of `edges` (a long, b long, a <> b); nodes are connected if their roots are equal.

    Each node moves to the neighbour (or itself) of the least random rank, edges are drawn between the places moved
    to, and the smaller graph is solved the same way. Random ranks shrink any graph by a constant share, so the depth
    is logarithmic; nodes with many neighbours are pre-aggregated or met in joins that adaptive execution splits.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = F.xxhash64(F.lit(level), F.col("b"))
    nearest = both.groupBy("a").agg(F.min_by("b", rank).alias("to"))
    own, other = F.xxhash64(F.lit(level), F.col("a")), F.xxhash64(F.lit(level), F.col("to"))
    moved = materialize(nearest.select(F.col("a").alias("node"), F.when(other < own, F.col("to")).otherwise(F.col("a")).alias("root")))
    left = moved.select(F.col("node").alias("a"), F.col("root").alias("x"))
    right = moved.select(F.col("node").alias("b"), F.col("root").alias("y"))
    rest = (
        edges.join(left, "a").join(right, "b").where("x <> y")
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    )
    rest = materialize(rest)
    if rest.isEmpty():
        return moved
    further = components(rest, level + 1).select(F.col("node").alias("root"), F.col("root").alias("last"))
    return materialize(moved.join(further, "root", "left").select("node", F.coalesce("last", "root").alias("root")))
