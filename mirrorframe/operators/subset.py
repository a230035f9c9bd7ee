"""Smaller versions of a dataset: fewer columns, sampled rows, consistent keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.functions import random as rnd
from mirrorframe.session import materialize
from mirrorframe.sources.metadata import Metadata, TableSpec

# The caps of a limited dataset.
MAX_ROWS = 1000
MAX_OPTIONAL_COLUMNS = 10


def trimmed_columns(columns: list[str], mandatory: list[str], optional: int = MAX_OPTIONAL_COLUMNS) -> list[str]:
    """Mandatory columns, then the first `optional` of the others."""
    first = [c for c in mandatory if c in columns]
    return [*first, *[c for c in columns if c not in mandatory][:optional]]


def trim_columns(df: DataFrame, mandatory: list[str], optional: int = MAX_OPTIONAL_COLUMNS) -> DataFrame:
    return df.select(*trimmed_columns(df.columns, mandatory, optional))


def row_cap(df: DataFrame, keys: list[str], rows: int = MAX_ROWS, seed: int | str = 0) -> DataFrame:
    """A sample without replacement of at most `rows` rows: the first in a seeded hash order of their keys.

    Each task keeps its own first rows, so only tasks x rows rows are ever brought together.
    """
    order = rnd.order_key(seed, *[F.col(k) for k in keys])
    return df.withColumn("_order", order).orderBy("_order", *keys).limit(rows).drop("_order")


def table_subset(
    df: DataFrame,
    table: TableSpec,
    keys: list[str],
    rows: int = MAX_ROWS,
    optional: int = MAX_OPTIONAL_COLUMNS,
    seed: int | str = 0,
) -> DataFrame:
    """Columns and rows of one table capped; a sequence keeps its key and its order."""
    mandatory = [c for c in (table.sequence_index, table.sequence_key) if c]
    kept = trimmed_columns(df.columns, mandatory, optional)
    return row_cap(df, keys, rows, seed).select(*kept)


def referential_subset(
    data: dict[str, DataFrame],
    metadata: Metadata,
    row_keys: dict[str, list[str]],
    rows: int = MAX_ROWS,
    optional: int = MAX_OPTIONAL_COLUMNS,
    seed: int | str = 0,
) -> dict[str, DataFrame]:
    """A sample of the largest table and the rows of all others that keep every key valid.

    Descendants of the sampled table keep the children of kept rows. Every other table is then cut to
    what the kept tables refer to, parents after their children. `row_keys` identifies rows of the main
    table, by default its primary key.
    """
    sizes = {name: df.count() for name, df in data.items()}
    main = max(sizes, key=lambda name: (sizes[name], name))
    trimmed = {n: trim_columns(df, metadata.keys_of(n), optional) for n, df in data.items()}
    keys = row_keys.get(main) or [metadata.tables[main].primary_key]
    kept = {main: materialize(row_cap(data[main], keys, rows, seed).select(*trimmed[main].columns))}

    order = metadata.topological()
    for name in order[order.index(main) + 1:]:
        for edge in metadata.relationships:
            if edge.child_table == name and edge.parent_table in kept:
                kept[name] = _semi(kept.get(name, trimmed[name]), edge.child_key, kept[edge.parent_table], edge.parent_key)
    for name in reversed(order):
        if name in kept:
            continue
        used = None
        for edge in metadata.relationships:
            if edge.parent_table == name and edge.child_table in kept:
                one = kept[edge.child_table].select(F.col(edge.child_key).alias("_k"))
                used = one if used is None else used.unionByName(one)
        if used is None:
            kept[name] = trimmed[name]
        else:
            parent_key = next(e.parent_key for e in metadata.relationships if e.parent_table == name)
            kept[name] = materialize(_semi(trimmed[name], parent_key, used, "_k"))
    return {name: kept[name] for name in data}


def _semi(df: DataFrame, column: str, other: DataFrame, other_column: str) -> DataFrame:
    values = other.select(F.col(other_column).alias("_used")).where("_used is not null").distinct()
    return df.join(values, F.col(column) == F.col("_used"), "left_semi")
