"""Multi-table synthesizers built on the copula: independent tables, and parent-to-child hierarchies."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions import random as rnd
from mirrorframe.functions.moments import moments
from mirrorframe.operators.prefix import Running, running
from mirrorframe.session import current, materialize, spread
from mirrorframe.sources.metadata import Metadata, Relationship, TableSpec
from mirrorframe.synth import lookup
from mirrorframe.synth.copula import CopulaModel, GaussianCopulaSynthesizer, fit_scored, sample_copula
from mirrorframe.synth.roles import Roles, roles_of


class IndependentSynthesizer:
    """A Gaussian copula per table. With metadata, keys and personal data are made anew, each table's own; nothing is linked."""

    name, modality = "IndependentSynthesizer", "multi_table"

    def __init__(self, seed: int = 0):
        self.seed = seed

    def fit(self, data: dict[str, DataFrame], metadata: Metadata | None = None) -> dict:
        spec = metadata.tables.get if metadata else lambda _: None
        return {n: (GaussianCopulaSynthesizer(f"{self.seed}.{n}").fit(df, spec(n)), df.count()) for n, df in data.items()}

    def sample(self, model: dict, scale: float = 1.0) -> dict[str, DataFrame]:
        return {
            n: GaussianCopulaSynthesizer(f"{self.seed}.{n}").sample(one, int(rows * scale))
            for n, (one, rows) in model.items()
        }


def children_per_parent(parent: DataFrame, parent_key: str, child: DataFrame, child_key: str) -> DataFrame:
    """`n` children for every parent key, zero included. Children are counted before the join."""
    counts = child.where(F.col(child_key).isNotNull()).groupBy(F.col(child_key).alias("_k")).agg(
        F.count(F.lit(1)).alias("n")
    )
    keys = parent.select(F.col(parent_key).alias("_k")).distinct()
    return keys.join(counts, "_k", "left").select(F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


@dataclass
class TableModel:
    """A table's copula over its attributes and, per child table, the count and mean scores of a row's children."""

    schema: T.StructType
    rows: int
    roles: Roles
    copula: CopulaModel | None
    # The edge along which the table's rows are made, and the greatest number of children of one parent.
    edge: Relationship | None
    most: int

    @property
    def scored(self) -> list[str]:
        return [*self.copula.numbers, *self.copula.texts] if self.copula else []


@dataclass
class HierarchyModel:
    metadata: Metadata
    tables: dict[str, TableModel]


def _count_of(child: str) -> str:
    return f"#{child}|n"


def _mean_of(child: str, column: str) -> str:
    return f"#{child}|{column}"


class HierarchicalSynthesizer:
    """Parents first, then children that depend on them.

    Fitting goes from the leaves of the schema up. The normal scores of a child table's columns are averaged per parent, and the
    averages and the number of children become columns of the parent: they are the parameters of its children's
    model, and the parent's copula relates them to its own columns. What is left of the children's covariance is that
    within parents, the lower block of the partitioned Cholesky factor of (averages, scores). Sampling goes down: a
    sampled parent row carries its children's number and averages, and a child's scores are these averages plus draws
    from the factor within parents. Grandchildren are columns of the child, so they reach the top as well.

    Keys are new and consistent: a table's primary key counts its rows, a foreign key always has a parent. A table with several
    parents is generated along its first edge, the other keys are drawn. Personal data and ids are made anew.
    """

    name, modality = "HierarchicalSynthesizer", "multi_table"

    def __init__(self, seed: int = 0):
        self.seed = seed

    def fit(self, data: dict[str, DataFrame], metadata: Metadata) -> HierarchyModel:
        edges = {}
        for e in metadata.relationships:
            edges.setdefault(e.child_table, e)
        tables, about_children = {}, {}
        for name in reversed(metadata.topological()):
            edge = edges.get(name)
            tables[name], summary = self._fit_table(name, data[name], metadata, edge, about_children.get(name, []))
            if edge is not None:
                about_children.setdefault(edge.parent_table, []).append((edge, summary))
        return HierarchyModel(metadata, tables)

    def _fit_table(self, name, df, metadata, edge, about_children):
        own = [c for c in df.columns if c not in metadata.keys_of(name)]
        spec = TableSpec({c: metadata.tables[name].columns[c] for c in own})
        roles = roles_of(df.select(*own), spec, f"{self.seed}.{name}")
        keys = dict.fromkeys([*([edge.child_key] if edge else []), *[e.parent_key for e, _ in about_children]])
        learned = [c for c in own if c not in roles.made]
        rows = df.select(*[F.col(k).alias(f"_key_{k}") for k in keys], *[roles._learned(c).alias(c) for c in learned])
        extra = []
        for e, summary in about_children:
            named = summary.select(F.col("key").alias("_k"), *[c for c in summary.columns if c != "key"])
            rows = rows.join(named, F.col(f"_key_{e.parent_key}") == F.col("_k"), "left").drop("_k")
            rows = rows.withColumn(_count_of(e.child_table), F.coalesce(_count_of(e.child_table), F.lit(0).cast("bigint")))
            extra += named.columns[1:]
        columns = [*learned, *extra]
        n_rows = df.count()
        fk = f"_key_{edge.child_key}" if edge else None
        if not columns:
            copula, scores, means = None, rows, []
        else:
            schema = rows.select(*columns).schema
            stored = materialize(rows) if about_children else spread(rows)
            copula, scored = fit_scored(stored.withColumn("_segment", F.lit(0)), schema, (fk,) if fk else ())
            for c in extra:
                # A parent without children has no averages to leave out: its row has none to use.
                copula.grids[(0, c)] = (copula.grids[(0, c)][0], 0.0)
            means, scores = [*copula.numbers, *copula.texts], scored
        if edge is None:
            return TableModel(df.schema, n_rows, roles, copula, None, 0), None
        summary, most = self._per_parent(name, scores, f"_keep_{fk}" if columns else fk, means, copula)
        return TableModel(df.schema, n_rows, roles, copula, edge, most), summary

    @staticmethod
    def _per_parent(name, scores, key, columns, copula):
        """(key, count, averages of standardised scores) per parent, and the greatest count; the copula keeps the factor within parents.

        Children are counted and summed before anything is shuffled, whatever the number of children of one parent.
        """
        standard = {}
        if columns:
            row = scores.agg(*[e for c in columns for e in (F.avg(c).alias(f"{c}|m"), F.stddev_pop(c).alias(f"{c}|s"))]).first()
            # Scores of a column that does not vary stay at 0.
            standard = {c: (F.col(c) - (row[f"{c}|m"] or 0.0)) / (row[f"{c}|s"] or 1.0) for c in columns}
        per_parent = materialize(scores.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
            F.count(F.lit(1)).alias(_count_of(name)), *[F.avg(e).alias(_mean_of(name, c)) for c, e in standard.items()]))
        count = F.col(_count_of(name))
        most = per_parent.agg(F.max(count)).first()[0] or 0
        if columns:
            found = moments(per_parent, [_mean_of(name, c) for c in columns], F.lit(0), count).get(0)
            between = found.products / found.weight if found else np.zeros((len(columns), len(columns)))
            for s, triangle in copula.triangles.items():
                copula.triangles[s] = _factor(triangle @ triangle.T - between)
        return per_parent, most

    def sample(self, model: HierarchyModel, scale: float = 1.0) -> dict[str, DataFrame]:
        out, rows, sizes = {}, {}, {}
        for name in model.metadata.topological():
            one = model.tables[name]
            if one.edge is None:
                sizes[name] = int(one.rows * scale)
                ids = lookup.row_ids(current(), sizes[name])
            else:
                ids = materialize(self._children(model, name, rows[one.edge.parent_table]))
                sizes[name] = ids.count()
            drawn = self._drawn(one, name, ids)
            rows[name] = materialize(drawn) if any(t.edge and t.edge.parent_table == name for t in model.tables.values()) else drawn
            out[name] = self._finished(model, name, rows[name], sizes)
        return out

    def _drawn(self, one: TableModel, name: str, ids: DataFrame) -> DataFrame:
        """`id`, the parent's number, and what the copula gives: attributes, and the parameters of the row's children."""
        parent = ("_parent",) if one.edge else ()
        if one.copula is None:
            return ids.select("id", *parent)
        return sample_copula(one.copula, ids, f"{self.seed}.{name}", keep=parent, shift="_shift" if one.edge else None)

    def _children(self, model, name, parents):
        """(id, parent's number, averages) of as many rows as the parents ask for."""
        one = model.tables[name]
        shift = F.array(*[F.col(_mean_of(name, c)) for c in one.scored] or [F.lit(0.0)])
        asked = parents.select(F.col("id").alias("_parent"), F.greatest(F.col(_count_of(name)), F.lit(0)).cast("bigint").alias("_n"), shift.alias("_shift"))
        placed = running(asked, [], [F.col("_parent")], [Running("_start", "sum", "_n", inclusive=False)])
        first = F.coalesce("_start", F.lit(0)).cast("bigint")
        made = lookup.explode_range(placed.where("_n > 0"), first, first + F.col("_n") - 1, "id", longest=one.most)
        return made.select("id", "_parent", "_shift")

    def _finished(self, model, name, rows, sizes):
        one, seed, keys = model.tables[name], f"{self.seed}.{name}", {}
        keep = ("_parent",) if one.edge else ()
        own = one.roles.finished(rows, sizes[name], keep=keep)
        edges = [r for r in model.metadata.relationships if r.child_table == name]
        for e in edges:
            number = F.col("_parent") if e == one.edge else rnd.index(seed, f"#{e.child_key}", F.col("id"), F.lit(sizes[e.parent_table]))
            keys[e.child_key] = self._key(model, e.parent_table, e.parent_key, number, name, e.child_key)
        for key in model.metadata.keys_of(name):
            if key not in keys:
                keys[key] = self._key(model, name, key, F.col("id"), name, key)
        return own.withColumns(keys).select(*one.schema.fieldNames()) if keys else own.select(*one.schema.fieldNames())

    @staticmethod
    def _key(model, parent, parent_key, number, table, column):
        """Numbers for numeric keys, `<key>_<number>` for text keys, alike on both sides of an edge."""
        target = model.tables[table].schema[column].dataType
        if isinstance(model.tables[parent].schema[parent_key].dataType, T.StringType):
            return F.concat(F.lit(f"{parent_key}_"), number.cast("string"))
        return number.cast(target)


def _factor(matrix: np.ndarray) -> np.ndarray:
    """A lower triangle whose square is the matrix, after lifting eigenvalues that rounding made negative."""
    values, vectors = np.linalg.eigh(matrix)
    return np.linalg.cholesky((vectors * np.maximum(values, 1e-9)) @ vectors.T)
