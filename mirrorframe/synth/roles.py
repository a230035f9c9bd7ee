"""What metadata says about columns, carried out around any generator of one table.

Keys, ids and personal data are not modelled: they are made anew from the row number. Formatted datetimes are modelled as
datetimes and written in their format again; numbers that are declared categories are modelled as text. A generator
sees the other columns only.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions import patterns
from mirrorframe.functions import random as rnd
from mirrorframe.functions import scalar as S
from mirrorframe.functions.permutation import permuted
from mirrorframe.session import current
from mirrorframe.sources.metadata import INTEGER_TYPES, NUMERIC_TYPES, TableSpec
from mirrorframe.synth import lookup

# Personal data of a kind without a pattern of its own.
OTHER = "#######"
# Beginnings that are tried in one pass until one is found that no real value has.
TRIED = 8


@dataclass
class Made:
    """How the values of a generated column come about: `distinct` different ones, or one per row where it is None."""

    pattern: patterns.Pattern | None
    low: int
    distinct: int | None
    nulls: float


@dataclass
class Roles:
    schema: T.StructType
    made: dict[str, Made]
    formats: dict[str, str]
    as_text: list[str]
    seed: str

    def modelled(self, data: DataFrame) -> DataFrame:
        """The columns that a generator is to learn, as the types it knows."""
        return data.select(*[self._learned(c).alias(c) for c in self.schema.fieldNames() if c not in self.made])

    def _learned(self, column: str) -> Column:
        if column in self.formats:
            return S.from_micros(S.to_micros(F.col(column), self.formats[column]))
        return F.col(column).cast("string") if column in self.as_text else F.col(column)

    def finished(self, rows: DataFrame, n_rows: int, row_id: str = "id", keep: tuple[str, ...] = ()) -> DataFrame:
        """Sampled `rows`, numbered from 0 by `row_id`, with all columns of the data in their order and types; `row_id` and `keep` stay."""
        columns = {}
        for f in self.schema.fields:
            c = f.name
            if c in self.made:
                value = self._value(c, F.col(row_id), n_rows)
            elif c in self.formats:
                value = S.from_micros(S.to_micros(F.col(c)), self.formats[c])
            else:
                value = F.col(c)
            columns[c] = value.try_cast(f.dataType) if c in self.as_text else value.cast(f.dataType)
        return rows.select(row_id, *keep, *[v.alias(c) for c, v in columns.items()])

    def _value(self, column: str, row: Column, n_rows: int) -> Column:
        made, stream = self.made[column], f"#made {column}"
        if made.distinct is None:
            number, size = row, max(n_rows, 1)
        else:
            number, size = rnd.index(self.seed, stream + "#draw", row, F.lit(max(made.distinct, 1))), max(made.distinct, 1)
        if made.pattern is None:
            value = permuted(self.seed, stream, number, size) + F.lit(made.low)
        else:
            value = patterns.made(made.pattern, self.seed, stream, number, size)
        return F.when(rnd.uniform(self.seed, stream + "#null", row) >= made.nulls, value) if made.nulls > 0 else value


def roles_of(data: DataFrame, table: TableSpec, seed: int | str) -> Roles:
    """One pass over the data at most: bounds, shares of nulls, distinct counts, and which beginnings real values have.

    Columns of an unknown semantic type that isn't marked as personal are modelled by their physical type. Primary and alternate keys get a value per row, all different and never null. Other ids get as many different values
    as the data has. Personal data gets values that begin like no real one does (numbers: beyond the greatest real one).
    """
    known = {c: s for c, s in table.columns.items() if c in data.columns}
    keys = {table.primary_key, *table.alternate_keys}
    private = [c for c, s in known.items() if s.pii or s.sdtype in patterns.PERSONAL]
    ids = [c for c, s in known.items() if c not in private and (s.sdtype == "id" or c in keys)]
    formats = {c: s.datetime_format for c, s in known.items() if s.sdtype == "datetime" and s.datetime_format and _is_text(data, c)}
    number = (*INTEGER_TYPES, *NUMERIC_TYPES)
    as_text = [c for c, s in known.items() if s.sdtype in ("categorical", "boolean") and c not in ids and c not in private and isinstance(data.schema[c].dataType, number)]
    as_text += [c for c in private + ids if not isinstance(data.schema[c].dataType, (*number, T.StringType))]

    measured, facts = [], {}
    for c in [*private, *ids]:
        measured += [F.count(c).alias(f"{c}|n"), F.approx_count_distinct(c).alias(f"{c}|distinct")]
        if not _is_text(data, c):
            measured += [F.min(F.col(c).try_cast("bigint")).alias(f"{c}|low"), F.max(F.col(c).try_cast("bigint")).alias(f"{c}|high")]
    for c in private:
        measured += [F.count_if(F.col(c).cast("string").startswith(lead)).alias(f"{c}|{k}") for k, lead in enumerate(_leads(known[c].sdtype, c))]
    if measured:
        facts = data.agg(F.count(F.lit(1)).alias("rows"), *measured).first().asDict()

    made: dict[str, Made] = {}
    for c in [*private, *ids]:
        one_per_row = c in keys
        nulls = 0.0 if one_per_row or not facts["rows"] else 1.0 - facts[f"{c}|n"] / facts["rows"]
        # Personal data is as varied as rows are; other ids repeat as often as they do in the data.
        distinct = None if one_per_row or c in private else facts[f"{c}|distinct"]
        pattern, low = None, 0
        if _is_text(data, c):
            pattern = _pattern(known[c].sdtype, c, facts) if c in private else patterns.Pattern(f"{c}_", patterns.LENGTHENED_BY)
        elif c in private:
            low = (facts[f"{c}|high"] or 0) + 1
        made[c] = Made(pattern, low, distinct, nulls)
    return Roles(data.schema, made, formats, as_text, f"{seed}.roles")


def _is_text(data: DataFrame, column: str) -> bool:
    return isinstance(data.schema[column].dataType, T.StringType)


def _leads(sdtype: str, column: str) -> list[str]:
    lead, _ = patterns.PERSONAL.get(sdtype, (f"{column}_", OTHER))
    return [lead, *[f"{lead}{k}{lead}" for k in range(1, TRIED)]]


def _pattern(sdtype: str, column: str, facts: dict[str, Any]) -> patterns.Pattern:
    _, body = patterns.PERSONAL.get(sdtype, ("", OTHER))
    leads = _leads(sdtype, column)
    free = [lead for k, lead in enumerate(leads) if not facts[f"{column}|{k}"]]
    if not free:
        raise ValueError(f"Real values of {column!r} begin with all of {leads}.")
    return patterns.Pattern(free[0], body)


@dataclass
class Described:
    """A generator's model with the roles of the columns around it; without metadata there are none."""

    roles: Roles | None
    model: Any
    schema: T.StructType


class ByMetadata:
    """`fit` and `sample` for generators that have `_fit(data)` and `_rows(model, ids)`, which returns `id` and the columns."""

    seed: int | str

    def fit(self, data: DataFrame, table: TableSpec | None = None) -> Described:
        roles = roles_of(data, table, self.seed) if table is not None else None
        learned = roles.modelled(data) if roles else data
        return Described(roles, self._fit(learned) if learned.columns else None, data.schema)

    def sample(self, model: Described, n_rows: int, row_id: str | None = None) -> DataFrame:
        rows = self.rows_for(model, lookup.row_ids(current(), n_rows), n_rows)
        named = rows.withColumnRenamed("id", row_id) if row_id else rows
        return named.select(*([row_id] if row_id else []), *model.schema.fieldNames())

    def rows_for(self, model: Described, ids: DataFrame, n_rows: int) -> DataFrame:
        """`id` and all columns for the numbers 0 .. n_rows-1 in `ids`."""
        rows = ids.select("id") if model.model is None else self._rows(model.model, ids)
        return model.roles.finished(rows, n_rows) if model.roles else rows
