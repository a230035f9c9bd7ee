"""Table metadata: semantic column types, keys and relationships, and the Spark types they imply."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

MODALITIES = ("single_table", "multi_table", "sequential")
NUMERIC_TYPES = (T.DoubleType, T.FloatType, T.DecimalType)
INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class ColumnSpec:
    sdtype: str
    pii: bool = False
    datetime_format: str | None = None
    computer_representation: str | None = None


@dataclass
class TableSpec:
    columns: dict[str, ColumnSpec]
    primary_key: str | None = None
    alternate_keys: list[str] = field(default_factory=list)
    sequence_key: str | None = None
    sequence_index: str | None = None

    def of_type(self, *sdtypes: str) -> list[str]:
        return [c for c, spec in self.columns.items() if spec.sdtype in sdtypes]


@dataclass(frozen=True)
class Relationship:
    parent_table: str
    parent_key: str
    child_table: str
    child_key: str


@dataclass
class Metadata:
    tables: dict[str, TableSpec]
    relationships: list[Relationship] = field(default_factory=list)

    def keys_of(self, table: str) -> list[str]:
        """Primary, alternate, sequence and foreign keys, in column order."""
        spec = self.tables[table]
        keys = {spec.primary_key, spec.sequence_key, spec.sequence_index, *spec.alternate_keys}
        keys |= {r.child_key for r in self.relationships if r.child_table == table}
        keys |= {r.parent_key for r in self.relationships if r.parent_table == table}
        return [c for c in spec.columns if c in keys]

    def topological(self) -> list[str]:
        """Parents before children; a cycle is an error."""
        left, done = list(self.tables), []
        while left:
            ready = [t for t in left if all(
                r.parent_table in done or r.parent_table == t for r in self.relationships if r.child_table == t)]
            if not ready:
                raise ValueError("The relationships form a cycle.")
            done += ready
            left = [t for t in left if t not in ready]
        return done


def spark_type(spec: ColumnSpec) -> T.DataType:
    """Declared types win over inference; a formatted datetime is read as text and parsed."""
    representation = spec.computer_representation or ""
    if spec.sdtype == "numerical":
        return T.LongType() if representation.startswith(("Int", "UInt")) else T.DoubleType()
    if spec.sdtype == "boolean":
        return T.BooleanType()
    if spec.sdtype == "datetime":
        return T.StringType() if spec.datetime_format else T.TimestampType()
    return T.StringType()


def schema_of(table: TableSpec) -> T.StructType:
    return T.StructType([T.StructField(c, spark_type(s)) for c, s in table.columns.items()])


def infer_table(df: DataFrame, primary_key: str | None = None, ids: tuple[str, ...] = ()) -> TableSpec:
    """A spec from physical types, for tables that come without metadata."""
    columns = {}
    for f in df.schema.fields:
        if f.name == primary_key or f.name in ids:
            sdtype = "id"
        elif isinstance(f.dataType, (*NUMERIC_TYPES, *INTEGER_TYPES)):
            sdtype = "numerical"
        elif isinstance(f.dataType, T.BooleanType):
            sdtype = "boolean"
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            sdtype = "datetime"
        else:
            sdtype = "categorical"
        columns[f.name] = ColumnSpec(sdtype)
    return TableSpec(columns, primary_key=primary_key)


def metadata_from_dict(raw: dict) -> Metadata:
    tables = {}
    for name, table in raw.get("tables", {}).items():
        columns = {
            c: ColumnSpec(s["sdtype"], bool(s.get("pii", False)), s.get("datetime_format"), s.get("computer_representation"))
            for c, s in table.get("columns", {}).items()
        }
        tables[name] = TableSpec(
            columns, table.get("primary_key"), list(table.get("alternate_keys") or []),
            table.get("sequence_key"), table.get("sequence_index"),
        )
    edges = [
        Relationship(r["parent_table_name"], r["parent_primary_key"], r["child_table_name"], r["child_foreign_key"])
        for r in raw.get("relationships", [])
    ]
    return Metadata(tables, edges)
