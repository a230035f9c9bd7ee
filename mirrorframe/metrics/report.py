"""Quality and diagnostic reports: averages over the column and table metrics."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.functions import scalar as S
from mirrorframe.metrics import pairs as P
from mirrorframe.metrics import shapes, validity
from mirrorframe.sources.metadata import Metadata, TableSpec

NUMBERS = ("numerical", "datetime")
TEXTS = ("categorical", "boolean")


def modelled(table: TableSpec) -> tuple[list[str], list[str]]:
    return table.of_type(*NUMBERS), table.of_type(*TEXTS)


def read_datetimes(df: DataFrame, table: TableSpec) -> DataFrame:
    """Datetimes that are text in a declared format, as datetimes; text that does not parse is null."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    formats = {c: s.datetime_format for c, s in table.columns.items() if s.sdtype == "datetime" and s.datetime_format and c in text}
    return df.withColumns({c: S.from_micros(S.to_micros(F.col(c), f)) for c, f in formats.items()}) if formats else df


def _read(data: dict[str, DataFrame], metadata: Metadata) -> dict[str, DataFrame]:
    return {n: read_datetimes(data[n], t) for n, t in metadata.tables.items()}


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def _tagged(scores: DataFrame, name: str) -> DataFrame:
    return scores.select(F.lit(name).alias("property"), "score")


def _by_prefix(scores: DataFrame, column: str = "column") -> DataFrame:
    """The property is what precedes the first bar of the column's name."""
    return scores.select(F.substring_index(column, "|", 1).alias("property"), "score")


def _report(frames: list[DataFrame]) -> DataFrame:
    """Mean score per property, and over the properties."""
    properties = _union(frames).groupBy("property").agg(F.avg("score").alias("score"))
    # A handful of properties: one row, so nothing is computed twice for the mean over them.
    row = properties.agg(F.collect_list(F.struct("property", "score")).alias("all"), F.avg("score").alias("mean"))
    overall = F.struct(F.lit("overall").alias("property"), F.col("mean").alias("score"))
    return row.select(F.explode(F.concat("all", F.array(overall))).alias("p")).select("p.*")


def _quality(
    real: dict[str, DataFrame], synthetic: dict[str, DataFrame], metadata: Metadata
) -> DataFrame:
    """Counts of all tables and relationships are united first, so each metric is one plan for the dataset."""
    real, synthetic = _read(real, metadata), _read(synthetic, metadata)
    bounds = P.bounds_of({n: (real[n], t.of_type(*NUMBERS)) for n, t in metadata.tables.items()})
    numeric, textual, joint, frames = [], [], [], []
    cut = {}
    for name, table in metadata.tables.items():
        numbers, texts = modelled(table)
        prefix = f"column_shapes|{name}|"
        if numbers:
            numeric.append(shapes.paired_counts(real[name], synthetic[name], numbers, True, prefix))
        if texts:
            textual.append(shapes.paired_counts(real[name], synthetic[name], texts, False, prefix))
        if len(numbers) > 1:
            frames.append(_tagged(P.correlation_similarity(real[name], synthetic[name], numbers), "column_pair_trends"))
        mixed = [(a, b) for a, b in combinations([*texts, *numbers], 2) if not (a in numbers and b in numbers)]
        cut[name] = tuple(
            df.select(
                *metadata.keys_of(name), *[F.col(c).cast("string").alias(f"d|{c}") for c in texts],
                *[packed.alias(f"bins|{i}") for i, packed in enumerate(P.packed_bins(df, bounds[name]))])
            for df in (real[name], synthetic[name]))
        if mixed:
            plain = [_coded(df, "", texts) for df in cut[name]]
            joint.append(P.pair_counts(*plain, mixed, f"column_pair_trends|{name}|", _places(bounds[name], "")))
    for e in metadata.relationships:
        sides = [(d[e.parent_table], d[e.child_table]) for d in (real, synthetic)]
        numeric.append(validity.cardinality_counts(*sides, e.parent_key, e.child_key, f"cardinality|{e.parent_table}|"))
        between = _between(e, cut, metadata, bounds)
        if between is not None:
            joint.append(between)
    if numeric:
        frames.append(_by_prefix(shapes.ks_of_counts(_union(numeric))))
    if textual:
        frames.append(_by_prefix(shapes.tv_of_counts(_union(textual))))
    if joint:
        frames.append(_by_prefix(P.contingency_of_counts(_union(joint)), "column_a"))
    return _report(frames)


def _places(bounds: dict, prefix: str) -> dict[str, tuple[str, int]]:
    """Which packed column holds the bins of each column, and where."""
    return {f"{prefix}{c}": (f"{prefix}bins|{i // P.PACKED}", i % P.PACKED) for i, c in enumerate(bounds)}


def _coded(df: DataFrame, prefix: str, texts: list[str], key: str | None = None) -> DataFrame:
    """Texts and packed bins under names that begin with `prefix`, with a key as `_k`."""
    keys = [F.col(key).alias("_k")] if key else []
    bins = [c for c in df.columns if c.startswith("bins|")]
    return df.select(*keys, *[F.col(f"`d|{c}`").alias(f"{prefix}{c}") for c in texts], *[F.col(f"`{c}`").alias(f"{prefix}{c}") for c in bins])


def _between(edge, cut, metadata: Metadata, bounds: dict) -> DataFrame | None:
    """Joint counts of parent columns with child columns over linked rows; only bin codes are joined."""
    (p_numbers, p_texts), (c_numbers, c_texts) = (modelled(metadata.tables[t]) for t in (edge.parent_table, edge.child_table))
    pairs = [(f"p_{a}", f"c_{b}") for a in [*p_numbers, *p_texts] for b in [*c_numbers, *c_texts]]
    if not pairs:
        return None
    joined = []
    for parent, child in zip(cut[edge.parent_table], cut[edge.child_table], strict=True):
        left, right = _coded(parent, "p_", p_texts, edge.parent_key), _coded(child, "c_", c_texts, edge.child_key)
        joined.append(right.join(left, "_k").drop("_k"))
    packed = _places(bounds[edge.parent_table], "p_") | _places(bounds[edge.child_table], "c_")
    return P.pair_counts(*joined, pairs, f"inter_table_trends|{edge.parent_table}|{edge.child_table}|{edge.child_key}|", packed)


def quality_report(real: DataFrame, synthetic: DataFrame, table: TableSpec) -> DataFrame:
    """Column shapes and column pair trends of one table."""
    return _quality({"table": real}, {"table": synthetic}, Metadata({"table": table}))


def multi_table_quality_report(
    real: dict[str, DataFrame], synthetic: dict[str, DataFrame], metadata: Metadata
) -> DataFrame:
    """Adds cardinality per relationship and trends between linked tables."""
    return _quality(real, synthetic, metadata)


def _diagnostic(real: dict[str, DataFrame], synthetic: dict[str, DataFrame], metadata: Metadata) -> DataFrame:
    stored = real, synthetic
    real, synthetic = _read(real, metadata), _read(synthetic, metadata)
    bounds = P.bounds_of({n: (real[n], t.of_type(*NUMBERS)) for n, t in metadata.tables.items()})
    frames = []
    for name, table in metadata.tables.items():
        numbers, texts = modelled(table)
        if numbers:
            inside = validity.boundary_adherence(real[name], synthetic[name], numbers, bounds[name])
            frames.append(_tagged(inside, "data_validity"))
        if texts:
            frames.append(_tagged(validity.category_adherence(real[name], synthetic[name], texts), "data_validity"))
        for key in dict.fromkeys(k for k in (table.primary_key, *table.alternate_keys) if k):
            frames.append(_tagged(validity.key_uniqueness(synthetic[name], key), "data_validity"))
        overlap = validity.structure(stored[0][name].select(*table.columns), stored[1][name])
        # One row, taken from the table so the report stays a single plan.
        frames.append(synthetic[name].agg(F.lit("data_structure").alias("property"), F.lit(overlap).alias("score")))
    for e in metadata.relationships:
        valid = validity.referential_integrity(
            synthetic[e.child_table], e.child_key, synthetic[e.parent_table], e.parent_key)
        frames.append(_tagged(valid, "relationship_validity"))
    return _report(frames)


def diagnostic_report(real: DataFrame, synthetic: DataFrame, table: TableSpec) -> DataFrame:
    """Validity of values and keys, and structure."""
    return _diagnostic({"table": real}, {"table": synthetic}, Metadata({"table": table}))


def multi_table_diagnostic_report(
    real: dict[str, DataFrame], synthetic: dict[str, DataFrame], metadata: Metadata
) -> DataFrame:
    """Adds the validity of every relationship."""
    return _diagnostic(real, synthetic, metadata)


def overall(report: DataFrame) -> float | None:
    return report.where("property = 'overall'").first()["score"]
