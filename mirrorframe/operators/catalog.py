"""Dataset profiling over a column catalog, an edge list and record counts.

catalog: dataset, table_name, column_name, sdtype, is_primary_key;
edges: dataset, parent_table, child_table (one row per relationship);
counts: dataset, table_name, num_rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.session import materialize

# The columns of a dataset summary, in order.
SUMMARY_COLUMNS = [
    "Dataset", "Datasize_Size_MB", "Num_Tables", "Total_Num_Columns", "Total_Num_Columns_Categorical",
    "Total_Num_Columns_Numerical", "Total_Num_Columns_Datetime", "Total_Num_Columns_PII",
    "Total_Num_Columns_ID_NonKey", "Max_Num_Columns_Per_Table", "Total_Num_Rows", "Max_Num_Rows_Per_Table",
    "Num_Relationships", "Max_Schema_Depth", "Max_Schema_Branch",
]
FIXED_WIDTH_BYTES = 8


def metadata_counts(catalog: DataFrame) -> DataFrame:
    """Columns by semantic type, and the widest table. The type is tested before the key flag."""
    kind = (
        F.when(F.col("sdtype").isin("categorical", "boolean"), "categorical")
        .when(F.col("sdtype") == "numerical", "numerical")
        .when(F.col("sdtype") == "datetime", "datetime")
        .when(F.col("is_primary_key"), "key")
        .when(F.col("sdtype") == "id", "id")
        .otherwise("pii")
    )
    per_table = catalog.withColumn("kind", kind).groupBy("dataset", "table_name").agg(
        F.count(F.lit(1)).alias("columns"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("categorical", "numerical", "datetime", "pii", "id")],
    )
    return per_table.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("Num_Tables"),
        F.sum("columns").alias("Total_Num_Columns"),
        F.sum("categorical").alias("Total_Num_Columns_Categorical"),
        F.sum("numerical").alias("Total_Num_Columns_Numerical"),
        F.sum("datetime").alias("Total_Num_Columns_Datetime"),
        F.sum("pii").alias("Total_Num_Columns_PII"),
        F.sum("id").alias("Total_Num_Columns_ID_NonKey"),
        F.max("columns").alias("Max_Num_Columns_Per_Table"),
    )


def relationships(edges: DataFrame) -> DataFrame:
    """Number of edges and most edges of one parent, repeated pairs included."""
    per_parent = edges.groupBy("dataset", "parent_table").agg(F.count(F.lit(1)).alias("n"))
    return per_parent.groupBy("dataset").agg(
        F.sum("n").alias("Num_Relationships"), F.max("n").alias("Max_Schema_Branch")
    )


def schema_depth(catalog: DataFrame, edges: DataFrame) -> DataFrame:
    """Tables on the longest parent-to-child chain; 1 without edges. A cycle is an error, also one without a root.

    Graphs are contracted: a round takes away every table without children, and of the tables with one parent and one child
    those that come first by hash among such neighbours, whose two edges become one of their joint length. Each table
    keeps the longest chain found below it. Chains, trees and parallel branches shrink by a constant share a round,
    so the number of rounds grows with the logarithm of their length. A round that takes nothing away is left with cycles.
    """
    known = edges.select("dataset", F.col("parent_table").alias("u"), F.col("child_table").alias("v")).distinct()
    left = materialize(known.withColumn("length", F.lit(1).cast("bigint")))
    below = left.select("dataset", F.col("u").alias("node"), F.lit(0).cast("bigint").alias("below")).limit(0)
    count, level = left.count(), 0
    while count:
        left, below = _contracted(left, below, level)
        rest = left.count()
        if rest == count:
            raise ValueError("The relationships form a cycle.")
        count, level = rest, level + 1
    deepest = below.groupBy("dataset").agg((F.max("below") + 1).alias("depth"))
    return catalog.select("dataset").distinct().join(deepest, "dataset", "left").select(
        "dataset", F.coalesce("depth", F.lit(1).cast("bigint")).alias("Max_Schema_Depth")
    )


def _contracted(edges: DataFrame, below: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """One round: the edges (dataset, u, v, length) that are left, and the longest chains (dataset, node, below) known then."""
    down = edges.groupBy("dataset", F.col("u").alias("node")).agg(
        F.count(F.lit(1)).alias("children"), F.max("v").alias("child"), F.max("length").alias("length"))
    up = edges.groupBy("dataset", F.col("v").alias("node")).agg(F.count(F.lit(1)).alias("parents"), F.max("u").alias("parent"))
    nodes = materialize(down.join(up, ["dataset", "node"], "full"))
    ends = nodes.where("children is null").select("dataset", "node", F.lit(None).cast("string").alias("child"), F.lit(None).cast("bigint").alias("length"))
    single = nodes.where("parents = 1 and children = 1")
    inner = single.join(ends.select("dataset", F.col("node").alias("child")), ["dataset", "child"], "left_anti")
    rank = lambda name: F.xxhash64(F.lit(level), F.col(name))
    links = inner.select("dataset", "node", "parent", "child", "length")
    others = inner.select("dataset", F.col("node").alias("other"))
    near = links.select("dataset", "node", F.explode(F.array("parent", "child")).alias("other")).join(others, ["dataset", "other"])
    beaten = near.where((rank("other") < rank("node")) | (F.col("other") == F.col("node"))).select("dataset", "node").distinct()
    gone = materialize(
        ends.unionByName(links.join(beaten, ["dataset", "node"], "left_anti").select("dataset", "node", "child", "length"))
        .join(below, ["dataset", "node"], "left").select("dataset", "node", "child", "length", F.coalesce("below", F.lit(0).cast("bigint")).alias("below"))
    )
    into = edges.withColumnRenamed("length", "first").join(gone.withColumnRenamed("node", "v"), ["dataset", "v"])
    longer = into.select("dataset", F.col("u").alias("node"), (F.col("first") + F.col("below")).alias("below"))
    joined = into.where("child is not null").select("dataset", "u", F.col("child").alias("v"), (F.col("first") + F.col("length")).alias("length"))
    names = gone.select("dataset", "node")
    kept = edges.join(names.withColumnRenamed("node", "u"), ["dataset", "u"], "left_anti").join(names.withColumnRenamed("node", "v"), ["dataset", "v"], "left_anti")
    rest = kept.select("dataset", "u", "v", "length").unionByName(joined).groupBy("dataset", "u", "v").agg(F.max("length").alias("length"))
    return materialize(rest), materialize(below.unionByName(longer).groupBy("dataset", "node").agg(F.max("below").alias("below")))


def row_counts(records: DataFrame) -> DataFrame:
    """Records per table from (dataset, table_name) rows."""
    return records.groupBy("dataset", "table_name").agg(F.count(F.lit(1)).alias("num_rows"))


def count_tables(tables: dict[str, DataFrame], dataset: str) -> DataFrame:
    """Records per table of one dataset; each count is answered from parquet footers where there are any."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count(F.lit(1)).alias("num_rows")).select(
            F.lit(dataset).alias("dataset"), F.lit(name).alias("table_name"), "num_rows"
        )
        out = one if out is None else out.unionByName(one)
    return out


def total_rows(counts: DataFrame) -> DataFrame:
    return counts.groupBy("dataset").agg(
        F.sum("num_rows").alias("Total_Num_Rows"), F.max("num_rows").alias("Max_Num_Rows_Per_Table")
    )


def dataset_summary(
    catalog: DataFrame, edges: DataFrame, counts: DataFrame, listing: DataFrame | None = None
) -> DataFrame:
    """The 15-column profile, one row per dataset. `listing` supplies sizes (dataset_name, size_MB)."""
    table = metadata_counts(catalog).join(total_rows(counts), "dataset", "left")
    table = table.join(relationships(edges), "dataset", "left").fillna(0, ["Num_Relationships", "Max_Schema_Branch"])
    table = table.join(schema_depth(catalog, edges), "dataset", "left")
    if listing is None:
        table = table.withColumn("Datasize_Size_MB", F.lit(None).cast("double"))
    else:
        sizes = listing.select(F.col("dataset_name").alias("dataset"), F.col("size_MB").alias("Datasize_Size_MB"))
        table = table.join(sizes, "dataset", "left")
    return table.withColumnRenamed("dataset", "Dataset").select(*SUMMARY_COLUMNS)


def column_bytes(field: T.StructField):
    """Bytes of one value: text by its length, anything else eight; null takes none."""
    if isinstance(field.dataType, T.StringType):
        return F.coalesce(F.octet_length(field.name), F.lit(0)).cast("bigint")
    return F.when(F.col(field.name).isNotNull(), FIXED_WIDTH_BYTES).otherwise(0).cast("bigint")


def dataset_size(df: DataFrame) -> DataFrame:
    """Size of a table in megabytes of 10^6 bytes, in one scan."""
    total = F.lit(0).cast("bigint")
    for field in df.schema.fields:
        total = total + column_bytes(field)
    return df.agg((F.coalesce(F.sum(total), F.lit(0)).cast("double") / F.lit(1e6)).alias("size_MB"))
