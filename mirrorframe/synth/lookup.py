"""Drawing from fitted value tables, and generating row frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.operators import prefix
from mirrorframe.session import materialize, spread

# Largest value list that is looked up as an array carried by every task; larger ones are joined.
SMALL_DOMAIN = 10_000
# Rows generated per task.
ROWS_PER_TASK = 2_000_000
# Longest array a single row is exploded into.
EXPLODE_CHUNK = 65_536


def row_ids(spark: SparkSession, n: int) -> DataFrame:
    """`id` from 0 to n-1, split so that no task generates more than ROWS_PER_TASK rows."""
    parts = max(min(spark.sparkContext.defaultParallelism, -(-n // 1000)), -(-n // ROWS_PER_TASK), 1)
    return spark.range(0, n, 1, parts)


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n) for all `columns` in one pass; values as text, null is a value.

    Each row is turned into its (column, value) pairs and counted map-side before the shuffle.
    """
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("p")
    return spread(df.select(*columns)).select(pairs).groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))


def domains(df: DataFrame, columns: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """Distinct values per column numbered from 0 in md5 order, and their number."""
    table = materialize(
        prefix.hash_numbered(value_counts(df, columns).select("column", "value"), ["column"], "value")
    )
    sizes = {r["column"]: r["n"] for r in table.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    return table, sizes


def pick(draws: DataFrame, idx: str, table: DataFrame, column: str, size: int, output: str) -> DataFrame:
    """Replace the number in `idx` by the value of that number."""
    values = table.where(F.col("column") == column).select(F.col("idx").alias("_i"), F.col("value").alias("_v"))
    if size <= SMALL_DOMAIN:
        listed = values.agg(F.array_sort(F.collect_list(F.struct("_i", "_v"))).alias("a")).scalar()
        value = F.element_at(listed, (F.col(idx) + 1).cast("int"))["_v"]
        return draws.withColumn(output, value).drop(*({idx} - {output}))
    return draws.join(values, F.col(idx) == F.col("_i")).withColumn(output, F.col("_v")).drop("_i", "_v", *({idx} - {output}))


def frequency_ranges(counts: DataFrame, part: list[str]) -> tuple[DataFrame, dict]:
    """Counts turned into consecutive ranges per `part`; also (total, distinct) per `part`."""
    table = materialize(prefix.hash_ranges(counts, part, "value", "n"))
    stats = table.groupBy(*part).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct"))
    sizes = {tuple(r[c] for c in part): (r["total"], r["distinct"]) for r in stats.collect()}
    return table, sizes


def range_lookup(
    draws: DataFrame, idx: str, ranges: DataFrame, total: int, distinct: int, output: str
) -> DataFrame:
    """Value whose [start, stop) holds the number in `idx`, a uniform draw from [0, total).

    A guide table: the numbers are cut into about four buckets per value and both sides meet on the
    bucket, so a draw sees about one candidate however skewed the frequencies are.
    """
    buckets = max(16, min(4 * distinct, total))
    width = max(1, -(-total // buckets))
    table = ranges.select(
        F.col("value").alias("_v"), F.col("start").alias("_start"), F.col("stop").alias("_stop")
    )
    table = explode_range(
        table, F.floor(F.col("_start") / width).cast("bigint"), F.floor((F.col("_stop") - 1) / width).cast("bigint"),
        "_bucket", longest=-(-total // width),
    )
    hit = (F.col("_b") == F.col("_bucket")) & (F.col(idx) >= F.col("_start")) & (F.col(idx) < F.col("_stop"))
    bucketed = draws.withColumn("_b", F.floor(F.col(idx) / width).cast("bigint"))
    return (
        bucketed.join(table, hit)
        .withColumn(output, F.col("_v"))
        .drop("_b", "_bucket", "_v", "_start", "_stop", *({idx} - {output}))
    )


def explode_range(df: DataFrame, first: Column, last: Column, output: str, longest: int) -> DataFrame:
    """One row per whole number in [first, last].

    `longest` bounds the numbers of one row. A long range is first cut into chunks that are spread over
    the cluster, so one hot row neither builds a huge array nor fills one task.
    """
    if longest <= EXPLODE_CHUNK:
        return df.withColumn(output, F.explode(F.sequence(first, last)))
    step = F.lit(EXPLODE_CHUNK).cast("bigint")
    chunks = (
        df.withColumn("_first", first).withColumn("_last", last).where("_first <= _last")
        .withColumn("_from", F.explode(F.sequence(F.col("_first"), F.col("_last"), step)))
        .withColumn("_to", F.least(F.col("_last"), F.col("_from") + (EXPLODE_CHUNK - 1)))
    )
    spread = chunks.repartition(F.col("_from"), F.col("_to"), F.col("_first"))
    return spread.withColumn(output, F.explode(F.sequence("_from", "_to"))).drop("_first", "_last", "_from", "_to")
