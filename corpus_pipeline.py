"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again as the next one's
docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm import containment, minmax, packing, phrases, toxicity
from mirrorframe.llm.queries import table, tokenizer
from mirrorframe.session import scratch_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic."""
    scored = toxicity.toxicity_scores(docs, table(spark, sf_dir, "labels"), carry=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with `row`, a hash of id and text: different texts under one id, or under none, are rows of their own."""
    return docs.withColumn("row", F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.col("text").isNull()))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id, or if all are null, any of them.

    Rows that repeat an id with another text are documents of their own; of equal rows one stays.
    """
    rows = _keyed(docs)
    groups = minmax.near_duplicates(rows.select("row", "text"), id_col="row").select(F.col("doc_id").alias("row"), "component_id").distinct()
    named = rows.select("row", "doc_id").distinct().join(groups, "row")
    kept = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("k")).select("k.row")
    found = rows.join(kept, "row", "left_semi")
    # Only rows that are repeated as they stand meet here; they are few, or copies of each other.
    counts = rows.groupBy("row").agg(F.count("*").alias("rows")).where("rows > 1").select("row")
    repeated = found.join(counts, "row", "left_semi").groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("d"))
    return found.join(counts, "row", "left_anti").select(*COLUMNS).unionByName(repeated.select("d.*"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; a character that is cut goes as a whole.

    A document stays even if nothing of its text does; then the text is empty. A null text is left null.
    """

    left = phrases.removals(docs, carry=["lang", "source", F.col("text").isNull().alias("without")], as_text=True)
    text = F.when(~F.col("without"), F.col("kept"))
    return left.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; each row is judged by its own text, whatever its id."""
    rows = _keyed(docs)
    leaks = containment.contained(rows.select("row", "text"), table(spark, sf_dir, "benchmark"), id_col="row").select(F.col("doc_id").alias("row")).distinct()
    return rows.join(leaks, "row", "left_anti").select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences; an empty or null text is its closing id alone."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each_group),
    ("suffix_array_dedup", drop_repeated_passages),
    ("decontamination", drop_leaks),
    ("packing", pack),
]

# Tokenising and learning cannot be said in SQL; tests/llm/test_pipeline.py compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of `documents` after all stages; what lies between is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    place = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
