"""Benchmark items inside long documents, by a MinHash containment search over items partitioned by size.

A signature of a long document says nothing of a short item in it, so only items are sketched: an item keeps its least
shingle hashes, as many as its size class needs for every document that holds the wanted share of its shingles to hold
one of them (all but the share, and one more). Documents look all their shingles up in these sketches; candidates
are verified by exact containment. No pair is missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorframe.llm import native
from mirrorframe.llm.native import shingle_hashes, word_hashes
from mirrorframe.session import materialize

WIDTH = 5
PERCENT = 80


def needed(size: Column, percent: int) -> Column:
    """Shingles of an item of that many that a document must hold."""
    return F.floor((size * percent + 99) / 100)


def item_sketches(items: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(item_id, width, members, n_item, least): distinct shingles of each item and its sketch.

    An item of fewer than `width` words is one shingle of all its words; one without words is left out. The size of
    a sketch depends on the size of the item alone.
    """
    words = items.select(F.col(id_col).alias("item_id"), word_hashes(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    own = F.least(F.lit(width), F.size("words"))
    by_width = reduce(
        lambda rest, k: F.when(own == k, F.array_distinct(shingle_hashes(F.col("words"), k))).otherwise(rest),
        range(1, width + 1), F.array().cast("array<bigint>"),
    )
    sized = words.select("item_id", own.alias("width"), by_width.alias("members")).withColumn("n_item", F.size("members"))
    count = (F.col("n_item") - needed(F.col("n_item"), percent) + 1).cast("int")
    return sized.withColumn("least", F.slice(F.array_sort("members"), F.lit(1), count))


def contained(
    docs: DataFrame, items: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment): the items that documents hold at least `percent` per cent of.

    Words are runs of letters and digits, lower-cased; shingles are `width` words. Containment is the share of an item's
    distinct shingles that are in the document's text. Texts that are null or without words hold nothing and are in
    nothing; a null id is returned as such; rows that repeat
    an id give equal pairs once. Other columns are ignored.

    Sketches and items are sent to all tasks if both have been counted and found small. Else hashes meet by a shuffle
    without the texts they come from, and a text's shingles are joined again, once for each of its candidates.
    """
    sketched = materialize(item_sketches(items, width, percent, item_id_col, item_text_col).withColumn("item", F.xxhash64("item_id", "members")))
    widths = sorted(r["width"] for r in sketched.select("width").distinct().collect())  # 1 to `width`
    if not widths:
        widths = [width]
    probes = sketched.select("item", F.explode("least").alias("hash"))
    members = sketched.select("item", "item_id", "members", "n_item")
    numbers = sketched.agg(F.sum("n_item")).first()[0] or 0
    row = F.xxhash64(id_col, text_col).alias("row")
    words = docs.select(F.col(id_col).alias("doc_id"), row, word_hashes(F.col(text_col)).alias("words"))
    shingled = words.select("doc_id", "row", reduce(F.concat, [shingle_hashes(F.col("words"), k) for k in widths]).alias("shingles"))
    if numbers <= native.SENT_NUMBERS and native.is_small(probes):
        # The outer form: with the inner one the optimiser filters on the size of the arrays, and computes them there again.
        hashed = shingled.select("doc_id", "shingles", F.explode_outer("shingles").alias("hash"))
        candidates, members = hashed.join(F.broadcast(probes), "hash"), F.broadcast(members)
    else:
        met = shingled.select("row", F.explode_outer("shingles").alias("hash")).join(probes, "hash").select("row", "item").distinct()
        candidates = shingled.join(met, "row")
    verified = candidates.join(members, "item").withColumn("n_shared", F.size(F.array_intersect("members", "shingles")))
    found = verified.where(F.col("n_shared") >= needed(F.col("n_item"), percent))
    return found.select("doc_id", "item_id", "n_item", "n_shared").distinct().withColumn("containment", F.col("n_shared") / F.col("n_item"))
