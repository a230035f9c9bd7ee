"""Near-duplicate documents by min-max hashing of word shingles.

Each permutation of the shingle hashes yields two values, the least and the greatest, so a signature costs half the
hash evaluations of plain MinHash and each value still agrees with probability equal to the Jaccard similarity.
Bands of `rows` values propose links; each link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorframe.llm import bytescan as B
from mirrorframe.llm.graph import components
from mirrorframe.session import materialize

WIDTH = 5
PERCENT = 80
# 48 bands of three permutations' minima and maxima: a pair at 0.8 is proposed with probability 1 - 5e-7.
BANDS = 48
PER_BAND = 3
PARTS = 256


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, n, s1, s2, bands): size of the shingle set, a 128-bit hash of it, and its band keys."""
    n_permutations = BANDS * PER_BAND
    schema = "id long, n long, s1 long, s2 long, bands array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors, shifts = B.constants(n_permutations, 11), B.constants(n_permutations, 12)
        weights = B.constants(2 * PER_BAND, 13)
        for batch in batches:
            for run in B.runs(batch.column(1)):
                rows, values = B.shingles(run, width)
                first, values = B.distinct(rows, values, run.rows)
                counts = np.diff(first)
                full = np.flatnonzero(counts)
                s1, s2 = np.zeros(run.rows, np.uint64), np.zeros(run.rows, np.uint64)
                keys = np.zeros((len(full), BANDS), np.uint64)
                if len(full):
                    at = first[full]
                    s1[full] = np.add.reduceat(B.mix(values, 1), at)
                    s2[full] = np.add.reduceat(B.mix(values, 2), at)
                    for band in range(BANDS):
                        total = np.full(len(full), band + 1, np.uint64)
                        for k in range(PER_BAND):
                            p = band * PER_BAND + k
                            hashed = values * factors[p] + shifts[p]
                            total += B.mix(np.minimum.reduceat(hashed, at), 3) * weights[2 * k]
                            total += B.mix(np.maximum.reduceat(hashed, at), 4) * weights[2 * k + 1]
                        keys[:, band] = B.mix(total, 100 + band)
                lists = pa.ListArray.from_arrays(
                    np.concatenate([[0], np.cumsum((counts > 0) * BANDS)]).astype(np.int32), keys.ravel().view(np.int64)
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(run.first, run.rows).cast(pa.int64()), pa.array(counts.astype(np.int64)),
                        pa.array(s1.view(np.int64), mask=counts == 0), pa.array(s2.view(np.int64), mask=counts == 0), lists,
                    ],
                    ["id", "n", "s1", "s2", "bands"],
                )

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, schema)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, members): the sorted 64-bit shingle hashes of each text, as bytes."""

    def scan(batches):
        for batch in batches:
            for run in B.runs(batch.column(1)):
                first, values = B.distinct(*B.shingles(run, width), run.rows)
                blobs = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), run.rows, [None, pa.py_buffer((first * 8).astype(np.int64)), pa.py_buffer(values)]
                ).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.rows).cast(pa.int64()), blobs], ["id", "members"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, "id long, members binary")


def measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, na, nb, shared, missing, beyond) for `pairs` (a, b): set sizes, common members, what of `a` is not in `b`, and of `b` not in `a`.

    `missing` and `beyond` are bitmaps of PARTS bits as four numbers: members are dealt over the bits by hash, and a bit is
    set if any of its members of one set is not in the other. Both joins are plain ones on exchanges of their own, so adaptive
    execution splits an `a` that has many partners.
    """

    def scan(batches):
        for batch in batches:
            sizes, bitmaps = np.zeros((3, batch.num_rows), np.int64), np.zeros((2, batch.num_rows, 4), np.uint64)
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                there, back = _within(x, y), _within(y, x)
                sizes[:, i] = len(x), len(y), there.sum()
                for side, lone in enumerate((x[~there], y[~back])):
                    bits = np.zeros(PARTS, np.uint8)
                    bits[(lone & np.uint64(PARTS - 1)).astype(np.int64)] = 1
                    bitmaps[side, i] = np.packbits(bits, bitorder="little").view(np.uint64)
            at = np.arange(0, 4 * batch.num_rows + 1, 4, dtype=np.int32)
            lists = [pa.ListArray.from_arrays(at, b.ravel().view(np.int64)) for b in bitmaps]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x) for x in sizes], *lists], ["a", "b", "na", "nb", "shared", "missing", "beyond"])

    of_b = sets.select(F.col("id").alias("b"), F.col("members").alias("of_b"))
    of_a = sets.select(F.col("id").alias("a"), F.col("members").alias("of_a"))
    joined = pairs.join(of_b, "b").join(of_a, "a").select("a", "b", "of_a", "of_b")
    return joined.mapInArrow(scan, "a long, b long, na long, nb long, shared long, missing array<long>, beyond array<long>")


def _within(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of the sorted `x` are in the sorted `y`."""
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x if len(y) else np.zeros(len(x), bool)


def _enough(shared: Column, x: Column, y: Column, percent: int) -> Column:
    return (shared > 0) & (100 * shared >= percent * (x + y - shared))


def _links(compared: DataFrame, percent: int) -> DataFrame:
    return compared.where(_enough(F.col("shared"), F.col("na"), F.col("nb"), percent)).select("a", "b").distinct()


def _near_in_size(x: str, y: str, percent: int) -> Column:
    return (100 * F.least(x, y)) >= (percent * F.greatest(x, y))


def _pivot_pairs(members: DataFrame, rank: Column, percent: int) -> DataFrame:
    """Each member with the least ranked pivot of its bands: a pair a member at most."""
    pivots = members.groupBy("band").agg(F.min(F.struct(rank.alias("rank"), "id", "n")).alias("p")).select(
        "band", F.col("p.rank").alias("rank"), F.col("p.id").alias("a"), F.col("p.n").alias("an")
    )
    pairs = members.join(pivots, "band").where((F.col("id") != F.col("a")) & _near_in_size("n", "an", percent))
    return pairs.groupBy("id").agg(F.min(F.struct("rank", "a")).alias("p")).select(F.col("p.a").alias("a"), F.col("id").alias("b"))


def _rest_pairs(members: DataFrame, compared: DataFrame, percent: int) -> DataFrame:
    """The pairs that share a band and may be linked, but are not known to be connected by pivots.

    Of two sets compared with the same pivot, what either lacks of it and has beyond it is known: their common members are at
    most those of the pivot in neither bitmap of missing ones, and of either's members beyond it those whose bit the
    other's bitmap has as well.
    """
    # An id with several sets has several rows; nothing is ruled out for it.
    once = compared.groupBy("b").agg(F.min(F.struct("a", "na", "nb", "shared", "missing", "beyond")).alias("k"), F.count("*").alias("rows")).where("rows = 1")
    known = once.select(
        F.col("b").alias("id"), F.col("k.a").alias("pivot"), F.col("k.na").alias("np"), (F.col("k.nb") - F.col("k.shared")).alias("others"),
        *[F.col("k.missing")[i].alias(f"m{i}") for i in range(4)], *[F.col("k.beyond")[i].alias(f"o{i}") for i in range(4)],
    )
    roots = components(materialize(_links(compared, percent))).withColumnRenamed("node", "id")
    placed = members.drop("degree").join(known, "id", "left").join(roots, "id", "left")
    placed = materialize(placed.withColumn("root", F.coalesce("root", "id")))
    mixed = placed.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    rows = placed.join(mixed, "band", "left_semi")
    x, y = (rows.select("band", *[F.col(c).alias(f"{side}_{c}") for c in rows.columns if c != "band"]) for side in "xy")
    lacking = sum((F.bit_count(F.col(f"x_m{i}").bitwiseOR(F.col(f"y_m{i}"))) for i in range(4)), F.lit(0))

    def common_beyond(own: str, other: str) -> Column:
        alone = [F.bit_count(F.col(f"{own}_o{i}").bitwiseAND(F.bitwise_not(f"{other}_o{i}"))) for i in range(4)]
        return F.col(f"{own}_others") - sum(alone, F.lit(0))

    most = F.col("x_np") - lacking + F.least(common_beyond("x", "y"), common_beyond("y", "x"))
    possible = F.coalesce(
        F.when(F.col("x_pivot") == F.col("y_pivot"), 100 * most >= percent * (F.col("x_n") + F.col("y_n") - most)), F.lit(True)
    )
    fresh = ~F.coalesce((F.col("x_pivot") == F.col("y_id")) | (F.col("y_pivot") == F.col("x_id")), F.lit(False))
    pairs = x.join(y, "band").where((F.col("x_root") < F.col("y_root")) & _near_in_size("x_n", "y_n", percent) & fresh & possible)
    return pairs.select(F.col("x_id").alias("a"), F.col("y_id").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of `docs`.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; a document's set is its distinct
    `width`-word shingles (all its words as one, if fewer). Documents are linked if their sets share `percent` per
    cent of their union; `component_id` is the least id reachable. Texts that are null or without words are linked
    with nothing. Rows that repeat an id count as one document with the links of each of them; a null id is linked
    with nothing, its component is null and it is kept. Other columns are ignored.

    Equal sets are merged before anything is compared. Each member of a band is compared with one pivot, the member
    that shares bands with most others. Pairs that share a band and are not joined by a pivot are compared one by
    one, but for those that what they lack of their pivot rules out; no proposed link is lost.
    """
    sketched = materialize(sketches(docs, id_col, text_col, width))
    known = sketched.where("id is not null and n > 0")
    classes = materialize(known.groupBy("s1", "s2").agg(F.min("id").alias("rep"), F.max("id").alias("last")))
    reps = classes.select(F.col("rep").alias("id"), "s1", "s2")
    banded = known.join(reps, ["id", "s1", "s2"], "left_semi").select("id", "n", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("band")
    members = materialize(banded.join(shared, "band", "left_semi").distinct())
    links = None
    if not members.isEmpty():
        ids = members.select(F.col("id").alias(id_col)).distinct()
        sets = materialize(shingle_sets(docs.join(ids, id_col, "left_semi"), id_col, text_col, width))
        sizes = members.groupBy("band").agg(F.count("*").alias("size"))
        degrees = members.join(sizes, "band").groupBy("id").agg(F.sum("size").alias("degree"))
        members = materialize(members.join(degrees, "id"))
        compared = materialize(measured(_pivot_pairs(members, -F.col("degree"), percent), sets))
        rest = measured(_rest_pairs(members, compared, percent), sets)
        links = _links(compared.unionByName(rest), percent)
    # One id may stand for several sets; its classes then belong together.
    same = known.select("id", "s1", "s2").join(classes.where("rep <> last"), ["s1", "s2"]).where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))
    edges = same if links is None else same.unionByName(links)
    roots = materialize(components(materialize(edges)))
    least = roots.groupBy("root").agg(F.min("node").alias("component_id"))
    final = roots.join(least, "root").select(F.col("node").alias("id"), "component_id")
    found = F.coalesce("component_id", "id")
    return sketched.join(final, "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), found.alias("component_id"), F.col("id").eqNullSafe(found).alias("kept")
    )
