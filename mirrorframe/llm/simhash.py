"""Near-duplicate documents by SimHash fingerprints and Golay-code fuzzy hashing.

A fingerprint is cut into three segments. Of two fingerprints that differ in at most two bits, one segment agrees exactly
(pigeonhole) and the segment after it differs in at most two bits, so both have a Golay key of that segment in common
(`golay`). Each distinct fingerprint is sent to (exact segment, key of the next) for all three segments, up to 18 places;
those that meet are verified by counting bits.

Where more than MEETING distinct fingerprints meet, as near copies of one text do by the thousand, comparing all of them
would be quadratic. They meet again by the words between them: each is sent to its own place and those that differ in one
bit; whoever meets there differs by two bits at most, and is linked with the least that is there. So every link is found, or
a path of links that connects the same fingerprints.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.llm import bytescan as B
from mirrorframe.llm import golay
from mirrorframe.llm.graph import components
from mirrorframe.session import materialize

WIDTH = 3
SEED = 42
BITS = 64
# Greatest number of differing bits that links; the keys are made for it.
DISTANCE = 2
# Bits of the three segments, from the lowest on.
SEGMENTS = (22, 21, 21)
# Distinct fingerprints that are compared with each other where they meet.
MEETING = 64
# Shingles whose bits are counted at once.
SHINGLES = 1 << 14

_SPACES_TO_ONE = bytes(B.LOWER)


def shingle_hashes(text: bytes, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each run of `width` words (of all words, if fewer), A-Z lower-cased and joined by single spaces; repeats stay."""
    words = text.translate(_SPACES_TO_ONE).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - width + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)], np.uint64)


def fingerprint(text: bytes, width: int = WIDTH) -> int:
    """Bit i is 1 if it is in over half of the shingles' hashes; 0 for a text without words."""
    hashes = shingle_hashes(text, width)
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), SHINGLES):
        part = hashes[at : at + SHINGLES].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, fp): the fingerprint of each text as a long; null counts as empty."""

    def scan(batches):
        for batch in batches:
            for run in B.runs(batch.column(1)):
                data = run.data.tobytes()
                found = np.array([fingerprint(data[a:b], width) for a, b in zip(run.offsets[:-1].tolist(), run.offsets[1:].tolist(), strict=True)], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.rows), pa.array(found.view(np.int64))], ["id", "fp"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(scan, "id long, fp long")


def places(distinct: DataFrame) -> DataFrame:
    """(fp, place): where each distinct fingerprint goes, one place for each segment and key of the segment after it."""

    def scan(batches):
        lows = np.cumsum([0, *SEGMENTS[:-1]])
        for batch in batches:
            fps = batch.column(0).to_numpy().view(np.uint64)
            parts = [(fps >> np.uint64(low)) & np.uint64((1 << bits) - 1) for low, bits in zip(lows, SEGMENTS, strict=True)]
            for at, exact in enumerate(parts):
                keys = golay.indices(parts[(at + 1) % len(parts)]).astype(np.uint64)
                found = ((np.uint64(at) << np.uint64(BITS - 2)) | (exact << np.uint64(golay.INDEX_BITS)))[:, None] | keys
                fresh = np.ones(found.shape, bool)
                fresh[:, 1:] = found[:, 1:] != found[:, :1]  # a key that is missing repeats the first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(fps, fresh.sum(axis=1)).view(np.int64)), pa.array(found[fresh].view(np.int64))], ["fp", "place"]
                )

    return distinct.select("fp").mapInArrow(scan, "fp long, place long")


def links(distinct: DataFrame) -> DataFrame:
    """(a, b) of distinct fingerprints, a <> b, at most DISTANCE bits apart; they connect all that such pairs connect."""
    sent = materialize(places(distinct))
    sizes = sent.groupBy("place").agg(F.count("*").alias("n")).where("n > 1")
    met = materialize(sent.join(sizes, "place"))
    few = met.where(F.col("n") <= MEETING).select("fp", "place")
    x, y = few.select("place", F.col("fp").alias("a")), few.select("place", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = x.join(y, "place").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    crowded = met.where(F.col("n") > MEETING).select("fp").distinct()
    one_bit = F.expr(f"transform(sequence(0, {BITS - 1}), i -> shiftleft(1L, i))")
    around = crowded.select("fp", F.explode(F.concat(F.array(F.col("fp")), F.transform(one_bit, lambda bit: F.col("fp").bitwiseXOR(bit)))).alias("between"))
    around = materialize(around)
    least = around.groupBy("between").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a <> last").select("between", "a")
    stars = around.join(least, "between").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of `docs`; fingerprints that differ in two bits or fewer are linked.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; shingles are `width` words joined by spaces (all
    words, if fewer), repeats included, hashed by XXH64 with seed 42. A fingerprint, shown as 16 hexadecimal digits, has
    the bits that are in over half the hashes; that of a text without words, or a null one, is zero and linked like any
    other. `component_id` is the least id reachable. A null id has a fingerprint but no component. Rows that repeat an id are
    one document with the links of each of them. Other columns are ignored.
    """
    known = materialize(fingerprints(docs, width, id_col, text_col))
    classes = materialize(known.where("id is not null").groupBy("fp").agg(F.min("id").alias("id"), F.max("id").alias("last")))
    linked = materialize(links(classes))
    # An id with several texts joins their fingerprints.
    several = known.where("id is not null").groupBy("id").agg(F.min("fp").alias("a"), F.max("fp").alias("last")).where("a <> last").select("id", "a")
    same = known.join(several, "id").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    roots = components(materialize(linked.unionByName(same))).select(F.col("node").alias("fp"), "root")
    placed = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    final = materialize(placed.join(least, "root").select("fp", "component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return known.join(final, "fp", "left").select(
        F.col("id").alias("doc_id"), shown.alias("fingerprint"), F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id")
    )
