"""Merkle manifest of a table by time-forward processing: a tree per group of rows, a tree over the groups, a proof per row.

Rows are numbered within their groups and cut into blocks of 2^BLOCK_BITS consecutive leaves. A block is swept in the order of
its nodes' labels (the last leaf below a node, then its level), in which children come before parents: a priority
queue holds the digests on their way to parents. The block's top is a leaf of the next, smaller round. Then rounds are
swept the other way: a queue in reversed order holds the proof suffixes on their way from parents to children. Between
blocks the queue is external: messages are rows, dealt by block and sorted by label along with the nodes they are for.

A sweep holds one block; a queue holds two messages a level. Trees of any size take log(leaves) / BLOCK_BITS rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorframe.session import materialize

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Two to this power are the leaves of a block.
BLOCK_BITS = 12
# Rows that a sweep gathers before it hands them on.
ROWS = 4096
NONE, LEFT, RIGHT = range(3)


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def framed(value: Column) -> Column:
    """`-` for null, else the length in bytes, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """(tree, doc_id, leaf, altered): a name of the row's lang, its digest, and its digest with 1 added to n_chars where `tampered`.

    Names of trees sort like the langs, null first. `altered` is null where nothing changes.
    """

    def leaf(n_chars: Column) -> Column:
        return F.unhex(F.sha2(F.concat(*[framed(n_chars if f == "n_chars" else F.col(f)) for f in FIELDS]), 256))

    changed = F.col("n_chars").cast("decimal(38,0)") + 1
    return docs.select(
        F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"), leaf(F.col("n_chars")).alias("leaf"),
        F.when(F.coalesce(tampered, F.lit(False)) & F.col("n_chars").isNotNull(), leaf(changed)).alias("altered"),
    )


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """`rows` with `pos`, from 0 within their `tree`, in ascending `order`; rows equal in it come in any order.

    Rows are range-partitioned, so no tree has to fit in a task; a slice counts for itself, and (tree, slice) totals, at most
    as many as there are slices in a tree, say where it begins.
    """
    # A number of its own lets equal rows go to several slices.
    own = materialize(rows.withColumn("own", F.monotonically_increasing_id()))
    keys = ["tree", *order, "own"]
    placed = materialize(own.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("own").withColumn("at", F.monotonically_increasing_id()))
    sliced = placed.withColumn("slice", F.shiftright("at", 33))
    counts = sliced.groupBy("tree", "slice").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("tree").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begins = counts.select("tree", "slice", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return sliced.join(begins, ["tree", "slice"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "slice", "shift")


def swept_up(below: list[bytes], height: int | None) -> list[list[bytes]]:
    """The digests of all levels, from the leaves `below` on; up to a single node, or to `height` levels above the leaves.

    Digests on their way wait in a queue, ordered by the label of the node that they are for.
    """
    last, levels, queue = len(below) - 1, [[]], []
    top = last.bit_length() if height is None else height
    for at, leaf in enumerate(below):
        heappush(queue, (at, 0, at, 0, leaf))
        while queue and queue[0][0] == at:
            _, level, index, _, arrived = heappop(queue)
            if level:
                while queue and queue[0][:2] == (at, level):
                    arrived += heappop(queue)[4]
                arrived = digest(arrived)
            if level == len(levels):
                levels.append([])
            levels[level].append(arrived)
            if level < top:
                parent = index >> 1
                heappush(queue, (min(((parent + 1) << (level + 1)) - 1, last), level + 1, parent, index, arrived))
    return levels


def swept_down(levels: list[list[bytes]]) -> Iterator[tuple[int, tuple | None]]:
    """(leaf, suffix), last leaf first: what to put beside it, level by level, as (side, sibling, suffix of the parent)."""
    last, queue = len(levels[0]) - 1, []
    heappush(queue, (-last, 1 - len(levels), 0, None))
    while queue:
        _, level, index, suffix = heappop(queue)
        level = -level
        if not level:
            yield index, suffix
            continue
        children = levels[level - 1][2 * index : 2 * index + 2]
        for k in range(len(children)):
            beside = (NONE, b"", suffix) if len(children) == 1 else (RIGHT if k == 0 else LEFT, children[1 - k], suffix)
            child = 2 * index + k
            heappush(queue, (-min(((child + 1) << (level - 1)) - 1, last), 1 - level, child, beside))


def steps(suffix: tuple | None) -> Iterator[tuple[int, bytes]]:
    while suffix is not None:
        side, sibling, suffix = suffix
        yield side, sibling


def written(path: Iterator[tuple[int, bytes]]) -> bytes:
    return b"".join(bytes([side]) + bytes.fromhex(sibling.decode()) for side, sibling in path)


def read(blob: bytes) -> list[tuple[int, bytes]]:
    out, at = [], 0
    while at < len(blob):
        size = 0 if blob[at] == NONE else 32
        out.append((blob[at], blob[at + 1 : at + 1 + size].hex().encode()))
        at += 1 + size
    return out


def folded(start: bytes, path) -> bytes:
    """The digest at the end of a path that starts at the digest `start`."""
    for side, sibling in path:
        start = digest(sibling + start if side == LEFT else start + sibling)
    return start


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each block; they come sorted by tree and block."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for _, block in groupby(rows, key=lambda r: (r["tree"], r["block"])):
        yield list(block)


def _gathered(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out = []
    for row in rows:
        out.append(row)
        if len(out) == ROWS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


_TOPS = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.binary()), ("alone", pa.binary())])
_MESSAGES = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("alone", pa.bool_()), ("suffix", pa.binary()), ("subroot", pa.binary()), ("root", pa.binary())])
_PROOFS = pa.schema(
    [("tree", pa.string()), ("doc_id", pa.int64()), *[(n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())]
)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def tops(nodes: DataFrame, bits: int) -> DataFrame:
    """(tree, pos, digest, alone) of each block of `nodes` (tree, pos, digest): its top after `bits` levels, and its single last node."""

    def sweep(batches):
        def found():
            for block in _blocks(batches):
                levels = swept_up([r["digest"].hex().encode() for r in block], bits)
                alone = next(level[0] for level in levels if len(level) == 1)
                yield block[0]["tree"], block[0]["block"], *[bytes.fromhex(x.decode()) for x in (levels[-1][0], alone)]

        return _gathered(found(), _TOPS)

    return _dealt(nodes.select("tree", F.shiftright("pos", bits).alias("block"), "pos", "digest")).mapInArrow(sweep, _ddl(_TOPS))


def rounds(nodes: DataFrame, bits: int) -> list[tuple[DataFrame, DataFrame]]:
    """(nodes, roots) round by round: the nodes of trees that are not done, and (tree, root) of those that this round finishes."""
    out = []
    while True:
        found = materialize(tops(nodes, bits))
        more = found.where("pos = 1").select("tree")
        first = found.where("pos = 0")
        out.append((nodes, materialize(first.join(more, "tree", "left_anti").select("tree", F.col("alone").alias("root")))))
        nodes = materialize(found.where("pos > 0").unionByName(first.join(more, "tree", "left_semi")).drop("alone"))
        if nodes.isEmpty():
            return out


def _delivered(nodes: DataFrame, messages: DataFrame, bits: int, final: bool) -> DataFrame:
    """Messages (tree, pos of a block, ...) passed on to the block's nodes; at the end the proofs of the leaves themselves."""

    def sweep(batches):
        def found():
            for message, *block in _blocks(batches):
                tree, first = message["tree"], message["block"] << bits
                levels = swept_up([r["digest"].hex().encode() for r in block], None if message["alone"] else bits)
                if not final:
                    for at, suffix in swept_down(levels):
                        yield tree, first + at, False, written(steps(suffix)) + message["suffix"], message["subroot"], message["root"]
                    continue
                beyond = read(message["suffix"])
                siblings, subroot, root = b"".join(s for _, s in beyond), message["subroot"].hex(), message["root"].hex()
                ends = {}  # paths that reach the block's top with the same digest go on alike
                for at, suffix in swept_down(levels):
                    row, path = block[at], list(steps(suffix))
                    start = levels[0][at] if row["altered"] is None else row["altered"].hex().encode()
                    there = folded(start, path)
                    if there not in ends:
                        ends[there] = folded(there, beyond).decode()
                    proof = digest(b"".join(s for _, s in path) + siblings).decode()
                    yield tree, row["doc_id"], levels[0][at].decode(), subroot, root, proof, ends[there], ends[there] == root

        return _gathered(found(), _PROOFS if final else _MESSAGES)

    have = [c for c in ("doc_id", "altered") if c in nodes.columns]
    sent = messages.select("tree", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), "alone", "suffix", "subroot", "root")
    both = nodes.select("tree", F.shiftright("pos", bits).alias("block"), "pos", "digest", *have).unionByName(sent, allowMissingColumns=True)
    return _dealt(both).mapInArrow(sweep, _ddl(_PROOFS if final else _MESSAGES))


def passed_down(found: list[tuple[DataFrame, DataFrame]], ends: DataFrame, bits: int, final: bool) -> DataFrame:
    """From `ends` (tree, suffix, subroot, root), what each tree's root is told, to the nodes of the first round."""
    later = None
    for k in reversed(range(len(found))):
        nodes, roots = found[k]
        own = ends.join(roots.select("tree"), "tree").select("tree", F.lit(0).cast("long").alias("pos"), F.lit(True).alias("alone"), "suffix", "subroot", "root")
        messages = own if later is None else own.unionByName(later)
        later = _delivered(nodes, messages, bits, final and k == 0)
        if k:
            later = materialize(later)
    return later


def manifest(docs: DataFrame, tampered: Column | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row of `docs` (doc_id, source, lang, n_chars, text).

    H is the lowercase hexadecimal SHA-256 of its inputs, joined; digests enter as text. A leaf is H of the five columns, each `-`
    if null, else its bytes in UTF-8, counted, a colon and the value. The leaves of a lang ascend by doc_id (null first;
    rows that repeat an id by their digests); while several are left, two neighbours, or a last one alone, become their
    H; the last is the subroot. Subroots ascend by lang (null first, by bytes) and make the root alike. `proof_sha256` is H of
    the siblings of a leaf up to the root. `folded_root` is the root as computed from those siblings and the leaf, where
    `tampered` holds the leaf of the row with 1 added to n_chars (a null stays); `verified` is whether it is the
    root. An empty table has no rows; other columns are ignored.
    """
    rows = leaves(docs, F.lit(False) if tampered is None else tampered)
    nodes = materialize(numbered(rows, ["doc_id", "leaf"]).withColumnRenamed("leaf", "digest"))
    per_lang = rounds(nodes, bits)
    subroots = per_lang[0][1]
    for _, more in per_lang[1:]:
        subroots = subroots.unionByName(more)
    # The tree over langs: one more forest, of a single tree whose leaves are the subroots.
    order = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("root").alias("digest"))
    langs = materialize(numbered(order, ["name"]))
    over = rounds(langs, bits)
    empty = F.lit(b"")
    ends = over[0][1]
    for _, more in over[1:]:
        ends = ends.unionByName(more)
    told = materialize(passed_down(over, ends.select("tree", empty.alias("suffix"), F.col("root").alias("subroot"), "root"), bits, False))
    per_tree = langs.join(told.drop("tree"), "pos").select(F.col("name").alias("tree"), "suffix", F.col("digest").alias("subroot"), "root")
    return passed_down(per_lang, per_tree, bits, True).drop("tree")
