"""Packing tokenised documents into windows of fixed length by minimum bin slack."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.llm.tokens import batches_of_texts, word_ids

WINDOW = 2048
END_ID = 1
# Documents packed together; their last pieces, 4 KB each at most, are one task's working set.
GROUP_DOCS = 4096


def fullest(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """How many of each length to take so that their sum is the greatest up to `capacity`; `lengths` are ascending.

    Bit s of `reach` says that a sum s can be made. Each length enters as blocks of 1, 2, 4, ... copies, longest first,
    and the state before each block is kept to trace the blocks back; the search ends when the capacity is met.
    """
    mask, reach, steps = (1 << (capacity + 1)) - 1, 1, []
    for at in range(bisect_right(lengths, capacity) - 1, -1, -1):
        length = lengths[at]
        left, block = min(counts[length], capacity // length), 1
        while left > 0:
            block = min(block, left)
            steps.append((reach, length, block))
            reach |= (reach << (length * block)) & mask
            left, block = left - block, block * 2
        if reach >> capacity & 1:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for before, length, block in reversed(steps):
        if not before >> total & 1:
            taken[length] += block
            total -= length * block
    return taken


def windows(lengths: list[int], window: int) -> list[list[tuple[int, int, int]]]:
    """Windows of pieces (item, begin, end) that hold all items; each window but the last is exactly full.

    A window starts with the longest item left and takes the multiset that leaves least slack. Only if some slack is
    left is a further item cut to fill it; the rest of that item stays in the pool.
    """
    pool: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for item, length in enumerate(lengths):
        pool[length].append((item, 0, length))
    counts = {x: len(v) for x, v in pool.items()}
    order = sorted(counts)
    out = []

    def take(length: int) -> tuple[int, int, int]:
        counts[length] -= 1
        if not counts[length]:
            del counts[length]
            del order[bisect_left(order, length)]
        return pool[length].pop()

    while order:
        longest = order[-1]
        chosen, slack = [take(longest)], window - longest
        for length, n in fullest(counts, order, slack).items():
            chosen += [take(length) for _ in range(n)]
            slack -= length * n
        if slack and order:  # what is left is longer than the slack, or it would have been taken
            item, begin, end = take(order[0])
            chosen.append((item, begin, begin + slack))
            rest = end - begin - slack
            pool[rest].append((item, begin + slack, end))
            if rest not in counts:
                counts[rest] = 0
                insort(order, rest)
            counts[rest] += 1
        out.append(chosen)
    return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def pieces(docs: DataFrame, tokenizer: str, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Each document's ids with the closing one, cut into whole windows and a last piece, whose ids are kept."""

    def scan(batches):
        encode = word_ids(tokenizer)
        for batch in batches:
            for first, texts in batches_of_texts(batch.column(1)):
                where, ids = encode(texts)
                numbers = batch.column(0).slice(first, len(texts)).to_pylist()
                rows = []
                for row, number in enumerate(numbers):
                    own = np.append(ids[where[row] : where[row + 1]], np.array([end_id], ids.dtype))
                    for start in range(0, len(own), window):
                        part = own[start : start + window]
                        rows.append((number, start, len(part), _crc(part), len(own), None if len(part) == window else part.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    return docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(
        scan, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary"
    )


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]
_TYPES = [pa.int64()] * 5 + [pa.binary()]


def pack(
    docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID, group_docs: int = GROUP_DOCS,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece of a document.

    A document is its ids and `end_id`. Whole windows are cut off first and are sequences of their own; last pieces are
    packed in groups of about `group_docs` documents that are dealt by hash of the row's number as well, so neither a large group
    of equal rows nor the order of the table makes a task large. Each group has at most one window that is not full. A null
    text is empty: its document is `end_id` alone. Rows with null or repeated ids are packed like any other.
    """
    groups = max(1, math.ceil(docs.count() / group_docs))
    dtype = word_ids(tokenizer).dtype
    dealt = pieces(docs, tokenizer, window, end_id, id_col, text_col).withColumn("pack", F.pmod(F.xxhash64("doc_id", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))

    def step(table: pa.Table) -> pa.Table:
        group = table.column("pack")[0].as_py()
        fixed = {n: table.column(n).to_pylist() for n in _NAMES[:5]}
        whole = [row for row, n in enumerate(fixed["length"]) if n == window]
        parts = [row for row, n in enumerate(fixed["length"]) if n < window]
        blobs = table.column("ids").combine_chunks()
        out = [[fixed[n][row] for n in _NAMES[:5]] + [group << 32 | k, 0] for k, row in enumerate(whole)]
        for k, chosen in enumerate(windows([fixed["length"][row] for row in parts], window), len(whole)):
            offset = 0
            for item, begin, end in chosen:
                row = parts[item]
                cut = end - begin != fixed["length"][row]
                crc = _crc(np.frombuffer(blobs[row].as_buffer(), dtype)[begin:end]) if cut else fixed["ids_crc32"][row]
                out.append([fixed["doc_id"][row], fixed["start"][row] + begin, end - begin, crc, fixed["doc_tokens"][row], group << 32 | k, offset])
                offset += end - begin
        names = [*_NAMES[:5], "sequence_id", "offset"]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(names, zip(*out, strict=True), strict=True)})

    return dealt.groupBy("pack").applyInArrow(
        step, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
