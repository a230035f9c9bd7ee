"""Repeated passages across documents, by prefix-free parsing.

A rolling hash over each text picks triggers: every `length`-byte string has exactly one, chosen by its own content
alone. The windows that share a trigger occurrence form a phrase (the text they cover), so equal windows always lie in
phrases with equal triggers. The corpus is handled as this parse:

1. triggers that occur in one document only are set aside (nearly all of the text ends here),
2. phrases of the others are named; a trigger whose occurrences all lie in one same phrase is settled by the
   parse alone, since all suffixes of that phrase have the same documents,
3. where phrases with the same trigger differ, the distinct ones make a dictionary. Its suffixes are sorted by prefix doubling,
   up to `length` bytes; equal suffixes are neighbours in that order, and the documents in which the parse has their
   phrases say which is the least. A verdict covers a run of a phrase's windows.
4. A trigger with very many phrases (a common line in ever new surroundings) would make one dictionary too large: its suffixes are
   dealt by a hash of their first `length` bytes instead, so no task gathers more than a slice of them.

Names are 64-bit hashes and travel packed by (chunk of documents, slice of the name space). A chunk sends each name and
each phrase once, so a passage that all documents hold costs one entry a chunk wherever it is gathered.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.llm import bytescan as B

LENGTH = 50
# Bytes hashed to pick triggers, and bytes of the string that names a trigger.
PICK = 8
NAME = 20
# Text bytes in a chunk, and text bytes whose names one slice gathers.
CHUNK_BYTES = 4 << 20
SLICE_BYTES = 16 << 20
# Parts of a slice whose differing phrases make a dictionary of their own: sorting its suffixes takes many times its size.
DICTIONARIES = 4
# Bytes parsed at once; the working arrays of a parse are some 80 times as large.
PARSED_BYTES = 1 << 17

_PACKED = "slice long, chunk long, names binary"
# Kinds of verdict: a trigger all of whose windows have one least document, one whose phrases differ, one with too many of
# them for a dictionary, a window, and a run of windows of a phrase.
WHOLE, SPLIT, CROWDED, SINGLE, RUN = range(5)
# Different phrases of one trigger that a chunk sends, and that a dictionary takes.
CROWD, MOST_PHRASES = 64, 1 << 14
_MARK = np.uint64(2**64 - 1)


class Parse:
    """The phrases of one run of texts: windows lo..hi (first and last start) of `row` share the trigger named `name`."""

    def __init__(self, run: B.Run, known: np.ndarray, length: int):
        self.run, self.length = run, length
        self.rolling = B.Rolling(run.data)
        n = len(run.data)
        none = np.zeros(0, np.int64)
        self.row = self.lo = self.hi = none
        self.name = np.zeros(0, np.uint64)
        if n < length:
            return
        words = np.ndarray((n - PICK + 1,), "<u8", run.data.tobytes(), strides=(1,))
        least = words * np.uint64(0x9E3779B97F4A7C15)
        least &= np.uint64(0xFFFFFFFF00000000)
        least |= np.arange(n - PICK + 1, dtype=np.uint64)
        width, have = length - PICK + 1, 1
        while 2 * have <= width:
            least = np.minimum(least[:-have], least[have:])
            have *= 2
        if width > have:
            least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
        starts = np.arange(len(least), dtype=np.int64)
        gap = least.astype(np.uint32).astype(np.int64) - starts
        # Modulo the starts that a name may have; a gap is hardly ever more than once that.
        spread = length - NAME + 1
        np.subtract(gap, spread, out=gap, where=gap >= spread)
        if width > 2 * spread:
            gap %= spread
        trigger = starts + gap
        # Windows that end within their text; a text of fewer bytes has none.
        valid = np.zeros(len(least) + 1, np.int32)
        sizes = np.diff(run.offsets)
        long = known & (sizes >= length)
        np.add.at(valid, run.offsets[:-1][long], 1)
        np.add.at(valid, run.offsets[1:][long] - length + 1, -1)
        valid = np.cumsum(valid[:-1], dtype=np.int32) > 0
        # Where a phrase ends or the windows do, and the next begins.
        turns = trigger[1:] != trigger[:-1]
        fresh, last = valid.copy(), valid.copy()
        fresh[1:] &= turns | ~valid[:-1]
        last[:-1] &= turns | ~valid[1:]
        self.lo, self.hi = np.flatnonzero(fresh), np.flatnonzero(last)
        self.row = np.searchsorted(run.offsets, self.lo, "right") - 1
        self.name = self.rolling(trigger[self.lo], trigger[self.lo] + NAME)

    def phrase(self, which: np.ndarray) -> np.ndarray:
        """Names of the phrases: hashes of all that their windows cover, and where the trigger lies in it."""
        lo, hi = self.lo[which], self.hi[which]
        return B.mix(self.rolling(lo, hi + self.length) + (hi - lo).astype(np.uint64), 21)

    def suffixes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase, start) of the windows of some phrases."""
        sizes = self.hi[which] - self.lo[which] + 1
        owner = np.repeat(which, sizes)
        return owner, self.lo[owner] + (np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes))

    def windows(self, starts: np.ndarray) -> np.ndarray:
        return self.rolling(starts, starts + self.length)


def _parses(table: pa.Table, length: int):
    ids, texts = table.column("id").combine_chunks(), table.column("text").combine_chunks()
    known = ~ids.is_null().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for run in B.runs(texts, PARSED_BYTES):
        part = slice(run.first, run.first + run.rows)
        yield run, Parse(run, known[part], length), numbers[part], known[part]


def _buffers(blobs: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without nulls, joined, and where each value begins, and the end."""
    if isinstance(blobs, pa.ChunkedArray):
        blobs = blobs.combine_chunks()
    blobs = blobs.cast(pa.large_binary())
    if not len(blobs):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = blobs.buffers()
    offsets = np.frombuffer(where, np.int64)[blobs.offset : blobs.offset + len(blobs) + 1]
    joined = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return joined, offsets - offsets[0]


def _blobs(records: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary value for each of `counts` consecutive records."""
    records = np.ascontiguousarray(records)
    ends = np.concatenate([[0], np.cumsum(counts)]) * (records.itemsize * (records.shape[1] if records.ndim > 1 else 1))
    kind, width = (pa.binary(), np.int32) if ends[-1] < 2**31 else (pa.large_binary(), np.int64)
    return pa.Array.from_buffers(kind, len(counts), [None, pa.py_buffer(ends.astype(width)), pa.py_buffer(records)]).cast(pa.binary())


def _records(table: pa.Table, fields: int) -> tuple[np.ndarray, np.ndarray]:
    """The records of all rows, one below the other, and how many each row has; a field of 0 stands for places, returned with their slices."""
    data, offsets = _buffers(table.column("names"))
    kind = np.uint64 if fields else np.uint32
    counts = np.diff(offsets) // (np.dtype(kind).itemsize * max(fields, 1))
    found = np.frombuffer(data.tobytes(), kind)
    if not fields:
        found = found.astype(np.uint64) | np.repeat(table.column("slice").to_numpy().astype(np.uint64) << np.uint64(32), counts)
    return found.reshape(-1, max(fields, 1)), counts


def _unpacked(table: pa.Table, fields: int) -> np.ndarray:
    return _records(table, fields)[0]


def _places(names: np.ndarray, slices: int) -> np.ndarray:
    """Where names lie: the slice in the upper 32 bits, the place within it in the lower ones; ascending with the name."""
    n, half = np.uint64(slices), np.uint64(32)
    return (names >> half) * n + (((names & np.uint64(0xFFFFFFFF)) * n) >> half)


def _packed(chunk: int, records: np.ndarray, slices: int, short: bool = False) -> pa.Table:
    """Records (name first, ascending) by slice of the name space; `short` ones are the names' places within their slice."""
    places = _places(records[:, 0], slices)
    at, first = np.unique(places >> np.uint64(32), return_index=True)
    ends = np.append(first, len(records))[1:]
    sent = places.astype(np.uint32) if short else records
    return pa.table({"slice": pa.array(at.astype(np.int64)), "chunk": pa.array(np.full(len(at), chunk, np.int64)), "names": _blobs(sent, ends - first)})


def _per_name(names: np.ndarray, ids: np.ndarray, phrases: np.ndarray | None = None) -> np.ndarray:
    """(name, phrase, id), ascending: the least and the greatest id of each name and phrase, once if they are the same."""
    if not len(names):
        return np.zeros((0, 2 + (phrases is not None)), np.uint64)
    order = np.argsort(names, kind="stable") if phrases is None else np.lexsort((phrases, names))
    names, ids = names[order], ids[order]
    fresh = np.ones(len(names), bool)
    fresh[1:] = names[1:] != names[:-1]
    columns = [names]
    if phrases is not None:
        phrases = phrases[order]
        fresh[1:] |= phrases[1:] != phrases[:-1]
        columns.append(phrases)
    at = np.flatnonzero(fresh)
    least, greatest = np.minimum.reduceat(ids, at), np.maximum.reduceat(ids, at)
    group = np.repeat(np.arange(len(at)), 1 + (least != greatest))
    second = np.concatenate([[False], group[1:] == group[:-1]])
    found = np.where(second, greatest[group], least[group]).view(np.uint64)
    return np.stack([*[c[at][group] for c in columns], found], axis=1)


def _member(sorted_names: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each name is among the sorted ones, and where."""
    if not len(sorted_names):
        return np.zeros(len(names), bool), np.zeros(len(names), np.int64)
    at = np.minimum(np.searchsorted(sorted_names, names), len(sorted_names) - 1)
    return sorted_names[at] == names, at


def _sorted(records: np.ndarray) -> np.ndarray:
    return records[np.argsort(records[:, 0], kind="stable")]


def removals(
    docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str | Column] = (), as_text: bool = False
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): what is left of each text, per row of `docs`.

    Removed is each UTF-8 byte covered by a `length`-byte string that also starts in a text with a smaller id, judged on
    the input; `kept` are the remaining bytes, which may begin or end within a character; `as_text` drops
    what is left of such a character and makes them a string. A null text is empty. A row
    with a null id is left whole and takes nothing from others; rows that repeat an id do not count against each
    other. Columns in `carry` follow; others are ignored.
    """
    if length < NAME + PICK:
        raise ValueError(f"length must be at least {NAME + PICK}")
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks, slices = max(1, math.ceil(total / CHUNK_BYTES)), max(1, math.ceil(total / SLICE_BYTES))
    dealt = named.withColumn("chunk", F.pmod(F.xxhash64("id"), F.lit(chunks)))

    def over_chunks(replies: DataFrame | None, step: Callable, schema: str) -> DataFrame:
        if replies is None:
            return dealt.groupBy("chunk").applyInArrow(lambda t: step(t, None), schema)
        return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(step, schema)

    def triggers(table: pa.Table, _) -> pa.Table:
        found = [(p.name, ids[p.row]) for _, p, ids, _ in _parses(table, length)]
        records = _per_name(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])) if found else np.zeros((0, 2), np.uint64)
        # A name that two documents of the chunk hold is sent twice. 32 bits of it do: a few names more seem shared.
        return _packed(table.column("chunk")[0].as_py(), records, slices, short=True)

    def shared(table: pa.Table) -> pa.Table:
        names, counts = np.unique(_unpacked(table, 0), return_counts=True)
        return _answer(table, 0, names[counts > 1].reshape(-1, 1))

    def phrases(table: pa.Table, reply: pa.Table) -> pa.Table:
        wanted = np.sort(_unpacked(reply, 0)[:, 0])
        found = []
        for _, p, ids, _ in _parses(table, length):
            which = np.flatnonzero(_member(wanted, _places(p.name, slices))[0])
            found.append((p.name[which], p.phrase(which), ids[p.row[which]]))
        names, named_phrases, ids = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64),) * 3
        records = _per_name(names, ids, named_phrases)
        if len(records):
            # A trigger with many phrases in this chunk alone is named once.
            at = np.flatnonzero(np.concatenate([[True], records[1:, 0] != records[:-1, 0]]))
            sizes = np.diff(np.append(at, len(records)))
            records[at[sizes > 2 * CROWD], 1] = _MARK
            keep = np.repeat(sizes <= 2 * CROWD, sizes)
            keep[at] = True
            records = records[keep]
        return _packed(_chunk(table, reply), records, slices)

    def dictionary(table: pa.Table) -> pa.Table:
        records = _unpacked(table, 3)
        if not len(records):
            return _answer(table, 3, np.zeros((0, 2), np.uint64))
        records = records[np.lexsort((records[:, 1], records[:, 0]))]
        fresh = np.concatenate([[True], records[1:, 0] != records[:-1, 0]])
        at = np.flatnonzero(fresh)
        different = fresh | np.concatenate([[True], records[1:, 1] != records[:-1, 1]])
        phrases_of = np.add.reduceat(different.astype(np.int64), at)
        crowded = (phrases_of > MOST_PHRASES) | (np.maximum.reduceat(records[:, 1], at) == _MARK)
        split = phrases_of > 1
        least, greatest = np.minimum.reduceat(records[:, 2].view(np.int64), at), np.maximum.reduceat(records[:, 2].view(np.int64), at)
        found = np.stack([records[at, 0], least.view(np.uint64)], axis=1)
        several = (least < greatest) | crowded
        parts = [(found[several & ~split & ~crowded], WHOLE), (found[several & split & ~crowded, :1], SPLIT), (found[crowded, :1], CROWDED)]
        return pa.concat_tables([_answer(table, 3, verdicts, kind) for verdicts, kind in parts])

    def suffixes(table: pa.Table, reply: pa.Table) -> pa.Table:
        split, crowded = (_sorted(_unpacked(_of_kind(reply, kind), 1))[:, 0] for kind in (SPLIT, CROWDED))
        found, contents = [], {}
        for run, p, ids, _ in _parses(table, length):
            owner, starts = p.suffixes(np.flatnonzero(_member(crowded, p.name)[0]))
            found.append((p.windows(starts), ids[p.row[owner]]))
            which = np.flatnonzero(_member(split, p.name)[0])
            named = zip(p.name[which].tolist(), p.phrase(which).tolist(), ids[p.row[which]].tolist(), p.lo[which].tolist(), p.hi[which].tolist(), strict=True)
            for name, phrase, number, lo, hi in named:
                known = contents.get((name, phrase))
                if known is None:
                    contents[name, phrase] = [number, number, run.data[lo : hi + length].tobytes()]
                elif number < known[0]:
                    known[0] = number
                elif number > known[1]:
                    known[1] = number
        names, ids = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        chunk = _chunk(table, reply)
        return pa.concat_tables([_packed(chunk, _per_name(names, ids), slices), _contents(chunk, contents, slices)])

    def order(table: pa.Table) -> pa.Table:
        if table.num_rows and table.column("slice")[0].as_py() >= slices:
            return _dictionary_order(table, length)
        records = _sorted(_unpacked(table, 2))
        if not len(records):
            return _answer(table, 2, np.zeros((0, 2), np.uint64))
        at = np.flatnonzero(np.concatenate([[True], records[1:, 0] != records[:-1, 0]]))
        least, greatest = np.minimum.reduceat(records[:, 1].view(np.int64), at), np.maximum.reduceat(records[:, 1].view(np.int64), at)
        return _answer(table, 2, np.stack([records[at, 0], least.view(np.uint64)], axis=1)[least < greatest], SINGLE)

    def remove(table: pa.Table, reply: pa.Table) -> pa.Table:
        whole, single = (_sorted(_unpacked(_of_kind(reply, kind), 2)) for kind in (WHOLE, SINGLE))
        split, crowded = (_sorted(_unpacked(_of_kind(reply, kind), 1))[:, 0] for kind in (SPLIT, CROWDED))
        runs_of = _sorted(_unpacked(_of_kind(reply, RUN), 3))
        out = {"doc_id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        carried = table.column("carried").combine_chunks()
        for run, p, ids, known in _parses(table, length):
            edges = np.zeros(len(run.data) + 1, np.int32)
            hit, at = _member(whole[:, 0], p.name)
            which = np.flatnonzero(hit)
            which = which[whole[at[which], 1].view(np.int64) < ids[p.row[which]]]
            np.add.at(edges, p.lo[which], 1)
            np.add.at(edges, p.hi[which] + length, -1)
            which = np.flatnonzero(_member(split, p.name)[0])
            named = p.phrase(which)
            first, end = (np.searchsorted(runs_of[:, 0], named, side) for side in ("left", "right"))
            which, sizes = np.repeat(which, end - first), end - first
            at = np.arange(len(which)) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)
            earlier = runs_of[at, 2].view(np.int64) < ids[p.row[which]]
            which, bounds = which[earlier], runs_of[at[earlier], 1]
            np.add.at(edges, p.lo[which] + (bounds >> np.uint64(32)).astype(np.int64), 1)
            np.add.at(edges, p.lo[which] + (bounds & np.uint64(0xFFFFFFFF)).astype(np.int64) + length, -1)
            owner, starts = p.suffixes(np.flatnonzero(_member(crowded, p.name)[0]))
            hit, at = _member(single[:, 0], p.windows(starts))
            some = np.flatnonzero(hit)
            some = some[single[at[some], 1].view(np.int64) < ids[p.row[owner[some]]]]
            np.add.at(edges, starts[some], 1)
            np.add.at(edges, starts[some] + length, -1)
            gone = np.cumsum(edges[:-1]) > 0
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            inner = run.offsets[(run.offsets > 0) & (run.offsets < len(gone))]
            begins[inner] = gone[inner]
            lost, opened = np.concatenate([[0], np.cumsum(gone)]), np.concatenate([[0], np.cumsum(begins)])
            left = run.data[~gone].tobytes()
            keep = np.concatenate([[0], np.cumsum(~gone)])[run.offsets]
            blobs = [left[a:b] for a, b in zip(keep[:-1], keep[1:], strict=True)]
            out["doc_id"].append(pa.array(ids, pa.int64(), mask=~known))
            out["n_bytes"].append(pa.array(np.diff(run.offsets)))
            out["n_removed"].append(pa.array(np.diff(lost[run.offsets]).astype(np.int64)))
            out["n_spans"].append(pa.array(np.diff(opened[run.offsets]).astype(np.int64)))
            out["kept_sha256"].append(pa.array([hashlib.sha256(x).hexdigest() for x in blobs], pa.string()))
            out["kept"].append(pa.array([x.decode("utf-8", "ignore") for x in blobs], pa.string()) if as_text else pa.array(blobs, pa.binary()))
        columns = {k: pa.chunked_array(v, type=t) for (k, v), t in zip(out.items(), [pa.int64()] * 4 + [pa.string(), pa.string() if as_text else pa.binary()], strict=True)}
        pa.default_memory_pool().release_unused()
        return pa.table(columns | {"carried": carried})

    def over_slices(packed: DataFrame, step: Callable) -> DataFrame:
        return packed.groupBy("slice").applyInArrow(step, _PACKED)

    common = over_slices(over_chunks(None, triggers, _PACKED), shared)
    settled = over_slices(over_chunks(common, phrases, _PACKED), dictionary)
    ordered = over_slices(over_chunks(settled, suffixes, _PACKED), order)
    schema = T.StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept " + ("string" if as_text else "binary")).add(named.schema["carried"])
    removed = over_chunks(settled.unionByName(ordered), remove, schema)
    names = [f.name for f in named.schema["carried"].dataType.fields[1:]]
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", *[F.col("carried")[n].alias(n) for n in names])


def _contents(chunk: int, contents: dict, slices: int) -> pa.Table:
    """Phrases with their bytes, by part of a slice: how many, then (phrase, least id, greatest id, size) of each, then all bytes, filled up to eight."""
    ordered = sorted(contents)
    places = (_places(np.array([name for name, _ in ordered], np.uint64), slices * DICTIONARIES) >> np.uint64(32)).astype(np.int64)
    at, first = np.unique(places, return_index=True)
    entries = [contents[x] for x in ordered]
    least, greatest = (np.array([e[k] for e in entries], np.int64).view(np.uint64) for k in (0, 1))
    sizes = np.array([len(e[2]) for e in entries], np.uint64)
    heads = np.stack([np.array([phrase for _, phrase in ordered], np.uint64), least, greatest, sizes], axis=1).reshape(-1, 4)
    blobs = []
    for a, b in zip(first, np.append(first, len(ordered))[1:], strict=True):
        blob = np.uint64(b - a).tobytes() + heads[a:b].tobytes() + b"".join([e[2] for e in entries[a:b]])
        blobs.append(blob + bytes(-len(blob) % 8))
    return pa.table({"slice": pa.array(at + slices, pa.int64()), "chunk": pa.array(np.full(len(at), chunk, np.int64)), "names": pa.array(blobs, pa.binary())})


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each of some ranges, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(first - (np.cumsum(sizes) - sizes), sizes)


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """For each start the place of the `length` bytes from there among all such strings, in their order; zeros follow the end.

    Ranks of 8 bytes are paired to ranks of 16, 32, ... (prefix doubling), the last pair overlapping.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8 + 2 * length, np.uint8)])
    first = np.ndarray((n + 2 * length,), ">u8", padded.tobytes(), strides=(1,)).astype(np.uint64)
    rank, have = np.unique(first, return_inverse=True)[1].astype(np.uint64), 8
    while have < length:
        step = min(have, length - have)
        rank = np.unique(rank[:-step] * np.uint64(len(padded)) + rank[step:], return_inverse=True)[1].astype(np.uint64)
        have += step
    return rank[:n]


def _dictionary_order(table: pa.Table, length: int) -> pa.Table:
    """Verdicts on runs of windows (phrase, first and last window, least id): where a document before another has them."""
    data, offsets = _buffers(table.column("names"))
    words = np.frombuffer(data.tobytes(), np.uint64)
    counts = words[offsets[:-1] // 8].astype(np.int64)
    heads = words[(_ranges(offsets[:-1] // 8 + 1, 4 * counts))].reshape(-1, 4)
    # Where the bytes of each phrase begin: those of a blob follow its heads.
    each = heads[:, 3].astype(np.int64)
    ends = np.cumsum(each)
    before = np.concatenate([[0], ends])[np.cumsum(counts) - counts]
    begins = np.repeat(offsets[:-1] + 8 + 32 * counts - before, counts) + ends - each
    names, one, entry = np.unique(heads[:, 0], return_index=True, return_inverse=True)
    least, greatest = np.full(len(names), np.iinfo(np.int64).max), np.full(len(names), np.iinfo(np.int64).min)
    np.minimum.at(least, entry, heads[:, 1].view(np.int64))
    np.maximum.at(greatest, entry, heads[:, 2].view(np.int64))
    sizes = each[one]
    text = data[_ranges(begins[one], sizes)]
    windows = sizes - length + 1
    owner = np.repeat(np.arange(len(names)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    place = ranks(text, length)[(np.cumsum(sizes) - sizes)[owner] + inside]
    # The least document of each suffix: suffixes that are equal have one place.
    lowest = np.full(int(place.max()) + 1, np.iinfo(np.int64).max)
    np.minimum.at(lowest, place.astype(np.int64), least[owner])
    found = lowest[place.astype(np.int64)]
    wanted = found < greatest[owner]
    turns = (owner[1:] != owner[:-1]) | (found[1:] != found[:-1])
    opens, closes = wanted.copy(), wanted.copy()
    opens[1:] &= ~wanted[:-1] | turns
    closes[:-1] &= ~wanted[1:] | turns
    a, b = np.flatnonzero(opens), np.flatnonzero(closes)
    bounds = (inside[a].astype(np.uint64) << np.uint64(32)) | inside[b].astype(np.uint64)
    verdicts = np.stack([names[owner[a]], bounds, found[a].view(np.uint64)], axis=1)
    # To each blob those of its phrases.
    first, end = (np.searchsorted(owner[a], np.arange(len(names)), side) for side in ("left", "right"))
    sent = verdicts[_ranges(first[entry], (end - first)[entry])]
    told = np.diff(np.concatenate([[0], np.cumsum((end - first)[entry])])[np.concatenate([[0], np.cumsum(counts)])])
    some = told > 0
    chunks = table.column("chunk").to_numpy()[some]
    return pa.table({"slice": pa.array(np.full(len(chunks), RUN, np.int64)), "chunk": pa.array(chunks), "names": _blobs(sent, told[some])})


def _chunk(table: pa.Table, reply: pa.Table) -> int:
    return (table if table.num_rows else reply).column("chunk")[0].as_py()


def _of_kind(reply: pa.Table, kind: int) -> pa.Table:
    return reply.filter(pc.equal(reply.column("slice"), kind))


def _answer(table: pa.Table, fields: int, verdicts: np.ndarray, kind: int | None = None) -> pa.Table:
    """For each row of the packed `table`, those of the `verdicts` (name first, ascending) whose names it holds.

    A `kind` of verdict takes the place of the slice."""
    records, counts = _records(table, fields)
    row = np.repeat(np.arange(len(counts)), counts)
    hit, at = _member(verdicts[:, 0], records[:, 0])
    row, at = row[hit], at[hit]
    # Names ascend within a row: those that come again are neighbours.
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1])
    row, at = row[keep], at[keep]
    told = np.bincount(row, minlength=len(counts))
    some = told > 0
    mine = verdicts[at]
    slices, chunks = (table.column(c).to_numpy()[some] for c in ("slice", "chunk"))
    slices = slices if kind is None else np.full(len(slices), kind, np.int64)
    return pa.table({"slice": pa.array(slices, pa.int64()), "chunk": pa.array(chunks, pa.int64()), "names": _blobs(mine if fields else mine.astype(np.uint32), told[some])})
