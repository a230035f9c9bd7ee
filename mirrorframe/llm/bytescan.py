"""Vectorised scans over the UTF-8 bytes of many texts at once, for use inside Arrow tasks.

Texts are handled in runs of about RUN_BYTES, so the working arrays stay a few dozen MB however large a batch is.
A run never splits a text; a text longer than that is a run of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

RUN_BYTES = 1 << 20

# ASCII white space; every other byte belongs to a word.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

# A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Run:
    """Rows `first` .. `first + len(offsets) - 1` of a batch: their bytes, joined, and where each begins."""

    first: int
    offsets: np.ndarray
    data: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def runs(texts: pa.Array, limit: int = RUN_BYTES) -> Iterator[Run]:
    """Consecutive runs of rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    if not len(texts):
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield Run(first, offsets[first : last + 1] - offsets[first], data[offsets[first] : offsets[last]])
        first = last


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def constants(n: int, seed: int) -> np.ndarray:
    """`n` odd 64-bit numbers that depend on `seed` only."""
    return mix(np.arange(1, n + 1, dtype=np.uint64), seed) | np.uint64(1)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least `n` of each."""
    return _powers(max(2 * RUN_BYTES, 1 << int(n).bit_length()))


class Rolling:
    """Hashes of any substring of `data` in constant time; `fold` maps bytes first (case folding, say)."""

    def __init__(self, data: np.ndarray, fold: np.ndarray | None = None):
        table = constants(256, 77)
        up, self._down = powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((table if fold is None else table[fold])[data] * up[: len(data)], out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self._sums[ends] - self._sums[starts]) * self._down[starts])


def spans(run: Run, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal stretches of bytes b with inside[b] that stay within one text: (row, start, end)."""
    if not len(run.data):
        none = np.zeros(0, np.int64)
        return none, none, none
    mask = inside[run.data]
    cuts = run.offsets[(run.offsets > 0) & (run.offsets < len(mask))]
    before, after = np.zeros_like(mask), np.zeros_like(mask)
    before[1:], after[:-1] = mask[:-1], mask[1:]
    before[cuts], after[cuts - 1] = False, False
    starts, ends = np.flatnonzero(mask & ~before), np.flatnonzero(mask & ~after) + 1
    return np.searchsorted(run.offsets, starts, "right") - 1, starts, ends


def firsts(rows: np.ndarray, n: int) -> np.ndarray:
    """Where each of `n` rows begins in the ascending row numbers `rows`, and the end."""
    return np.searchsorted(rows, np.arange(n + 1))


def shingles(run: Run, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash), rows ascending, of the `width`-word shingles of each text, A-Z lower-cased.

    A text of fewer words has one, its whole sequence of words; one without words has none. Repeats stay in.
    """
    rows, starts, ends = spans(run, ~SPACE)
    if not len(rows):
        return rows, np.zeros(0, np.uint64)
    words = Rolling(run.data, LOWER)(starts, ends)
    factors = constants(width, 5)
    first = firsts(rows, run.rows)
    counts = np.diff(first)
    total = np.zeros(len(words), np.uint64)
    for k in range(min(width, len(words))):
        total[: len(words) - k] += words[k:] * factors[k]
    full = np.arange(len(words)) + width <= first[rows + 1]
    short = np.flatnonzero((counts > 0) & (counts < width))
    out_rows, out = rows[full], mix(total[full], width)
    if len(short):
        one = [mix((words[a:b] * factors[: b - a]).sum(keepdims=True), int(b - a)) for a, b in zip(first[short], first[short + 1], strict=True)]
        out_rows, out = np.concatenate([out_rows, short]), np.concatenate([out, *one])
        order = np.argsort(out_rows, kind="stable")
        out_rows, out = out_rows[order], out[order]
    return out_rows, out


def distinct(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """`values` sorted and made distinct within each of `n` rows: (begin of each row and the end, values)."""
    first = firsts(rows, n)
    values = values.copy()
    for a, b in zip(first[:-1], first[1:], strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    return np.concatenate([[0], np.cumsum(keep)])[first], values[keep]
