"""Text quality by a generalised additive model with pairwise interactions.

Shallow trees on one feature at a time are boosted in turn; added up they make one lookup table a feature. Then the pairs of
features whose residuals interact most get tables of their own, boosted the same way. A score is a sum of table
entries, found by binning.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.llm import bytescan as B
from mirrorframe.llm import folds

FOLDS, FOLD = 3, 1
# Labelled rows that a fit may use; they are chosen by a hash of their ids.
SAMPLE = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.15
SHRINK = 1.0

_ASCII = np.arange(256)
_UPPER = (_ASCII >= 65) & (_ASCII <= 90)
_LETTER = _UPPER | ((_ASCII >= 97) & (_ASCII <= 122)) | (_ASCII >= 128)
_DIGIT = (_ASCII >= 48) & (_ASCII <= 57)
_STOP = np.isin(_ASCII, [ord(c) for c in ".,;:!?"])
_SYMBOL = ~(B.SPACE | _LETTER | _DIGIT | _STOP)
FEATURES = [
    "log_bytes", "letters", "upper", "digits", "stops", "symbols", "beyond_ascii", "line_length", "word_length", "short_words",
    "distinct_words", "top_word", "repeated_next", "distinct_shingles", "odd_words", "closed_words",
]


def features(run: B.Run) -> np.ndarray:
    """One row of FEATURES per text; an empty text has zeros."""
    n = run.rows
    size = np.diff(run.offsets)
    some = np.maximum(size, 1)

    def share(table: np.ndarray, of: np.ndarray = some) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(table[run.data])])[run.offsets]) / of

    letters = share(_LETTER)
    lines = share(_ASCII == 10, np.ones(n)) + 1
    rows, starts, ends = B.spans(run, ~B.SPACE)
    words = np.bincount(rows, minlength=n)
    per = np.maximum(words, 1)
    length = ends - starts
    hashed = B.Rolling(run.data, B.LOWER)(starts, ends)
    same = np.zeros(len(rows))
    same[1:] = (hashed[1:] == hashed[:-1]) & (rows[1:] == rows[:-1])
    first, values = B.distinct(rows, hashed, n)
    distinct, top = np.diff(first), np.zeros(n)
    codes = np.searchsorted(first, np.arange(len(values)), "right") - 1
    if len(values):  # how often each distinct word of a text occurs
        order = np.lexsort((hashed, rows))
        fresh = np.flatnonzero(np.concatenate([[True], (hashed[order][1:] != hashed[order][:-1]) | (rows[order][1:] != rows[order][:-1])]))
        np.maximum.at(top, codes, np.diff(np.append(fresh, len(rows))))
    shingle_rows, shingle_values = B.shingles(run, 3)
    shingle_first, _ = B.distinct(shingle_rows, shingle_values, n)
    shingles = np.maximum(np.bincount(shingle_rows, minlength=n), 1)
    odd = _SYMBOL[run.data[ends - 1]] | ~_LETTER[run.data[starts]] if len(rows) else np.zeros(0)
    closed = _STOP[run.data[ends - 1]] if len(rows) else np.zeros(0)
    count = lambda w: np.bincount(rows, weights=w, minlength=n) / per
    return np.stack([
        np.log1p(size), letters, share(_UPPER) / np.maximum(letters, 1e-9), share(_DIGIT), share(_STOP), share(_SYMBOL), share(_ASCII >= 128),
        np.log1p(size / lines), count(length), count(length <= 2), distinct / per, top / per, count(same), np.diff(shingle_first) / shingles,
        count(odd), count(closed),
    ], axis=1)


@dataclass
class Model:
    """`edges` cut each feature into bins; the score's log odds are the bias and one entry of each table."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for k, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += values[np.searchsorted(edges, x[:, k], "right")]
        for (i, j), values in zip(self.pairs, self.pair_tables, strict=True):
            total += values[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    return [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]


def _gain(g, h):
    return g * g / (h + SHRINK)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of a tree of two cuts that lowers the loss most, given gradients and curvatures by bin."""
    parts = [(0, len(g))]
    for _ in range(2):
        best = (1e-9, None)
        for a, b in parts:
            cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            if len(cg):
                gains = _gain(cg, ch) + _gain(g[a:b].sum() - cg, h[a:b].sum() - ch) - _gain(g[a:b].sum(), h[a:b].sum())
                k = int(np.argmax(gains))
                if gains[k] > best[0]:
                    best = (gains[k], (a, a + k + 1, b))
        if best[1] is None:
            break
        a, cut, b = best[1]
        parts.remove((a, b))
        parts += [(a, cut), (cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + SHRINK)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best pair of cuts, one along each side of a table."""
    cg = np.pad(g, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    ch = np.pad(h, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    inner = lambda c: (c[1:-1, 1:-1], c[1:-1, -1:] - c[1:-1, 1:-1], c[-1:, 1:-1] - c[1:-1, 1:-1], c[-1, -1] - c[1:-1, -1:] - c[-1:, 1:-1] + c[1:-1, 1:-1])
    gains = sum(_gain(x, y) for x, y in zip(inner(cg), inner(ch), strict=True)) - _gain(g.sum(), h.sum())
    a, b = np.unravel_index(np.argmax(gains), gains.shape)
    out = np.zeros_like(g)
    for rows in (slice(0, a + 1), slice(a + 1, None)):
        for columns in (slice(0, b + 1), slice(b + 1, None)):
            out[rows, columns] = -g[rows, columns].sum() / (h[rows, columns].sum() + SHRINK)
    return float(gains.max()), out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosted by turns; without both labels the model is the labels' smoothed share."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Model(bias=float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return model
    model.edges, model.pair_edges = _edges(x, BINS), _edges(x, PAIR_BINS)
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(model.pair_edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.bias)

    def slopes():
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(*(np.bincount(bins[k], weights=w, minlength=len(table)) for w in (g, h)))
            table += step
            total += step[bins[k]]
    shapes = [len(e) + 1 for e in model.pair_edges]

    def summed(i: int, j: int):
        cell = coarse[i] * shapes[j] + coarse[j]
        return [np.bincount(cell, weights=w, minlength=shapes[i] * shapes[j]).reshape(shapes[i], shapes[j]) for w in slopes()]

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: (-_quadrants(*summed(*p))[0], p))
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((shapes[i], shapes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            step = RATE * _quadrants(*summed(i, j))[1]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def quality_scores(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`: how likely label 1 is, by the text alone.

    Fitted on at most `sample` labelled rows whose id is not held out (crc32 of the id modulo 3 is not 1; a null id is
    held out); rows whose label is null do not count, of rows that repeat an id one does. A null text is scored as an
    empty one. Without labels the score is 0.5. Other columns are ignored.
    """
    known = labels.where(F.col(label_col).isNotNull() & ~folds.held_out(id_col, FOLDS, FOLD))
    chosen = folds.sample(known.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("_label")), "_id", sample)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), folds.held_out(id_col, FOLDS, FOLD).alias("held_out"), F.col(text_col).alias("_text"))

    def measure(batches):
        for batch in batches:
            for run in B.runs(batch.column(2)):
                part = slice(run.first, run.first + run.rows)
                lists = pa.FixedSizeListArray.from_arrays(pa.array(features(run).ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], lists], ["id", "label", "x"])

    # At most `sample` ids, so the side that is sent to all tasks is small whatever the tables hold.
    fitted = texts.join(F.broadcast(chosen), "_id").select("_id", "_label", "_text").mapInArrow(measure, "id long, label double, x array<double>")
    rows = sorted((r["id"], r["label"], r["x"]) for r in fitted.dropDuplicates(["id"]).collect())
    model = fit(np.array([r[2] for r in rows]).reshape(-1, len(FEATURES)), np.array([r[1] for r in rows]))

    def scan(batches):
        for batch in batches:
            for run in B.runs(batch.column(2)):
                part = slice(run.first, run.first + run.rows)
                score = model.scores(features(run))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], batch.column(1)[part], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    return texts.mapInArrow(scan, "doc_id long, held_out boolean, score double, predicted int")
