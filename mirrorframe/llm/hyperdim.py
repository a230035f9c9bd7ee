"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A trigram is the product of its letters' vectors, rotated by their place;
a text is the sum of its trigrams and a language the sum of its texts. The language whose vector has the greatest cosine
with that of a text is its prediction.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.llm import bytescan as B
from mirrorframe.llm import folds

DIMENSIONS = 1024
FOLDS, FOLD = 5, 0
UNDECIDED = "und"
# Sizes of the blocks in which texts are multiplied with trigram vectors.
TEXTS, TRIGRAMS = 512, 4096


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point: the letter it is lower-cased to, 0 if it is none."""
    table = np.zeros(0x110000, np.uint64)
    for code in range(0x110000):
        c = chr(code)
        if c.isalpha():
            table[code] = ord(c.lower()[0])
    return table


@lru_cache(maxsize=1 << 12)
def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([7, code]).integers(0, 2, dimensions, dtype=np.int8) * np.int8(2) - np.int8(1)


@lru_cache(maxsize=1 << 14)
def _trigram_vector(key: int, dimensions: int) -> np.ndarray:
    a, b, c = key >> 42, key >> 21 & 0x1FFFFF, key & 0x1FFFFF
    return np.roll(_letter_vector(a, dimensions), 2) * np.roll(_letter_vector(b, dimensions), 1) * _letter_vector(c, dimensions)


def trigrams(run: B.Run) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all trigrams, rows ascending; each stretch of other characters, and each end of a text, is one mark."""
    data = run.data
    begins = (data & 0xC0) != 0x80
    n_chars = np.concatenate([[0], np.cumsum(begins)])[run.offsets]
    codes = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(run.rows), np.diff(n_chars))
    letters = np.zeros(len(codes) + run.rows + 1, np.uint64)
    letters[np.arange(len(codes)) + row + 1] = _letters()[codes]
    owner = np.full(len(letters), -1)
    owner[np.arange(len(codes)) + row + 1] = row
    edge = owner < 0
    keep = letters > 0
    keep[0] = True
    keep[1:] |= letters[:-1] > 0
    # The one mark kept of a stretch is an edge if any of the stretch is.
    stretch = np.cumsum(keep) - 1
    edges = np.bincount(stretch, weights=edge)[: stretch[-1] + 1] > 0
    letters, owner = letters[keep], owner[keep]
    edges &= letters == 0
    keys = letters[:-2] << np.uint64(42) | letters[1:-1] << np.uint64(21) | letters[2:]
    good = ~edges[1:-1]
    return owner[1:-1][good], keys[good]


def _counts(run: B.Run):
    """For each text that has letters: its row, distinct trigrams and how often each occurs."""
    rows, keys = trigrams(run)
    first = B.firsts(rows, run.rows)
    for row in np.flatnonzero(np.diff(first)):
        yield (row, *np.unique(keys[first[row] : first[row + 1]], return_counts=True))


def encoded(run: B.Run, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): the sum of its trigram vectors for each text that has a letter."""
    counted = list(_counts(run))
    out = np.zeros((len(counted), dimensions), np.float32)
    for a in range(0, len(counted), TEXTS):
        some = counted[a : a + TEXTS]
        keys, codes = np.unique(np.concatenate([k for _, k, _ in some]), return_inverse=True)
        text = np.repeat(np.arange(len(some)), [len(k) for _, k, _ in some])
        counts = np.concatenate([c for *_, c in some])
        for b in range(0, len(keys), TRIGRAMS):
            vectors = np.stack([_trigram_vector(int(k), dimensions) for k in keys[b : b + TRIGRAMS]]).astype(np.float32)
            block = np.zeros((len(some), len(vectors)), np.float32)
            inside = (codes >= b) & (codes < b + TRIGRAMS)
            block[text[inside], codes[inside] - b] = counts[inside]
            out[a : a + len(some)] += block @ vectors
    return np.array([r for r, *_ in counted], np.int64), out


def learn(docs: DataFrame, dimensions: int, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and their vectors: sums over all `docs` with a language, bounded by languages times dimensions.

    A task adds up the trigrams of a language before it multiplies them, and sends one vector a language.
    """

    def scan(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for run in B.runs(batch.column(0)):
                langs = np.array(batch.column(1).slice(run.first, run.rows).to_pylist(), object)
                rows, keys = trigrams(run)
                for lang in dict.fromkeys(langs):
                    found, counts = np.unique(keys[langs[rows] == lang], return_counts=True)
                    own = sums.setdefault(lang, np.zeros(dimensions, np.int64))
                    for b in range(0, len(found), TRIGRAMS):
                        vectors = np.stack([_trigram_vector(int(k), dimensions) for k in found[b : b + TRIGRAMS]])
                        own += counts[b : b + TRIGRAMS] @ vectors.astype(np.int64)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions)), pa.array(vector)], ["lang", "at", "n"])

    partial = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(text_col, F.col(lang_col).cast("string"))
    summed = partial.mapInArrow(scan, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n"))
    vectors: dict[str, np.ndarray] = {}
    for r in summed.collect():
        vectors.setdefault(r["lang"], np.zeros(dimensions))[r["at"]] = r["n"]
    names = sorted(x for x in vectors if np.any(vectors[x]))
    return names, np.array([vectors[x] / np.linalg.norm(vectors[x]) for x in names], np.float32).reshape(-1, dimensions)


def predict_languages(
    docs: DataFrame, dimensions: int = DIMENSIONS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per row of `docs`.

    Learned from the rows with a text and a language whose id is not held out (crc32 of the id modulo 5 is not 0; a null
    id is held out). `score` is the cosine, at least 0. A text that is null or has no letter, or any text if there was
    nothing to learn from, is `und` with score 0; ties go to the first language by name. Rows that repeat an id are
    scored one by one; other columns are ignored.
    """
    names, vectors = learn(docs.where(~folds.held_out(id_col, FOLDS, FOLD)), dimensions, text_col, lang_col)

    def scan(batches):
        for batch in batches:
            for run in B.runs(batch.column(2)):
                best, score = np.full(run.rows, UNDECIDED, object), np.zeros(run.rows)
                rows, texts = encoded(run, dimensions)
                if len(rows) and names:
                    cosines = texts @ vectors.T / np.maximum(np.linalg.norm(texts, axis=1), 1e-9)[:, None]
                    which = np.argmax(cosines, axis=1)
                    best[rows] = np.array(names, object)[which]
                    score[rows] = np.clip(cosines[np.arange(len(rows)), which], 0, 1)
                part = slice(run.first, run.first + run.rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], batch.column(1)[part], pa.array(best, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"]
                )

    rows = docs.select(F.col(id_col).cast("long"), folds.held_out(id_col, FOLDS, FOLD), text_col)
    return rows.mapInArrow(scan, "doc_id long, held_out boolean, lang_pred string, score double")
