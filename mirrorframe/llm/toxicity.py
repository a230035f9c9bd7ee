"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier over words and their beginnings is trained from confirmed toxic texts and texts without labels. With the share p of toxic
texts, the risk on clean texts is that on unlabelled texts less p times that on toxic ones taken for clean; where
this estimate turns negative the fit has gone too far, and a step is made back (the non-negative correction).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorframe.llm import bytescan as B
from mirrorframe.llm import folds
from mirrorframe.session import materialize

FOLDS, FOLD = 5, 0
# Texts that a fit may use, chosen by a hash of their ids, and words that the classifier may weigh.
POSITIVES, UNLABELLED, WORDS = 6_000, 18_000, 4_096
# A word is weighed if its share among toxic texts differs from that among all by so many deviations.
DEVIATIONS = 4.0
ROUNDS, RATE, DECAY = 400, 0.05, 2e-4
# Bytes of a word's beginning that count as words of their own: inflected forms share them.
BEGINNINGS = (4, 5)

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _words(run: B.Run) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each stretch of letters and of its beginnings, A-Z lower-cased; rows ascend."""
    rows, starts, ends = B.spans(run, _INSIDE)
    rolling = B.Rolling(run.data, B.LOWER)
    hashed = [rolling(starts, ends)]
    for n in BEGINNINGS:
        hashed.append(B.mix(rolling(starts, np.minimum(starts + n, ends)), n))
    return np.repeat(rows, len(hashed)), np.stack(hashed, axis=1).ravel()


@dataclass
class Model:
    """Log odds are the bias and the weights of the distinct words of a text that are in `words` (ascending hashes)."""

    bias: float
    words: np.ndarray
    weights: np.ndarray

    def scores(self, run: B.Run) -> np.ndarray:
        total = np.full(run.rows, self.bias)
        if len(self.words):
            rows, hashed = _words(run)
            at = np.minimum(np.searchsorted(self.words, hashed), len(self.words) - 1)
            hit = self.words[at] == hashed
            pairs = np.unique(rows[hit] * len(self.words) + at[hit])
            total += np.bincount(pairs // len(self.words), weights=self.weights[pairs % len(self.words)], minlength=run.rows)
        return 1 / (1 + np.exp(-total))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], words: np.ndarray, prior: float) -> Model:
    """From the places in `words` (ascending hashes) of each text's words; without either kind of text, or words, the score is the prior."""
    model = Model(float(np.log(prior / (1 - prior))), np.zeros(0, np.uint64), np.zeros(0))
    n_p, n_u = len(positive), len(unlabelled)
    if not n_p or not n_u or not len(words):
        return model
    (row_p, word_p), (row_u, word_u) = ((np.repeat(np.arange(len(t)), [len(x) for x in t]), np.concatenate(t).astype(np.int64)) for t in (positive, unlabelled))
    w, bias = np.zeros(len(words)), model.bias
    moments = np.zeros((2, len(words) + 1))
    for step in range(1, ROUNDS + 1):
        z_p = bias + np.bincount(row_p, weights=w[word_p], minlength=n_p)
        z_u = bias + np.bincount(row_u, weights=w[word_u], minlength=n_u)
        s_p, s_u = 1 / (1 + np.exp(-z_p)), 1 / (1 + np.exp(-z_u))
        clean = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
        # Slopes of the logistic loss: of toxic texts taken for toxic, and of the estimate for clean ones.
        d_p, d_clean_p, d_clean_u = prior * (s_p - 1) / n_p, -prior * s_p / n_p, s_u / n_u
        if clean < 0:
            d_p, d_clean_p, d_clean_u = np.zeros(n_p), -d_clean_p, -d_clean_u
        by_p = d_p + d_clean_p
        gradient = np.append(
            np.bincount(word_p, weights=by_p[row_p], minlength=len(words)) + np.bincount(word_u, weights=d_clean_u[row_u], minlength=len(words)) + DECAY * w,
            by_p.sum() + d_clean_u.sum(),
        )
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.999 * moments[1] + 0.001 * gradient**2
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.999**step)) + 1e-9)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(float(bias), words, w)


def _strong(sampled: DataFrame, n_p: int, n_u: int) -> DataFrame:
    """(word): at most WORDS words whose shares among toxic and unlabelled texts differ most, DEVIATIONS at least."""
    counts = sampled.select(F.when(F.col("positive"), 1).otherwise(0).alias("toxic"), F.explode("words").alias("word")).groupBy("word").agg(
        F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("u")
    )
    both = (F.col("p") + F.col("u") + 1) / (n_p + n_u + 2)
    off = F.abs(F.col("p") / n_p - F.col("u") / n_u) / F.sqrt(both * (1 - both) * (1 / n_p + 1 / n_u))
    return counts.withColumn("off", off).where(F.col("off") >= DEVIATIONS).orderBy(F.col("off").desc(), "word").limit(WORDS).select("word")


def toxicity_scores(
    docs: DataFrame, labels: DataFrame, prior: float | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    carry: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row of `docs`: how likely the text is toxic, by its words alone.

    Trained from at most POSITIVES rows labelled 1 and UNLABELLED rows of `docs` whose labels are not looked at, none of
    them held out (crc32 of the id modulo 5 is not 0; a null id is held out). `prior` is the share of toxic texts; by
    default that among the labels that may be learned from. A null text is scored as an empty one. Rows that repeat an
    id are scored one by one. Without labels the score is 0.5 or the prior. Columns of `docs` named in `carry` follow (one called
    doc_id takes the place of the id's); others are ignored.
    """
    known = labels.where(F.col(label_col).isNotNull() & ~folds.held_out(id_col, FOLDS, FOLD)).select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).alias("_label"))
    if prior is None:
        n, toxic = known.agg(F.count("*"), F.sum(F.when(F.col("_label") == 1, 1).otherwise(0))).first()
        prior = ((toxic or 0) + 1) / (n + 2)
    texts = docs.select(F.col(id_col).cast("long").alias("_id"), folds.held_out(id_col, FOLDS, FOLD).alias("held_out"), F.col(text_col).alias("_text"))
    positive = folds.sample(known.where("_label = 1").select("_id"), "_id", POSITIVES).withColumn("_positive", F.lit(True))
    unlabelled = folds.sample(texts.where("not held_out").select("_id"), "_id", UNLABELLED).withColumn("_positive", F.lit(False))

    def measure(batches):
        for batch in batches:
            for run in B.runs(batch.column(2)):
                part = slice(run.first, run.first + run.rows)
                first, values = B.distinct(*_words(run), run.rows)
                lists = pa.ListArray.from_arrays(first.astype(np.int32), values.view(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0)[part], batch.column(1)[part], lists], ["id", "positive", "words"])

    # The ids are at most POSITIVES + UNLABELLED, so the side that is sent to all tasks is small whatever the tables hold.
    chosen = F.broadcast(positive.unionByName(unlabelled))
    measured = texts.join(chosen, "_id").select("_id", "_positive", "_text").mapInArrow(measure, "id long, positive boolean, words array<long>")
    sampled = materialize(measured.dropDuplicates(["id", "positive"]))
    n_p, n_u = sampled.agg(F.count(F.when(F.col("positive"), 1)), F.count(F.when(~F.col("positive"), 1))).first()
    words = np.sort(np.array([r["word"] for r in _strong(sampled, max(n_p, 1), max(n_u, 1)).collect()], np.int64).view(np.uint64))

    def places(batches):
        for batch in batches:
            lists = [np.flatnonzero(np.isin(words, x.values.to_numpy().view(np.uint64), assume_unique=True)).astype(np.int32) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["id", "positive", "places"])

    found = sorted((r["id"], r["positive"], r["places"]) for r in sampled.mapInArrow(places, "id long, positive boolean, places array<int>").collect())
    sets = {kind: [np.array(x, np.int64) for _, p, x in found if p is kind] for kind in (True, False)}
    model = fit(sets[True], sets[False], words, prior)
    text, kept = [text_col] * (text_col in carry), [c for c in carry if c not in ("doc_id", text_col)]
    source = docs.select(F.col(id_col).cast("long").alias("_id"), folds.held_out(id_col, FOLDS, FOLD).alias("held_out"), F.col(text_col).alias("_text"), *kept)

    def scan(batches):
        for batch in batches:
            for run in B.runs(batch.column(2)):
                part = slice(run.first, run.first + run.rows)
                score = model.scores(run)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[part], batch.column(1)[part], pa.array(score), pa.array((score >= 0.5).astype(np.int32)), *[c[part] for c in batch.columns[3 - len(text) :]]],
                    ["doc_id", "held_out", "score", "predicted", *text, *kept],
                )

    schema = T.StructType.fromDDL("doc_id long, held_out boolean, score double, predicted int")
    for name in [*text, *kept]:
        schema = schema.add(docs.schema[name])
    return source.mapInArrow(scan, schema)
