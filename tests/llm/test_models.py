import zlib

import numpy as np
import pyarrow as pa
import pytest

from mirrorframe.llm import bytescan as B
from mirrorframe.llm import gam, hyperdim, toxicity
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, held_out string, score int, _label int"
ODD = [(90_001, None), (90_002, ""), (90_003, " \n"), (90_004, "12 345 !!"), (None, "plain words of a text"), (90_005, "x"), (90_006, "日本語 é"), (90_007, "word " * 400_000)]


@pytest.fixture(scope="module")
def tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    return docs.cache(), labels.cache()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if n % 2 else "en", None, None, None) for n, (i, t) in enumerate(ODD + ODD[:2])]
    return spark.createDataFrame(rows, SCHEMA)


def fold(i, folds):
    return zlib.crc32(str(i).encode()) % folds


def held_out_share(found, truth, folds, which):
    rows = [r for r in found if r.doc_id in truth and r.held_out]
    assert rows and all(r.held_out == (fold(r.doc_id, folds) == which) for r in found)
    return rows


def test_language_accuracy_and_plain_cosines(tables):
    docs, _ = tables
    found = hyperdim.predict_languages(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = held_out_share(found, truth, 5, 0)
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 for r in found)


def plain_vector(text, dimensions):
    marked, out = [0], np.zeros(dimensions)
    for c in text:
        code = ord(c.lower()[0]) if c.isalpha() else 0
        if code or marked[-1]:
            marked.append(code)
    if marked[-1]:
        marked.append(0)
    for i in range(len(marked) - 2):
        a, b, c = (hyperdim._letter_vector(x, dimensions).astype(int) for x in marked[i : i + 3])
        out += np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_encoding_equals_a_plain_one(monkeypatch):
    monkeypatch.setattr(hyperdim, "TEXTS", 2)
    monkeypatch.setattr(hyperdim, "TRIGRAMS", 3)
    texts = ["The cat, the CAT!", "", " a", "12", "É日本 x", None, "b" * 9, "..x"]
    (run,) = B.runs(pa.array(texts))
    rows, vectors = hyperdim.encoded(run, 64)
    assert list(rows) == [0, 2, 4, 6, 7]
    for row, vector in zip(rows, vectors, strict=True):
        assert np.array_equal(vector, plain_vector(texts[row], 64))


def test_language_of_odd_rows(odd, spark):
    found = sorted(((r.doc_id, r.held_out, r.lang_pred) for r in hyperdim.predict_languages(odd).collect()), key=str)
    assert len(found) == len(ODD) + 2
    undecided = {i for i, _, lang in found if lang == "und"}
    assert undecided >= {90_001, 90_002, 90_003, 90_004} and all(held for i, held, _ in found if i is None)
    assert hyperdim.predict_languages(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = odd.withColumn("lang", odd["lang"].substr(1, 0)).where("lang is null")
    assert {(r.lang_pred, r.score) for r in hyperdim.predict_languages(nothing).collect()} == {("und", 0.0)}


def area(scores, labels):
    order = np.argsort(np.argsort(scores, kind="stable"), kind="stable") + 1
    scores, labels = np.asarray(scores), np.asarray(labels)
    ranks = np.array([order[scores == s].mean() for s in scores])
    n1, n0 = labels.sum(), (1 - labels).sum()
    return (ranks[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_quality_on_held_out_rows(tables):
    docs, labels = tables
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = held_out_share(gam.quality_scores(docs, labels).collect(), truth, 3, 1)
    assert area([r.score for r in rows], [truth[r.doc_id] for r in rows]) > 0.95
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in rows)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = held_out_share(toxicity.toxicity_scores(docs, labels).collect(), truth, 5, 0)
    labels = np.array([truth[r.doc_id] for r in rows])
    assert area([r.score for r in rows], labels) > 0.95
    predicted = np.array([r.predicted for r in rows])
    assert predicted[labels == 1].mean() > 0.9 and predicted[labels == 0].mean() < 0.05


@pytest.mark.parametrize("score", [gam.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_rows(odd, tables, spark, score):
    _, labels = tables
    found = score(odd, labels).collect()
    assert len(found) == len(ODD) + 2 and all(0 <= r.score <= 1 for r in found)
    assert len({round(r.score, 12) for r in found if r.doc_id in (90_001, 90_002)}) == 1
    assert score(spark.createDataFrame([], SCHEMA), labels).count() == 0
    assert score(odd, labels.limit(0)).count() == len(ODD) + 2


def test_tables_add_up_and_find_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.fit(x, y)
    assert (0, 1) in model.pairs
    assert np.mean((model.scores(x) >= 0.5) == y) > 0.9


def test_features_of_a_plain_text():
    (run,) = B.runs(pa.array(["Aa aa. b1 $$", ""]))
    x = dict(zip(gam.FEATURES, gam.features(run)[0], strict=True))
    assert x["letters"] == 5 / 12 and x["upper"] == pytest.approx(1 / 5) and x["digits"] == 1 / 12 and x["symbols"] == 2 / 12
    assert x["word_length"] == 9 / 4 and x["top_word"] == 1 / 4 and x["distinct_words"] == 1
    assert not gam.features(run)[1][1:7].any()


def test_the_correction_steps_back_when_the_clean_risk_turns_negative():
    rng = np.random.default_rng(1)
    draw = lambda toxic: np.array(sorted({*rng.integers(100, 400, 30), *([7] if toxic else [])}))
    positive, unlabelled = [draw(True) for _ in range(200)], [draw(rng.random() < 0.1) for _ in range(600)]
    model = toxicity.fit(positive, unlabelled, np.arange(400, dtype=np.uint64), 0.1)
    settings = (400, 0.1, toxicity.ROUNDS, toxicity.RATE, toxicity.DECAY)
    weights, bias, least = brute.nn_pu(positive, unlabelled, *settings)
    assert np.allclose(model.weights, weights, atol=1e-5) and abs(model.bias - bias) < 1e-5
    # 300 noise words in 800 texts are fitted in part even so; without the correction the clean risk falls far below zero and noise weighs ten times as much.
    free, _, lowest = brute.nn_pu(positive, unlabelled, *settings, corrected=False)
    assert least > -0.1 and lowest < 20 * least
    assert model.weights[7] > 2 * np.abs(model.weights[100:]).max() and np.abs(free[100:]).max() > 5 * np.abs(model.weights[100:]).max()
