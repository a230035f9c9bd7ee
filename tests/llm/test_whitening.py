import math

import numpy as np
import pytest

from mirrorframe.llm import eigen, whitening

SCHEMA = "vec_id long, embedding array<double>, at int, total long, v string, id int, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x", 3, 4) for i, v in rows], SCHEMA)


def plain(vectors, k=32):
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    gaps = n * x - sums
    centred = (gaps / n).astype(float)
    covariance = centred.T @ centred / n
    values, units = np.linalg.eigh(covariance)
    values, units = values[::-1][:k], units[:, ::-1][:, :k]
    return [int(d) for d in (gaps * gaps).sum(axis=1)], values, values / np.trace(covariance), centred @ units / np.sqrt(values)


@pytest.mark.parametrize("side", [1, 2, 3, 7, 40])
@pytest.mark.parametrize("kind", ["plain", "pairs", "equal", "close", "split"])
def test_eigenvectors(side, kind):
    rng = np.random.default_rng(side)
    turn = np.linalg.qr(rng.normal(size=(side, side)))[0]
    values = {
        "plain": rng.random(side) * 100, "pairs": np.repeat(rng.random(side), 2)[:side], "equal": np.ones(side), "close": 1 + 1e-10 * np.arange(side),
        "split": np.arange(1.0, side + 1),
    }[kind]
    matrix = np.diag(values) if kind == "split" else (turn * values) @ turn.T
    matrix = (matrix + matrix.T) / 2
    found, units = eigen.leading(matrix, 32)
    assert np.allclose(found, np.linalg.eigvalsh(matrix)[::-1][:32], atol=1e-13 * values.max(), rtol=0)
    assert np.abs(units.T @ units - np.eye(len(found))).max() < 1e-13
    assert np.abs(matrix @ units - units * found).max() < 1e-13 * values.max()


def test_sturm_counts():
    rng = np.random.default_rng(5)
    d, e = rng.normal(size=9), rng.normal(size=8)
    e[3] = 0
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = np.array([-9, -1, 0, 0.5, 1, 9.0])
    assert list(eigen.counts_below(d, e, at)) == [int((values < x).sum()) for x in at]


def test_equals_a_plain_decomposition(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect() if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    deviations, values, explained, whitened = plain([v for _, v in rows])
    found = {(r.vec_id, r.component): r for r in whitening.whitened(table).collect()}
    assert len(found) == 32 * len(rows)
    signs = np.sign([found[rows[0][0], c + 1].whitened * whitened[0, c] for c in range(32)])
    for at, (i, _) in enumerate(rows):
        own = [found[i, c + 1] for c in range(32)]
        assert {r.n for r in own} == {len(rows)} and {r.deviation for r in own} == {deviations[at]}
        assert np.allclose([r.whitened for r in own], signs * whitened[at], atol=1e-8)
        assert np.allclose([r.explained for r in own], explained, rtol=1e-12)
    assert {r.identity_error for r in found.values()}.pop() < 1e-9


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [1.0, 0.0, 5.5]), (2, [0.0, 1.0, -3.25]), (2, [0.0, 1.0, -3.25]), (None, [2.0, 7.0, 1.0]), (5, [0.5, -0.5, 0.01]), (6, [-0.01, 3.0, 9.0])]
    bad = [(7, None), (8, [1.0, None, 2.0]), (9, [nan, 1.0, 2.0]), (10, [1.0, inf, 2.0]), (11, [-inf, 1.0, 2.0]), (12, []), (13, [1.0, 2.0]), (14, [1e300, 0.0, 0.0])]
    found = whitening.whitened(frame(spark, good + bad).repartition(5)).collect()
    deviations, values, explained, whitened = plain([v for _, v in good])
    assert sorted((r.vec_id or 0, r.component, r.deviation) for r in found) == sorted((i or 0, c, d) for (i, _), d in zip(good, deviations, strict=True) for c in (1, 2, 3))
    for c in range(3):
        assert np.allclose(sorted(abs(r.whitened) for r in found if r.component == c + 1), sorted(abs(whitened[:, c])))
    assert all(r.identity_error < 1e-12 and r.n == 6 for r in found)


def test_directions_without_variance_and_empty_tables(spark):
    line = [(i, [float(i), 2.0 * i, 7.0]) for i in range(20)]
    found = whitening.whitened(frame(spark, line)).collect()
    assert {r.component for r in found} == {1} and len(found) == 20 and found[0].explained == pytest.approx(1)
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(4)], [(1, None), (2, [])]):
        assert whitening.whitened(frame(spark, rows)).count() == 0


def test_deviations_beyond_a_long_are_null(spark):
    gaps = np.array([[1 << 40, 3], [2, 3]])
    assert whitening._deviations(gaps).to_pylist() == [None, 13]
    assert whitening._deviations(np.array([[1 << 31, 1 << 30], [0, 1]])).to_pylist() == [(1 << 62) + (1 << 60), 1]


def test_few_cells_at_a_time(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(50)]
    whole = {(r.vec_id, r.component): r.whitened for r in whitening.whitened(frame(spark, rows)).collect()}
    monkeypatch.setattr(whitening, "CELLS", 8)
    parts = whitening.whitened(frame(spark, rows).repartition(3), components=2).collect()
    assert len(parts) == 100 and all(abs(r.whitened) == pytest.approx(abs(whole[r.vec_id, r.component])) for r in parts)
