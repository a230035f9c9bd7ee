import numpy as np
import pytest
from pyspark.sql import functions as F

from mirrorframe.functions import mixtures as M
from mirrorframe.metrics import likelihood


def plain_density(x, mixture):
    """Log-densities of each point by the textbook formula."""
    parts = []
    for w, m, c in zip(mixture.weights, mixture.means, mixture.covariances, strict=True):
        gap = x - m
        quadratic = np.einsum("ni,ij,nj->n", gap, np.linalg.inv(c), gap)
        parts.append(np.log(w) - 0.5 * (len(m) * np.log(2 * np.pi) + np.linalg.slogdet(c)[1] + quadratic))
    return np.array(parts).T


def plain_round(x, mixture):
    """One round of EM, component by component."""
    logs = plain_density(x, mixture)
    shares = np.exp(logs - np.logaddexp.reduce(logs, axis=1, keepdims=True))
    size = shares.sum(axis=0)
    means = (shares.T @ x) / size[:, None]
    covariances = [((x - m).T * s) @ (x - m) / s.sum() + M.RIDGE * np.eye(x.shape[1]) for m, s in zip(means, shares.T, strict=True)]
    return M.Mixture(size / size.sum(), means, np.array(covariances))


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(4)
    middles = np.array([[-1.0, -1.0], [1.0, 0.0], [0.0, 1.5]])
    x = middles[rng.integers(0, 3, 3000)] + 0.2 * rng.normal(size=(3000, 2))
    x[:1000] = x[0]  # a third of the rows is one point
    frame = spark.createDataFrame([(float(a), float(b), None if i % 7 == 0 else float(a * b)) for i, (a, b) in enumerate(x)], "a double, b double, c double")
    return x, frame


def test_rounds_equal_a_plain_version_for_all_mixtures_at_once(clouds):
    x, frame = clouds
    table = M.points(frame, [[F.col("a"), F.col("b")], [F.col("c")]])
    assert table.where("space = 0").agg(F.sum("n")).first()[0] == 3000 and table.where("space = 0").agg(F.max("n")).first()[0] == 1000
    wanted = [M.Wanted(0, 3, 1), M.Wanted(1, 2, 1), M.Wanted(0, 4, 2)]
    spaces = {0: x, 1: np.array([[r.c] for r in frame.where("c is not null").collect()])}
    starts = M._starts(table, wanted)
    for rounds in (1, 2):
        plain = list(starts)
        for _ in range(rounds):
            plain = [plain_round(spaces[w.space], m) for w, m in zip(wanted, plain, strict=True)]
        for own, other in zip(M.fit(table, wanted, rounds), plain, strict=True):
            for field in ("weights", "means", "covariances"):
                assert np.allclose(getattr(own, field), getattr(other, field), rtol=1e-7, atol=1e-8)
    scored = {r.mixture: (r.rows, r.total) for r in M.log_likelihoods(table, wanted, plain).collect()}
    for i, (w, m) in enumerate(zip(wanted, plain, strict=True)):
        logs = np.logaddexp.reduce(plain_density(spaces[w.space], m), axis=1)
        assert scored[i][0] == len(logs) and scored[i][1] == pytest.approx(logs.sum(), rel=1e-9)


def test_few_points_are_components_of_their_own(spark):
    frame = spark.createDataFrame([(0.0,), (0.0,), (1.0,), (None,)], "a double")
    (found,) = M.fit(M.points(frame, [[F.col("a")]]), [M.Wanted(0, 5)], 20)
    assert sorted(found.means[:, 0].round(3)) == [0.0, 1.0] and sorted(found.weights.round(3)) == [0.333, 0.667]
    with pytest.raises(ValueError, match="no points"):
        M.fit(M.points(frame.limit(0), [[F.col("a")]]), [M.Wanted(0, 5)])


def test_scores_of_no_rows_and_of_rows_with_missing_numbers(spark, clouds):
    _, frame = clouds
    scores = likelihood.gm_scores(frame, frame.limit(0), ["a", "c"], (2,), 2, 3).collect()
    assert [(r.num_rows, r.score) for r in scores] == [(0, None)] * 2
    assert all(r.num_rows == 3000 for r in likelihood.gm_scores(frame, frame, ["a", "c"], (2, 3), 1, 3).collect())
    with pytest.raises(ValueError, match="varies"):
        likelihood.gm_scores(frame.select(F.lit(1.0).alias("a")), frame, ["a"])
