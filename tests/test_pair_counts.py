from collections import Counter

import pytest

from mirrorframe.metrics import pairs, shapes


@pytest.mark.parametrize("held", [None, 50])
def test_wide_pairs_are_added_up_in_the_tasks(spark, monkeypatch, held):
    """A name that comes back in every batch leaves a task once, and all are counted whatever a task may hold."""
    if held:
        monkeypatch.setattr(pairs, "HELD", held)
        monkeypatch.setattr(pairs, "WAITING", 16)
    rows = [(f"n{i * 7 % 700}" if i % 97 else None, str(i % 5), "x" if i % 3 else None, f"u{i % 90}" if i > 60_000 else "u") for i in range(100_000 if not held else 3_000)]
    data = spark.createDataFrame(rows, "a string, b string, c string, d string")
    of = [("a", "b"), ("b", "c"), ("a", "d"), ("d", "b")]
    found = pairs.pair_tallies(data, of).collect()
    total = Counter()
    for r in found:
        total[r["pair"], r["value_a"], r["value_b"]] += r["n"]
    places = {"a": 0, "b": 1, "c": 2, "d": 3}
    assert total == Counter((k, row[places[x]], row[places[y]]) for k, (x, y) in enumerate(of) for row in rows)
    if not held:
        different = len({(r[0], r[1]) for r in rows})
        tasks = spark.sparkContext.defaultParallelism
        assert sum(r["pair"] == 0 for r in found) <= tasks * different


def test_sides_that_are_the_same_are_counted_once(spark):
    rows = spark.createDataFrame([(str(i % 4), str(i % 3)) for i in range(50)], "a string, b string")
    counts = pairs.pair_counts(rows, rows, [("a", "b")])
    found = {(r["value_a"], r["value_b"]): (r["n_real"], r["n_synthetic"]) for r in counts.collect()}
    assert found == {k: (n, n) for k, n in Counter((str(i % 4), str(i % 3)) for i in range(50)).items()}
    assert "ReusedExchange" in counts._jdf.queryExecution().executedPlan().toString()


def test_packed_bins_are_counted_like_their_texts(spark):
    """Seventeen columns of bins in two whole numbers, a null, values beyond the bounds and a column without any value."""
    numbers = [f"x{i}" for i in range(17)]
    rows = [("t" if i % 3 else None, *[None if (i + k) % 11 == 0 or k == 16 else float((i * (k + 1)) % 23 - 1) for k in range(17)]) for i in range(200)]
    data = spark.createDataFrame(rows, "t string, " + ", ".join(f"{c} double" for c in numbers))
    bounds = {c: (0.0, 20.0) if c != "x16" else (None, None) for c in numbers}
    of = [("t", "x0"), ("t", "x16"), ("x3", "t"), ("x14", "x15")]
    packed = {c: (f"p{k // pairs.PACKED}", k % pairs.PACKED) for k, c in enumerate(numbers)}
    whole = data.select("t", *[c.alias(f"p{i}") for i, c in enumerate(pairs.packed_bins(data, bounds))])
    assert whole.columns == ["t", "p0", "p1"]

    def total(tallies):
        out = Counter()
        for r in tallies.collect():
            out[r["pair"], r["value_a"], r["value_b"]] += r["n"]
        return out

    assert total(pairs.pair_tallies(whole, of, packed)) == total(pairs.pair_tallies(pairs.discretized(data, ["t"], bounds), of))


def test_correlations_and_values_of_equal_sides_are_read_once(spark, tmp_path):
    spark.createDataFrame([(float(i % 7), float(i % 5), i % 2 or None) for i in range(60)], "a double, b double, c int").write.parquet(str(tmp_path / "x"))
    rows = spark.read.parquet(str(tmp_path / "x"))
    scores = pairs.correlation_similarity(rows, rows, ["a", "b", "c"])
    assert {r["score"] for r in scores.collect()} == {1.0, None}
    assert "ReusedExchange" in scores._jdf.queryExecution().executedPlan().toString()
    counts = shapes.paired_counts(rows, rows, ["a", "c"], True)
    assert all(r["n_real"] == r["n_synthetic"] > 0 for r in counts.collect()) and counts.count() == 8
    assert len(counts.inputFiles()) and counts._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
