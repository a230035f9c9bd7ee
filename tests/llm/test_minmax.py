import random

import pytest

from mirrorframe.llm import minmax
from tests.llm import brute

SCHEMA = "doc_id long, text string, members string, id int"


def result(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in frame.collect()}


def test_agrees_with_brute_force_on_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = minmax.near_duplicates(docs, width=4)
    rows = found.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute.near_duplicates([(r.doc_id, r.text) for r in docs.collect()], 4)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_chains_stars_and_pairs_below_the_limit(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # near copies of one text, with one or two words changed
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        rows.append((1000 - i, " ".join(words)))
    for i in range(30):  # a chain of neighbours
        rows.append((2000 + i, " ".join(f"c{i * 2 + k}" for k in range(50))))
    for i in range(40):
        rows.append((3000 + i, " ".join(f"r{rng.randrange(30)}" for _ in range(40))))
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], SCHEMA)
    assert result(minmax.near_duplicates(frame, width=4)) == brute.near_duplicates(rows, 4)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\ttwo "), (6, "one"), (None, "one two"), (None, None), (7, "é " * 9), (8, "x" * 3_000_000), (9, "X" * 3_000_000)]
    frame = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    found = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minmax.near_duplicates(frame).collect()]
    assert sorted(found, key=str) == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (None, 1, None, True),
         (None, 0, None, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 8, False)], key=str)


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c d e f g", "", 0), (1, "a b c d e f g", "", 0), (2, "a b c d e f g", "", 0)]
    found = minmax.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(1, 1, True), (1, 1, True), (2, 1, False)]
    assert minmax.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("width", [1, 5])
def test_widths(spark, width):
    rows = [(1, "a b c a b c a b c"), (2, "a b c a b c a b d"), (3, "c b a")]
    frame = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)
    assert result(minmax.near_duplicates(frame, width=width)) == brute.near_duplicates(rows, width)
