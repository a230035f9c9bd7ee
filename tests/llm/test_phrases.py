import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from mirrorframe.llm import phrases
from tests.llm import brute

SCHEMA = "doc_id long, text string, chunk string, names int"


def result(frame):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in frame.collect()}


def test_agrees_with_brute_force_on_the_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = result(phrases.removals(docs))
    assert found == brute.repeats([(r.doc_id, r.text) for r in docs.collect()])
    assert any(x[1] for x in found.values())


@pytest.mark.parametrize(("crowd", "most"), [(phrases.CROWD, phrases.MOST_PHRASES), (1, phrases.MOST_PHRASES), (phrases.CROWD, 2)])
def test_passages_edges_and_overlaps(spark, monkeypatch, crowd, most):
    monkeypatch.setattr(phrases, "CROWD", crowd)
    monkeypatch.setattr(phrases, "MOST_PHRASES", most)
    monkeypatch.setattr(phrases, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(phrases, "SLICE_BYTES", 3000)
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcdéß ") for _ in range(n))
    passages = [word(n) for n in (49, 50, 51, 60, 120, 300)]
    rows = []
    for i in range(120):
        text = "".join(rng.choice([word(rng.randrange(80)), *passages]) for _ in range(rng.randrange(6)))
        rows.append((rng.choice([-1, 1]) * (i + 1), text))
    rows += [(500, "a" * 200), (501, "a" * 60), (502, "b" + "a" * 49), (503, "ab" * 80), (504, "ba" * 40), (505, "x" * 49), (506, "x" * 49)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(i, t, "", 0) for i, t in rows], SCHEMA)
    assert result(phrases.removals(frame)) == brute.repeats(rows)


@pytest.mark.parametrize("length", [28, 32, 50, 64])
def test_ranks_are_the_order_of_the_suffixes(length):
    rng = random.Random(length)
    data = bytes(rng.choice(b"ab\0\xff") for _ in range(300)) + b"ab" * 60 + b"\0" * 90
    rank = phrases.ranks(np.frombuffer(data, np.uint8), length)
    strings = [(data + b"\0" * length)[i : i + length] for i in range(len(data))]
    order = {x: k for k, x in enumerate(sorted(set(strings)))}
    found = [rank[i] for i in range(len(data))]
    by_rank = sorted(range(len(data)), key=lambda i: order[strings[i]])
    assert all((found[a] < found[b]) == (strings[a] < strings[b]) and (found[a] == found[b]) == (strings[a] == strings[b]) for a, b in zip(by_rank, by_rank[1:]))


def test_odd_rows(spark):
    line = "The same long line that is met again and again in all of these texts."
    rows = [(None, line), (None, None), (1, line), (1, line), (2, line + "!"), (3, None), (4, ""), (5, line * 300)]
    frame = spark.createDataFrame([(i, t, None, None) for i, t in rows], SCHEMA)
    found = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in phrases.removals(frame).collect()), key=str)
    n = len(line)
    five = brute.repeats([(1, line), (2, line + "!"), (5, line * 300)])[5][:3]
    assert found == sorted([(None, n, 0, 0), (None, 0, 0, 0), (1, n, 0, 0), (1, n, 0, 0), (2, n + 1, n, 1), (3, 0, 0, 0), (4, 0, 0, 0), (5, *five)], key=str)
    assert phrases.removals(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh") for _ in range(3_000_000))
    frame = spark.createDataFrame([(1, long[1000:2000], "", 0), (2, long, "", 0)], SCHEMA)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in phrases.removals(frame).collect()}
    assert found == {1: (1000, 0, 0), 2: (3_000_000, 1000, 1)}


def test_a_parse_takes_little_memory():
    """The working arrays of 2 MB of text: 84 MB when parsed a megabyte at once."""
    rng = np.random.default_rng(1)
    texts = ["".join(map(chr, rng.integers(97, 123, 20_000))) for _ in range(100)]
    table = pa.table({"id": pa.array(range(100), pa.int64()), "text": pa.array(texts, pa.string())})
    list(phrases._parses(table.slice(0, 1), phrases.LENGTH))
    tracemalloc.start()
    for _ in phrases._parses(table, phrases.LENGTH):
        pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40e6


def test_rows_of_a_slice_are_answered_together(monkeypatch):
    """Chunks times slices grow with the square of the corpus: each such row was unpacked and looked up by itself."""
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.integers(0, 50, rng.integers(0, 6)).astype(np.uint64)) for _ in range(300)]
    blobs = [np.stack([r, r + np.uint64(1)], axis=1).tobytes() for r in rows]
    table = pa.table({"slice": pa.array([7] * 300, pa.int64()), "chunk": pa.array(range(300), pa.int64()), "names": pa.array(blobs, pa.binary())})
    verdicts = np.stack([np.arange(0, 50, 3), np.arange(100, 117)], axis=1).astype(np.uint64)
    asked, plain = [], phrases._member
    monkeypatch.setattr(phrases, "_member", lambda *x: asked.append(1) or plain(*x))
    for part in (table, table.slice(100, 50)):
        found = phrases._answer(part, 2, verdicts, phrases.WHOLE).to_pylist()
        expected = {c: [(x, 100 + x // 3) for x in sorted(set(rows[c].tolist())) if x % 3 == 0] for c in part.column("chunk").to_pylist()}
        assert [r["chunk"] for r in found] == [c for c, x in expected.items() if x] and {r["slice"] for r in found} == {phrases.WHOLE}
        assert all([tuple(x) for x in np.frombuffer(r["names"], np.uint64).reshape(-1, 2).tolist()] == expected[r["chunk"]] for r in found)
    assert len(asked) == 2


def test_dictionaries_tell_each_chunk_of_its_phrases():
    line = b"0123456789" * 6
    sent = {1: {(5, 50): [3, 3, b"x" + line], (5, 51): [4, 9, b"yy" + line + b"z"]}, 2: {(5, 50): [2, 8, b"x" + line]}, 3: {(6, 60): [1, 1, b"q" * 51]}}
    table = pa.concat_tables([phrases._contents(chunk, x, 1) for chunk, x in sent.items()])
    told = {r["chunk"]: np.frombuffer(r["names"], np.uint64).reshape(-1, 3).tolist() for r in phrases._dictionary_order(table, 50).to_pylist()}
    # All windows of the first phrase are in document 2; the second shares those of the line with it, and has two of its own from 4.
    first, second = [50, 11, 2], [[51, 0 << 32 | 1, 4], [51, 2 << 32 | 12, 2], [51, 13 << 32 | 13, 4]]
    assert told == {1: [first, *second], 2: [first]}
