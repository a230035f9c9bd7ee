import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from mirrorframe.llm import golay, simhash

SCHEMA = "doc_id long, text string, fp int, place string, id int, root long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], SCHEMA)


def plain_fingerprint(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """{fingerprint: root}, all pairs compared."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in combinations(sorted(set(fps)), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(b)] = find(a)
    return {f: find(f) for f in fps}


def plain(rows):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    roots = plain_components([f for _, f in fps])
    least = {}
    for i, f in fps:
        least[roots[f]] = min(i, least.get(roots[f], i))
    return {i: (f"{f:016x}", least[roots[f]]) for i, f in fps}


def found(rows):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in rows.collect()}


def test_the_code_is_perfect_and_keys_meet():
    remainders, errors = golay._tables()
    words = np.flatnonzero(remainders == 0)
    assert len(words) == 4096 and min(int(w).bit_count() for w in words[1:]) == 7
    assert len({int(w) >> 11 for w in words}) == 4096
    assert sorted({len(set(e)) for e in errors.tolist()}) == [1, 6]
    rng = random.Random(1)
    a = np.array([rng.getrandbits(23) for _ in range(3000)])
    flip = [sum(1 << b for b in rng.sample(range(23), rng.choice([0, 1, 2]))) for _ in a]
    assert all(set(x) & set(y) for x, y in zip(golay.indices(a), golay.indices(a ^ np.array(flip)), strict=True))


def test_documents_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(simhash.near_duplicates(docs)) == plain([(r.doc_id, r.text) for r in docs.collect()])


def linked(spark, fps, partitions=4):
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in fps]
    rows = spark.createDataFrame(signed, "fp long").repartition(partitions)
    return [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(rows).collect()]


@pytest.mark.parametrize("meeting", [simhash.MEETING, 3])
def test_links_connect_what_all_pairs_connect(spark, monkeypatch, meeting):
    monkeypatch.setattr(simhash, "MEETING", meeting)
    rng = random.Random(7)
    fps = set()
    for n in (1, 1, 2, 5, 40, 150):  # clouds of neighbours, up to four bits from their centre
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4]))) for _ in range(n)}
    chain = rng.getrandbits(64)
    for step in range(25):
        fps.add(chain)
        chain ^= 1 << (step * 5 % 64) | 1 << (step * 7 % 64)
    fps |= {0, (1 << 64) - 1, 1 << 63, (1 << 63) - 1}
    pairs = linked(spark, fps)
    assert all(a != b and (a ^ b).bit_count() <= 2 for a, b in pairs)
    want = plain_components(fps)
    got = {f: f for f in fps}

    def find(f):
        while got[f] != f:
            f = got[f]
        return f

    for a, b in pairs:
        got[find(a)] = find(b)
    classes = lambda of: {frozenset(f for f in fps if of(f) == r) for r in map(of, fps)}
    assert classes(find) == classes(want.__getitem__)


def test_a_crowd_sends_rows_in_proportion(spark):
    near = [1 << i | 1 << j for i in range(64) for j in range(i + 1)]  # all of one and two bits: each has over 120 neighbours
    few, many = linked(spark, near[:500]), linked(spark, near)
    bound = 65 + 9 * simhash.MEETING  # stars, and pairs at 18 places
    assert len(few) < bound * 500 and len(many) < bound * len(near) / 4
    assert len({a for pair in many for a in pair}) == len(near)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (4, "one two"), (5, "ONE\ttwo "), (6, "Ünï cödé x y z"), (7, "word " * 300_000), (8, "x" * 2_000_000), (9, "one two three four"), (10, "one two three four")]
    got = found(simhash.near_duplicates(frame(spark, rows)))
    assert got == plain(rows) and got[1] == ("0" * 16, 1) and got[3][1] == 1
    null = simhash.near_duplicates(frame(spark, [(None, "one two"), (4, "one two"), (None, None)])).collect()
    assert sorted(((r.doc_id, r.component_id) for r in null), key=str) == [(4, 4), (None, None), (None, None)]
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_repeated_ids_join_their_texts(spark):
    rows = [(5, "a b c d e"), (5, "v w x y z"), (3, "a b c d e"), (9, "v w x y z"), (9, "v w x y z")]
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == 5 and {r.component_id for r in got} == {3}


def test_many_shingles_are_counted_in_parts(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SHINGLES", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())
