import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from mirrorframe.llm import merkle, queries

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos int, digest string, suffix int, root int"


def changed():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def levels(nodes):
    out = [nodes]
    while len(nodes) > 1:
        nodes = [H(*nodes[i : i + 2]) for i in range(0, len(nodes), 2)]
        out.append(nodes)
    return out


def path(tree, at):
    out = []
    for level in tree[:-1]:
        beside = at ^ 1
        out.append((beside < at, level[beside]) if beside < len(level) else (None, ""))
        at >>= 1
    return out


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {g: levels([leaf(r) for r in groups[g]]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = []
    for k, g in enumerate(names):
        for at, r in enumerate(groups[g]):
            way = path(trees[g], at) + path(top, k)
            end = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for left, d in way:
                end = H(d, end) if left else H(end, d)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], H(*[d for _, d in way]), end, end == top[-1][0]))
    return sorted(out, key=str)


def found(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, "d", 2, 3) for r in rows], SCHEMA)


@pytest.mark.parametrize("bits", [1, 3, merkle.BLOCK_BITS])
def test_documents_equal_a_plain_manifest(spark, sf, bits):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in docs.collect()]
    got = found(merkle.manifest(docs, changed(), bits))
    assert got == plain(rows) and {r[6] for r in got} == {True, False}


@pytest.mark.parametrize("bits", [1, 2, 5])
@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 9, 17, 33])
def test_sweeps_of_one_tree(n, bits):
    below = [H(str(i)).encode() for i in range(n)]
    tree = merkle.swept_up(below, None)
    assert [[d.decode() for d in level] for level in tree] == levels([d.decode() for d in below])
    ways = {at: [(s, d.decode()) for s, d in merkle.steps(suffix)] for at, suffix in merkle.swept_down(tree)}
    assert list(ways) == list(reversed(range(n)))
    sides = {None: merkle.NONE, True: merkle.LEFT, False: merkle.RIGHT}
    assert all(ways[at] == [(sides[left], d) for left, d in path(levels([d.decode() for d in below]), at)] for at in range(n))
    assert merkle.read(merkle.written(merkle.steps(next(s for at, s in merkle.swept_down(tree) if at == 0)))) == [(s, d.encode()) for s, d in ways[0]]


def test_odd_rows(spark):
    rows = [
        (7, "s", "en", 5, "héllo"), (None, None, None, None, None), (None, "s", None, 1, "x"), (3, "s", "", 0, ""), (3, "s", "", 0, ""), (3, "s", "", 0, None),
        (-4, "", "Z", 2, "ab"), (4, "", "a", 2, "ab"), (5, "", "é", None, "y" * 3_000_000), (14, "q", "en", None, "z"), (21, "q", "en", 9, "1:-"), *[(i, "s", "many", i, f"t{i}") for i in range(40)],
    ]
    got = found(merkle.manifest(frame(spark, rows).repartition(7), changed(), 2))
    assert got == plain(rows)


def test_equal_rows_make_one_tree_whatever_their_number(spark):
    rows = [(1, "s", "en", 1, "same")] * 70 + [(2, "s", "fr", 1, "other")]
    assert found(merkle.manifest(frame(spark, rows).repartition(6), changed(), 3)) == plain(rows)


def test_empty_table_and_single_rows(spark):
    assert merkle.manifest(frame(spark, [])).count() == 0
    one = [(9, "s", "en", 1, "alone")]
    ((_, own, subroot, root, proof, end, ok),) = found(merkle.manifest(frame(spark, one)))
    assert own == subroot == root == end and ok and proof == H("")


def test_many_langs_are_a_tree_of_their_own(spark):
    rows = [(i, "s", f"l{i % 50:02d}", 1, str(i)) for i in range(120)]
    assert found(merkle.manifest(frame(spark, rows), changed(), 1)) == plain(rows)


def test_the_query_marks_what_seven_divides(spark, sf):
    bad = {r.doc_id for r in queries.op12_merkle_manifest(spark, sf).where("not verified").collect()}
    assert bad == {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}
