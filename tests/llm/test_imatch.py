import random

import pytest

from mirrorframe.llm import imatch, queries


def near_copies(n, own_words):
    """`n` rows: a third are one text with a word exchanged, the others have words of a vocabulary each."""
    draw = random.Random(5)
    vocabulary = [f"v{i}" for i in range(400)]
    copied = [f"c{i}" for i in range(150)] if own_words else draw.sample(vocabulary, 150)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            text = [*copied]
            text[draw.randrange(150)] = f"u{i}"
        else:
            text = draw.choices(vocabulary, k=60)
        rows.append((i // 3 if i % 3 == 0 else n + i, " ".join(text)))
    return rows


@pytest.mark.parametrize("own_words", [True, False])
def test_near_copies_that_hold_a_third_of_the_rows(spark, tmp_path, own_words):
    rows = near_copies(900, own_words)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: r for r in queries.op7_imatch_fingerprints(spark, str(tmp_path)).collect()}
    assert len(found) == 900
    copies = [found[i] for i in range(1, 300)]
    assert not any(r.fingerprint.startswith("=") for r in found.values())
    assert min(r.near_next for r in copies) > 0.8
    assert min(r.near_edited for r in copies) > 0.3
    others = [r.near_next for i, r in found.items() if i > 900]
    assert sum(others) / len(others) < 0.2


def test_copies_do_not_move_the_band(spark):
    single = [(i, f"common rare{i} {' '.join(f'w{(i + k) % 100}' for k in range(5))}") for i in range(100)]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    terms = lambda rows: {r.term for r in imatch.whole_lexicon(frame(rows)).collect()}
    assert terms(single) == terms(single + [(100 + i, single[7][1]) for i in range(50)])


def test_texts_with_few_terms_within_the_band(spark):
    rows = [(i, " ".join(f"w{k}" for k in range(10))) if i % 2 else (i, " ".join(f"w{k}" for k in range(i % 9 + 1))) for i in range(40)] + [(50, None), (51, "")]
    found = {r.doc_id: r for r in imatch.compared(spark.createDataFrame(rows, "doc_id long, text string"), whole=True).collect()}
    assert all(r.fingerprint.startswith("=") == (i >= 50) for i, r in found.items())
    assert found[2].near_next > 0 and found[51].near_next == 1.0
