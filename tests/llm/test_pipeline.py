import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from mirrorframe.llm import toxicity
from tests.llm import brute
from tests.llm.test_native import plain_containment
from tests.llm.test_tokens import check


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    place = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        stage(spark, out[-1], sf).write.parquet(f"{place}/{name}")
        out.append(spark.read.parquet(f"{place}/{name}"))
    return out


def texts(frame):
    return {r.doc_id: r.text for r in frame.collect()}


def test_columns_and_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_dedup", "suffix_array_dedup", "decontamination", "packing"]


def test_each_stage_takes_effect_on_what_the_last_one_kept(spark, sf, stages):
    docs, clean, single, left, safe, packed = stages
    for frame in stages[:-1]:
        assert [(f.name, f.dataType) for f in frame.schema] == [(f.name, f.dataType) for f in docs.schema]
    scored = toxicity.toxicity_scores(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert texts(clean) == {i: t for i, t in texts(docs).items() if i in {r.doc_id for r in scored.where("predicted = 0").collect()}}
    components = brute.near_duplicates(list(texts(clean).items()), 5)
    assert texts(single) == {i: t for i, t in texts(clean).items() if components[i][1] == i}
    removed = brute.repeats(list(texts(single).items()))
    assert texts(left) == {i: x[4].decode("utf-8", "ignore") for i, x in removed.items()}
    assert all(r.n_chars == len(r.text) for r in left.collect())
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {d for d, *_ in plain_containment(list(texts(left).items()), items)}
    assert texts(safe) == {i: t for i, t in texts(left).items() if i not in leaks} and leaks
    assert check(packed.collect(), list(texts(safe).items()), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))) < 0.05


def test_stages_take_odd_rows(spark, sf):
    passage = " ".join(f"p{i}" for i in range(40))
    rows = [(1, passage, "en", "s", 1), (2, passage + " q", None, None, None), (None, passage, None, None, None), (None, None, None, None, None), (3, None, "x", "y", 0), (4, "", "x", "y", 0),
            (5, "é" * 60, "x", "y", 0), (6, "aé" + "é" * 60, "x", "y", 0), (7, "a b c", "x", "y", 3), (7, "a b c", "x", "y", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert pipeline.drop_toxic(spark, docs, sf).count() == len(rows)
    kept = sorted(((r.doc_id, r.text) for r in pipeline.keep_one_of_each_group(spark, docs, sf).collect()), key=str)
    assert [i for i, _ in kept] == [1, 3, 4, 5, 6, 7, None]  # the null id's copy of a passage goes, its null text stays
    left = {(r.doc_id, r.text) for r in pipeline.drop_repeated_passages(spark, docs, sf).collect()}
    assert (1, passage) in left and (2, " q") in left and (None, passage) in left and (None, None) in left and (3, None) in left
    assert pipeline.drop_leaks(spark, docs, sf).count() == len(rows)
    for _, stage in pipeline.STAGES:
        stage(spark, docs.limit(0), sf).count()


def test_rows_with_one_id_or_none_are_judged_by_their_texts(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    other = " ".join(f"q{i}" for i in range(40))
    rows = [(1, other, "en", "s", 1), (1, " ".join(f"z{i}" for i in range(40)), "en", "s", 1), (None, item, "en", "s", 1), (2, item, "en", "s", 1), (None, other, "en", "s", 1), (None, "a text of its own here", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text[:2]) for r in pipeline.keep_one_of_each_group(spark, docs, sf).collect()), key=str)
    assert kept == sorted([(1, "q0"), (1, "z0"), (2, item[:2]), (None, "a ")], key=str)
    safe = sorted(((r.doc_id, r.text) for r in pipeline.drop_leaks(spark, docs, sf).collect()), key=str)
    assert safe == sorted([(i, t) for i, t, *_ in rows if t != item], key=str)
