import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mirrorframe.llm import packing, tokens

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids binary, pack int, start long"
ODD = [None, "", " ", "  ", "a  b", " a", "a ", "\n", "a\n\nb  c ", "▁ ▁a b▁", "<s> </s> <unk> <|endoftext|> x<|startoftext|>y", "Don't we're I'LL 'S", "É İstanbul ΣΑΣ ﬁ ½ ²x", "é å ́x",
       "日本語 テスト 😀 👩‍👩‍👧", "a b c\x0bd\x1ce", "x" * 5000, "tab\tsep\r\nend", "\x00 \x01", "ǅ ŉ ǰ ſ", "don''t !!' ' s"]

text = st.text(st.sampled_from("ab  ▁\n'sté½İ<|>😀́ \x0b.!"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(text, max_size=5))
def test_counts_equal_the_library(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert list(tokens._counter(PIECES)(pa.array(texts, pa.large_string()))) == [len(model.encode(t)) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(text, max_size=5))
def test_ids_equal_the_library(texts):
    model = Tokenizer.from_file(WORDS)
    where, ids = tokens.word_ids(WORDS)(pa.array(texts, pa.large_string()))
    assert [list(ids[a:b]) for a, b in zip(where[:-1], where[1:], strict=True)] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_memory_is_packed():
    """100,000 words are remembered in 5.3 MB; as strings in dictionaries they took 13.3 MB."""
    words = [f"w{i * 7919 % 1_000_003}" for i in range(100_000)]
    encode = tokens.WordIds(WORDS)
    encode(pa.array([""], pa.large_string()))
    tracemalloc.start()
    where, ids = encode(pa.array([" ".join(words)], pa.large_string()))
    del where, ids
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 8e6


@pytest.mark.parametrize("alike", [False, True])
def test_lexicon(alike):
    """Words that come back after any time, empty and long ones; `alike` gives all words one hash."""
    rng = random.Random(3)
    lexicon = tokens.Lexicon(lambda words: [np.arange(len(w) % 5, dtype="<u2").tobytes() + w.encode() + w.encode() for w in words], 20, np.dtype("<u2"))
    if alike:
        lexicon._letters[:] = 0
    for _ in range(60):
        words = list({rng.choice("abcé") * rng.choice([0, 1, 2, 3, 300, 301]) + str(rng.randrange(30)) * rng.randrange(2) for _ in range(12)})
        begins, sizes, ids = lexicon(pa.array(words, pa.large_string()))
        found = [ids[a : a + n].tobytes() for a, n in zip(begins, sizes, strict=True)]
        assert found == [np.arange(len(w) % 5, dtype="<u2").tobytes() + w.encode() + w.encode() for w in words]


def test_safe_pieces():
    rng = random.Random(2)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for _ in range(50):
        t = "".join(rng.choice(["ab", " ", "c", "  ", "▁", "\n"]) for _ in range(200))
        assert sum(len(model.encode(x)) for x in tokens.safe_pieces(t, 20)) == len(model.encode(t))


@pytest.fixture(scope="module")
def docs(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (7, "again"), (7, "again")]
    return rows, spark.createDataFrame([(i, t, b"", 1, 2) for i, t in rows], SCHEMA)


def test_token_counts(docs):
    rows, frame = docs
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    want = []
    for i, t in rows:
        n = len(model.encode(t or ""))
        want.append((i, len((t or "").encode()), n, n > 4096))
    assert sorted(map(tuple, tokens.token_counts(frame, PIECES).collect()), key=str) == sorted(want, key=str)


def check(found, rows, model, window=2048):
    """Every id in one piece, sequences gapless; returns the share of padding."""
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.array([*model.encode(t or "", add_special_tokens=False).ids, 1], "<u4"))
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id].append(r)
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    for i, parts in documents.items():
        assert sum(r.length for r in parts) == sum(len(x) for x in ids[i])
        if len(ids[i]) == 1:
            end = 0
            for r in sorted(parts, key=lambda r: r.start):
                assert r.start == end
                end += r.length
    assert set(documents) == set(ids)
    padding = total = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end and length > 0
            end += length
        assert end <= window
        total += end
        padding += 0 if end & (end - 1) == 0 else window - end
    return padding / (padding + total)


def test_packing(docs):
    rows, frame = docs
    assert check(packing.pack(frame, WORDS).collect(), rows, Tokenizer.from_file(WORDS)) < 0.01


def test_equal_lengths_are_cut_to_fill(spark):
    rows = [(i, "the " * 1099) for i in range(300)]
    frame = spark.createDataFrame([(i, t, b"", 1, 2) for i, t in rows], SCHEMA)
    assert check(packing.pack(frame, WORDS).collect(), rows, Tokenizer.from_file(WORDS)) < 0.01


def test_empty_table(spark):
    frame = spark.createDataFrame([], SCHEMA)
    assert packing.pack(frame, WORDS).count() == tokens.token_counts(frame, PIECES).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=5), st.integers(0, 40))
def test_fullest_is_the_best_sum(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    taken = packing.fullest(counts, sorted(counts), capacity)
    assert all(n <= counts[x] for x, n in taken.items())
    assert sum(x * n for x, n in taken.items()) == max(s for s in sums if s <= capacity)
