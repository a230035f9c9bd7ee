"""Token counts and token ids of many texts, encoded once per distinct word.

Words are cut where no token can reach across, so a text's ids are those of its words; each task encodes a distinct word
once and remembers it. Results equal the libraries' for the whole text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorframe.llm import bytescan as B

LIMIT = 4096
# Text bytes handled at once, words and parts of words that a worker remembers in each of two
# generations, and characters of a text encoded in one call.
BATCH_BYTES = 2 << 20
REMEMBERED = 300_000
CALL_CHARS = 1 << 16
# The same for words and parts whose ids are kept in packed arrays, some 50 bytes each; longer ones are not remembered.
PACKED_WORDS = 500_000
PACKED_PARTS = 200_000
LONGEST = 256


class Memory:
    """What was last computed for a key: two generations of about `size` entries each."""

    def __init__(self, compute: Callable[[list[str]], list], size: int):
        self._compute, self._size, self._new, self._old = compute, size, {}, {}

    def __call__(self, keys: list[str]) -> list:
        new, old = self._new, self._old
        missing = [k for k in keys if k not in new]
        unknown = []
        for k in missing:
            if k in old:
                new[k] = old[k]
            else:
                unknown.append(k)
        if unknown:
            new.update(zip(unknown, self._compute(unknown), strict=True))
        found = [new[k] for k in keys]
        if len(new) > self._size:
            self._new, self._old = {}, new
        return found


def _cut_out(flat: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of `flat` that begin there and have these sizes, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _listed(column: pa.Array) -> list:
    """`column`, which has no nulls, as a list; by way of numpy, several times as fast as value by value."""
    return column.to_numpy(zero_copy_only=False).tolist()


@dataclass(frozen=True)
class Generation:
    """Words ascending by hash: where each begins in `text` and its ids in `ids`, and how long they are."""

    hashes: np.ndarray
    at: np.ndarray
    length: np.ndarray
    begin: np.ndarray
    size: np.ndarray
    text: np.ndarray
    ids: np.ndarray

    @staticmethod
    def empty(dtype: np.dtype) -> Generation:
        return Generation(np.zeros(0, np.uint64), *[np.zeros(0, t) for t in (np.int64, np.int32, np.int64, np.int32, np.uint8, dtype)])

    def find(self, hashes: np.ndarray, at: np.ndarray, length: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which, place): the words that are here, compared byte by byte, and their places."""
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        which = np.flatnonzero((self.hashes[place] == hashes) & (self.length[place] == length))
        place, length = place[which], length[which]
        differ = _cut_out(text, at[which], length) != _cut_out(self.text, self.at[place], length)
        if differ.any():
            same = np.bincount(np.repeat(np.arange(len(which)), length)[differ], minlength=len(which)) == 0
            which, place = which[same], place[same]
        return which, place

    def joined(self, hashes: np.ndarray, length: np.ndarray, size: np.ndarray, text: np.ndarray, ids: np.ndarray) -> Generation:
        """With further words, whose bytes and ids follow each other."""
        order = np.argsort(hashes, kind="stable")
        where = np.searchsorted(self.hashes, hashes[order])
        at, begin = len(self.text) + np.cumsum(length) - length, len(self.ids) + np.cumsum(size) - size
        more = zip((self.hashes, self.at, self.length, self.begin, self.size), (hashes, at, length, begin, size), strict=True)
        return Generation(*[np.insert(old, where, new[order]) for old, new in more], np.concatenate([self.text, text]), np.concatenate([self.ids, ids]))


class Lexicon:
    """Ids of words, computed when last seen long ago or never: two generations of about `size` words, as `Memory` has them.

    Words are looked up all at once by a 64-bit hash and then compared, so an entry takes some 50 bytes in place of the
    200 of strings in a dictionary.
    """

    def __init__(self, compute: Callable[[list[str]], list[bytes]], size: int, dtype: np.dtype):
        self._compute, self._size, self._dtype = compute, size, dtype
        self._new = self._old = Generation.empty(dtype)
        self._letters = B.constants(256, 31)
        self._powers = np.multiply.accumulate(np.full(LONGEST, 0x9E3779B97F4A7C15, np.uint64))

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begins, sizes, ids): where the ids of each of these words, which are all different, are."""
        run = next(B.runs(words, 1 << 62), None)
        if run is None:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self._dtype)
        at, length = run.offsets[:-1], np.diff(run.offsets)
        inside = np.arange(len(run.data)) - np.repeat(at, length)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self._letters[run.data] * self._powers[inside % LONGEST])])
        hashes = B.mix(sums[run.offsets[1:]] - sums[at])
        known, place = self._new.find(hashes, at, length, run.data)
        left = np.ones(len(at), bool)
        left[known] = False
        rest = np.flatnonzero(left)
        kept, old = self._old.find(hashes[rest], at[rest], length[rest], run.data)
        kept = rest[kept]
        left[kept] = False
        fresh = np.flatnonzero(left)
        blobs = self._compute(_listed(words.take(pa.array(fresh)))) if len(fresh) else []
        computed = np.frombuffer(b"".join(blobs), self._dtype)
        begins, sizes = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        begins[known], sizes[known] = self._new.begin[place], self._new.size[place]
        sizes[kept] = self._old.size[old]
        sizes[fresh] = np.fromiter(map(len, blobs), np.int64, len(blobs)) // self._dtype.itemsize
        again = _cut_out(self._old.ids, self._old.begin[old], self._old.size[old])
        ids = np.concatenate([self._new.ids, again, computed])
        moved = np.concatenate([kept, fresh])
        begins[moved] = len(self._new.ids) + np.cumsum(sizes[moved]) - sizes[moved]
        some = moved[length[moved] <= LONGEST]
        if len(some):
            self._new = self._new.joined(hashes[some], length[some], sizes[some], _cut_out(run.data, at[some], length[some]), _cut_out(ids, begins[some], sizes[some]))
        if len(self._new.hashes) > self._size:
            self._new, self._old = Generation.empty(self._dtype), self._new
        return begins, sizes, ids


def batches_of_texts(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about BATCH_BYTES; null counts as empty."""
    for run in B.runs(column, BATCH_BYTES):
        offsets = pa.py_buffer(run.offsets.astype(np.int64))
        yield run.first, pa.LargeStringArray.from_buffers(run.rows, offsets, pa.py_buffer(run.data))


def safe_pieces(text: str, size: int = CALL_CHARS) -> Iterator[str]:
    """`text` cut before single spaces that follow other characters: pieces of a tokenizer that marks words by a
    leading space never reach across. The space is dropped, as the tokenizer puts one before each call's text."""
    start = 0
    while len(text) - start > size:
        cut = text.find(" ", start + size)
        while cut > 0 and (text[cut - 1] in " ▁" or text[cut + 1 : cut + 2] in ("", " ", "▁")):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


@lru_cache(maxsize=2)
def _counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    count = Memory(lambda words: [len(x) for x in model.encode(words, num_threads=1)], REMEMBERED)

    def counts(texts: pa.Array) -> np.ndarray:
        # Single spaces between words: cut at all of them. Other texts are encoded in long pieces.
        odd = pc.match_substring_regex(texts, "^ |  | $|▁").to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        words = lists.flatten().dictionary_encode()
        per_word = np.array(count(words.dictionary.to_pylist()), np.int64)
        per_word = per_word[words.indices.to_numpy()] if len(words) else np.zeros(0, np.int64)
        totals = np.concatenate([[0], np.cumsum(per_word)])[lists.offsets.to_numpy()]
        out = np.diff(totals)
        for row in np.flatnonzero(odd):
            out[row] = sum(len(x) for x in model.encode(list(safe_pieces(texts[row].as_py())), num_threads=1))
        return out

    return counts


def token_counts(docs: DataFrame, model: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of `docs`; a null text is empty and has none, a null id stays.

    `model` is the path of a sentencepiece model that marks words by a leading space, on every executor. Nothing but
    lengths leaves the Arrow function; its batches are of equal bytes, whatever the number of texts. Rows are neither
    moved nor merged, so repeated ids and other columns make no difference.
    """

    def scan(batches):
        counts = _counter(model)
        for batch in batches:
            for first, texts in batches_of_texts(batch.column(1)):
                sizes = pc.binary_length(texts).cast(pa.int64())
                tokens = pa.array(counts(texts), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), sizes, tokens, pc.greater(tokens, limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
                )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(scan, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


class WordIds:
    """Ids of texts under a tokenizer that drops white space and marks the last piece of a word by a suffix."""

    # Characters that lower-case one to one and are already composed, so a word of these can be cut by the pattern here.
    _PLAIN = "^[!-\u012f\u0131-\u0148\u014a-\u01c3\u01cd-\u01ef\u01f4-\u024f]*$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._model = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self._model.get_vocab_size() <= 1 << 16 else "<u4")
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        suffix = spec["model"]["end_of_word_suffix"]
        self._special = "|".join(re.escape(x["content"]) for x in spec["added_tokens"]) or "$^"
        # The pattern matches no white space, so a space after each word tells where its parts end.
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self._pattern = regex.compile(f"{pattern}| ")
        self._last = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self._last[[i for piece, i in spec["model"]["vocab"].items() if piece.endswith(suffix)]] = True
        self._parts = Lexicon(self._encode_parts, PACKED_PARTS, self.dtype)
        self._words = Lexicon(self._encode_words, PACKED_WORDS, self.dtype)

    def _encode_parts(self, parts: list[str]) -> list[bytes]:
        """Parts are cut by the pattern: joined by spaces they are encoded as each is alone."""
        out = []
        for first in range(0, len(parts), 256):
            some = parts[first : first + 256]
            ids = np.array(self._model.encode(" ".join(some), add_special_tokens=False).ids, self.dtype)
            ends = np.flatnonzero(self._last[ids]) + 1
            if len(ends) != len(some):
                raise ValueError("the tokenizer does not mark where words end")
            data, cuts = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
            out += [data[a:b] for a, b in zip([0, *cuts], cuts)]
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        column = pa.array(words, pa.string())
        plain = _listed(pc.and_not(pc.match_substring_regex(column, self._PLAIN), pc.match_substring_regex(column, self._special)))
        parts = self._pattern.findall("".join([f"{w} " for w, ok in zip(words, plain, strict=True) if ok]).lower())
        coded = pa.array(parts, pa.string()).dictionary_encode()
        apart = pc.index(coded.dictionary, " ").as_py()
        begins, sizes, ids = self._parts(coded.dictionary.filter(pc.not_equal(coded.dictionary, " ")))
        if parts:  # the space itself has no ids
            begins, sizes = np.insert(begins, apart, 0), np.insert(sizes, apart, 0)
        codes = coded.indices.to_numpy()
        ends, ids = np.cumsum(sizes[codes]), _cut_out(ids, begins[codes], sizes[codes])
        data, size = ids.tobytes(), self.dtype.itemsize
        lasts = (ends[codes == apart] * size).tolist()
        cut = iter([data[a:b] for a, b in zip([0, *lasts], lasts)])
        return [next(cut) if ok else np.array(self._model.encode(w, add_special_tokens=False).ids, self.dtype).tobytes() for w, ok in zip(words, plain, strict=True)]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids): the ids of all texts, one after the other."""
        lists = pc.ascii_split_whitespace(texts)
        words = lists.flatten().dictionary_encode()
        begins, sizes, ids = self._words(words.dictionary)
        codes = words.indices.to_numpy()
        ends = np.cumsum(sizes[codes])
        ids = _cut_out(ids, begins[codes], sizes[codes])
        return np.concatenate([[0], ends])[lists.offsets.to_numpy()], ids


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)
