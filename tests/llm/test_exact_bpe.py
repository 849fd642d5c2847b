"""Backtracking BPE against the tokenizer library."""

import hashlib
import random
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF_DIR
from tokenizers import Tokenizer

from spendguard.llm.exact_bpe import TextEncoder, decode_ids, encode_texts
from spendguard.llm.memory import slices
from spendguard.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [*" \n\t\r\x0b\x1c\x1d\x85 　ab1.,'éßΣİ\x00½Ⅷǅﬁ\xa0", "'s", "'ll", "'RE", "é", "ΑΣ", "日本", "\U0001f600", "the", "ing", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "​", " "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encode():
    return TextEncoder(PATH, cache_bytes=200_000)


def check(library, encode, text):
    want = library.encode(text, add_special_tokens=False).ids
    got = np.frombuffer(encode(text), "<u4").astype(np.int64)
    assert got.tolist() == want, text[:80]
    assert encode.words.decode(got) == library.decode(want, skip_special_tokens=False)


def test_odd_texts(library, encode):
    rng = random.Random(4)
    for _ in range(6000):
        check(library, encode, "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))))


@pytest.mark.parametrize("letters", ["ab", "aeinorsth", "abcdefghijklmnopqrstuvwxyz"])
def test_random_words(library, encode, letters):
    rng = random.Random(7)
    for n in (1, 2, 5, 13, 60, 400):
        for _ in range(400):
            check(library, encode, "".join(rng.choice(letters) for _ in range(n)))


def test_long_words_take_linear_time(library, encode):
    for text in ("x" * 200_000, "ab" * 100_000, "日本語" * 30_000):
        check(library, encode, text)


def test_compatible_pairs_are_those_that_merging_leaves_alone(encode):
    def merge(symbols):
        """Plain merging by rank, leftmost first."""
        ids = [single[s] for s in symbols]
        while True:
            ranked = [(words.merged[pair], i) for i in range(len(ids) - 1) if (pair := ids[i] << 32 | ids[i + 1]) in words.merged]
            if not ranked:
                return ids
            token, i = min(ranked)
            ids[i : i + 2] = [token]

    words, rng = encode.words, random.Random(1)
    single = {s: i for i, s in enumerate(words.strings) if len(s) == 1}
    inner = [i for i, s in enumerate(words.strings[:4000]) if s and ord(s[-1]) < 256 and words.search.get(s, None) == i]
    for _ in range(4000):
        a, b = rng.choice(inner), rng.choice(inner)
        assert words.pairs[a << 32 | b] == (merge(words.strings[a] + words.strings[b]) == [a, b])


def test_tables(odd_docs, no_docs, library):
    encoded = encode_texts(odd_docs, PATH, max_bytes=1000)
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["ids"]) for r in encoded.collect())
    ids = [(r["doc_id"] or 0, library.encode(r["text"] or "", add_special_tokens=False).ids) for r in odd_docs.collect()]
    assert got == sorted((i, len(t), array("I", t).tobytes()) for i, t in ids)
    texts = sorted((r["doc_id"] or 0, r["text"]) for r in decode_ids(encoded, PATH).collect())
    assert texts == sorted((i, library.decode(t, skip_special_tokens=False)) for i, t in ids)
    assert encode_texts(no_docs, PATH).count() == 0 == decode_ids(encode_texts(no_docs, PATH), PATH).count()


def test_registered_query(spark, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = QUERIES["op12_exact_bpe"](spark, SF_DIR).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]], add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_slices_cover_a_column_and_stay_small():
    column = pa.array(["a" * 5, "", "b" * 30, None, "c" * 4, "d" * 4, "e"])
    parts = [p.to_pylist() for p in slices(column, 10)]
    assert sum(parts, []) == column.to_pylist()
    assert all(len(p) == 1 or sum(len(v or "") for v in p) <= 10 for p in parts)
    assert list(slices(column.slice(0, 0), 10)) == []
