"""Encoding, counting and packing."""

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spendguard.llm.bpe import SegmentIds, SegmentLengths
from spendguard.llm.packing import best_fit, cut_pieces, lower_bound, pack, packed_digests, sequences
from spendguard.llm.token_counts import count_tokens

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{e}") for e in ("json", "tiktoken"))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def whole(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_segments_give_the_ids_of_whole_texts(library):
    rng = random.Random(5)
    parts = [*" \n\t\r\x0b\x1c\x85 　ab1.,'é", "  ", "\n\n", "'s", " 'll", "<|endoftext|>", "日本", "ß", " \n", "\r\n", "Ω", "\U0001f600"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += pq.read_table(f"{SF_DIR}/documents.parquet")["text"].to_pylist()
    want = [whole(library, t) for t in texts]
    ids = SegmentIds(JSON, RANKS, cache_bytes=60_000)
    assert [ids(t) for t in texts] == [array("I", w).tobytes() for w in want]
    count = SegmentLengths(JSON, cache_bytes=60_000)
    assert [n for at in range(0, len(texts), 7) for n in count(texts[at : at + 7])] == [len(w) for w in want]


def test_counts(odd_docs, no_docs, library):
    out = count_tokens(odd_docs, JSON, limit=20)
    texts = [r["text"] or "" for r in odd_docs.collect()]
    want = sorted((len(t.encode()), len(whole(library, t))) for t in texts)
    got = out.collect()
    assert sorted((r["n_bytes"], r["n_tokens"]) for r in got) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 20) for r in got)
    assert count_tokens(no_docs, JSON).count() == 0


def test_lower_bounds_hold():
    rng = np.random.default_rng(2)
    for _ in range(40):
        sizes = rng.integers(1, 21, rng.integers(1, 30))
        bound = lower_bound(np.bincount(sizes, minlength=21), 20)
        bins, _, room = best_fit(np.sort(sizes)[::-1], 20)
        assert bound <= len(room) and sum(20 - room) == sizes.sum()
    assert lower_bound(np.bincount([11] * 5, minlength=21), 20) == 5  # no two fit
    assert lower_bound(np.bincount([7] * 6, minlength=21), 20) == 3


def test_packing(odd_docs, no_docs, library):
    pieces = cut_pieces(odd_docs, JSON, RANKS, capacity=64)
    packed = pack(pieces, capacity=64, items_per_task=300)
    rows = packed.toPandas()
    docs = [array("I", [*whole(library, r["text"] or ""), 2]) for r in odd_docs.collect()]
    assert rows.length.sum() == sum(map(len, docs)) and rows.length.max() == 64
    ordered = rows.sort_values(["sequence_id", "offset"])
    filled = ordered.groupby("sequence_id").length
    assert (ordered.offset == filled.cumsum() - ordered.length).all() and filled.sum().max() <= 64
    assert filled.ngroups <= 1.03 * lower_bound(np.bincount(rows.length, minlength=65), 64) + 1
    joined = {r["sequence_id"]: r["ids"] for r in sequences(packed).collect()}
    for r in rows.itertuples():
        assert joined[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)] == r.ids
    mine = rows[rows.doc_id == 8].sort_values("piece")
    assert b"".join(mine.ids) == next(d.tobytes() for d, r in zip(docs, odd_docs.collect()) if r["doc_id"] == 8)
    assert packed_digests(no_docs).count() == 0


def test_digests(spark, library):
    docs = spark.createDataFrame([(1, "a b c " * 900), (2, None)], "doc_id long, text string")
    got = packed_digests(docs).orderBy("doc_id", "piece").collect()
    ids = [*whole(library, "a b c " * 900), 2]
    first = len(ids) % 1024
    want = [(1, 0, 0, first, ids[:first]), (1, 1, first, 1024, ids[first : first + 1024])]
    for row, (doc, piece, start, length, part) in zip(got, want):
        assert (row["doc_id"], row["piece"], row["start"], row["length"]) == (doc, piece, start, length)
        assert row["ids_crc32"] == zlib.crc32(array("I", part).tobytes())
    assert got[-1]["doc_id"] == 2 and got[-1]["length"] == 1


def test_segments_by_plain_searches_equal_the_pattern():
    import random

    from spendguard.llm import bpe

    rng = random.Random(5)
    for _ in range(50_000):
        text = "".join(rng.choice(" \n\t\u2003\x1cab") if rng.random() < 0.6 else rng.choice(" abc") for _ in range(rng.randint(0, 9)))
        want = bpe._SAFE_SPACE.split(text) if bpe._UNSAFE.search(text) else text.split(" ")
        assert bpe._segments(text) == want
