"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from spendguard.llm.importance import BucketHash, boundary, hashed_runs, resample
from spendguard.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text, width=3):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, width + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, percent=5, least=20, buckets=10_000):
    """doc_id, features, weight, score, rank of every (doc_id, text)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    found = [(i, *runs(text)) for i, text in docs]
    s, t = [0] * buckets, [0] * buckets
    for _, _, features in found:
        for f in features:
            s[bucket(f)] += 1
    for text in target:
        for f in runs(text)[1]:
            t[bucket(f)] += 1
    whole, wanted = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (whole + buckets) / ((a + 1) * (wanted + buckets)))) for a, b in zip(s, t)]
    rows, able = [], []
    for i, words, features in found:
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(features), weight, score, None])
        if words >= least:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return sorted(rows, key=str)


def got(df):
    return sorted(([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in df.collect()), key=str)


def test_buckets_of_runs():
    texts = ["", "One two  THREE", "é" * 300 + " b " + "z" * 400 + " c d", "x", None or "", "a1 b2 c3 " * 40, "日本 ß " * 3]
    for most in (4, 1000):
        hashed = BucketHash(10_000, 3)
        seen = [[] for _ in texts]
        sizes = np.zeros(len(texts), int)
        for bucket, owner, words in hashed_runs(texts, hashed, most):
            sizes += words
            for b, i in zip(bucket.tolist(), owner.tolist()):
                seen[i].append(b)
        for text, size, buckets in zip(texts, sizes, seen):
            words, features = runs(text)
            assert size == words and sorted(buckets) == sorted(zlib.crc32(f.encode()) % 10_000 for f in features)


def test_odd_tables(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([("alpha beta gamma",), (None,), ("Delta 7",)], "text string")
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    target = [r["text"] for r in bench.collect()]
    assert got(resample(odd_docs, bench, percent=50)) == brute(docs, target, percent=50)
    assert got(resample(odd_docs, bench.where("false"), percent=100, min_words=0)) == brute(docs, [], percent=100, least=0)
    assert resample(no_docs, bench).count() == 0


@pytest.mark.parametrize("sort_rows", [1, 50, 100_000])
def test_ties_and_repeated_rows(spark, sort_rows):
    docs = [(i % 7 if i % 3 else None, "one two three " * (7 + i % 2)) for i in range(400)] + [(5, "same words " * 30)] * 300
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    bench = spark.createDataFrame([("two three",)], "text string")
    assert got(resample(table, bench, percent=37, sort_rows=sort_rows)) == brute(docs, ["two three"], percent=37)


@pytest.mark.parametrize("count", [1, 2, 333, 1999, 2000])
def test_boundary_whatever_the_sketch_says(spark, count):
    rng = np.random.default_rng(3)
    score = np.where(rng.random(2000) < 0.4, 17, (rng.pareto(0.3, 2000) * 1e3).clip(0, 2**60)).astype(np.int64) - 1000
    rows = spark.createDataFrame([(int(s), i) for i, s in enumerate(score)], "score long, tie long").repartition(4)
    want = sorted(zip(score.tolist(), range(2000)), reverse=True)[count - 1]
    for accuracy in (2, 10_000):
        assert boundary(rows, 2000, count, ["score", "tie"], sort_rows=5, accuracy=accuracy) == want
    assert boundary(rows, 2000, 0, ["score", "tie"]) is None


def test_registered_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert got(QUERIES["op11_importance"](spark, SF_DIR)) == brute(docs, target)
