"""Joins of documents and vectors against brute force."""

import random
import re

import numpy as np
import pytest
from conftest import WORDS

from spendguard.llm.graph import components
from spendguard.llm.jaccard import similar_documents
from spendguard.llm.lattice import ROOTS, near_vectors, nearest_e8
from spendguard.llm.topk import quantised, top_products

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def families():
    """Exact and near copies at many distances, and one passage in most of the texts."""
    rng = random.Random(8)
    passage = " ".join(rng.choice(WORDS) + str(i) for i in range(40))
    texts = []
    for family in range(12):
        base = [rng.choice(WORDS) + str(rng.randint(0, 300)) for _ in range(rng.randint(5, 120))]
        for _ in range(14):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"edit{rng.randint(0, 10**6)}"
            texts.append(" ".join(words) + (f" {passage}" if family % 3 else ""))
    return texts + [passage, passage.upper(), "one two", "one  two", "one", "", None, "a b c d"]


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7)]
    want = closure({n for pair in links for n in pair if pair[0] != pair[1]}, links)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: want[n] for n in got} and set(got) == {n for a, b in links if a != b for n in (a, b)}


@pytest.mark.parametrize("width, numerator", [(4, 85), (5, 80), (4, 75), (3, 50)])
def test_similar_documents(spark, width, numerator):
    texts = families()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, text in enumerate(texts):
        w = _WORD.findall((text or "").translate(lower))
        sets[i] = {tuple(w[j : j + width]) for j in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    links = [
        (i, j) for i in sets for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= numerator * len(sets[i] | sets[j])
    ]
    want = closure(sets, links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = similar_documents(docs, width, numerator).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in sets}


def test_odd_documents(odd_docs, no_docs):
    out = similar_documents(odd_docs).toPandas()
    assert len(out) == odd_docs.count()
    assert set(out[out.doc_id.isin([2, 3, 4])].n_shingles) == {0}
    assert set(out[out.doc_id.isin([6, 7])].component_id) == {6}
    assert similar_documents(no_docs).count() == 0


def test_nearest_lattice_points():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 2, (500, 8))
    near = nearest_e8(x)
    assert ((near * 2) % 1 == 0).all() and (near.sum(axis=1) % 2 == 0).all()
    own = ((x - near) ** 2).sum(axis=1)
    assert (own <= ((x[:, None] - near[:, None] - ROOTS) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()
    assert len(ROOTS) == 240 and np.allclose((ROOTS**2).sum(axis=1), 2)


def vectors():
    rng = np.random.default_rng(6)
    rows = []
    for family in range(30):
        base = rng.normal(size=64)
        for _ in range(8):
            rows.append((base + rng.normal(size=64) * rng.choice([0, 0.05, 0.12, 0.2])).astype(np.float32).tolist())
    return rows


def test_near_vectors(spark):
    rows = vectors()
    v = np.array(rows, np.float64)
    v /= np.sqrt((v**2).sum(axis=1))[:, None]
    label = [i % 2 for i in range(len(rows))]
    links = [(i, j) for i in range(len(v)) for j in range(i) if label[i] == label[j] and v[i] @ v[j] >= 0.98]
    want, n = closure(range(len(v)), links), np.bincount(np.array(links).ravel(), minlength=len(v))
    odd = [(900, None, 1), (901, [0.0] * 64, 1), (902, [float("nan")] * 64, 1), (903, rows[0], None), (904, [1.0, None], 1), (None, rows[0], 0)]
    df = spark.createDataFrame([*zip(range(len(v)), rows, label), *odd], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in near_vectors(df.selectExpr("*", "1 as n_links", "2 as kept")).collect()}
    found = sum(got[i]["n_links"] for i in range(len(v)))
    assert 0.99 * n.sum() <= found <= n.sum()
    assert sum(got[i]["component_id"] == want[i] for i in range(len(v))) >= 0.99 * len(v)
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] and got[i]["component_id"] == i for i in (900, 901, 902, 903, 904, None))
    assert near_vectors(df.where("false")).count() == 0


def test_near_vectors_of_one_cell_and_one_id(spark):
    """A cluster of several blocks, classes of copies in it, and rows that share an id."""
    rng = np.random.default_rng(2)
    base = rng.normal(size=64)
    near = base + rng.normal(size=(1300, 64)) * 0.02
    far = rng.normal(size=64)
    v = np.concatenate([near, near[:50], near[:50], [far, far]]).astype(np.float32)
    ids = [*range(len(v) - 2), 5, 5000]  # id 5 names a row of the cluster and one far from it
    df = spark.createDataFrame([(i, x.tolist(), 1) for i, x in zip(ids, v)], "vec_id long, embedding array<float>, label int")
    unit = v.astype(np.float64)
    unit /= np.sqrt((unit**2).sum(axis=1))[:, None]
    want = (unit @ unit.T >= 0.98).sum(axis=1) - 1
    got = near_vectors(df.repartition(5)).collect()
    assert sorted((r["vec_id"], r["n_links"]) for r in got) == sorted(zip(ids, want))
    assert {r["component_id"] for r in got if r["vec_id"] == 5} == {0, 5} and [r["component_id"] for r in got if r["vec_id"] == 5000] == [5]


def test_top_products_of_many_blocks(spark, monkeypatch):
    """Small blocks, lengths over four decades, repeated ids, vectors of two components: equal to brute force."""
    from spendguard.llm import topk

    monkeypatch.setattr(topk, "BUCKET", 64)
    monkeypatch.setattr(topk, "QUERIES", 16)
    rng = np.random.default_rng(4)
    v = rng.normal(size=(900, 2)) * 10 ** rng.uniform(-3, 1, 900)[:, None]
    ids = np.arange(900)
    ids[1::9] = ids[::9]  # two vectors under one id
    q = np.floor(1024 * v).astype(np.int64)
    df = quantised(spark.createDataFrame([(int(i), x.tolist()) for i, x in zip(ids, v)], "vec_id long, embedding array<double>"))
    asked = df.where("id % 4 = 2 and id % 9 <> 0")
    got = sorted(tuple(r) for r in top_products(df, asked).collect())
    want = []
    for i in np.flatnonzero((ids % 4 == 2) & (ids % 9 != 0)):
        scores = q @ q[i]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:10]
        want += [(int(ids[i]), r + 1, int(ids[j]), int(scores[j])) for r, j in enumerate(order)]
    assert got == sorted(want)


def test_top_products(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(size=(700, 12)) * rng.choice([0.1, 1, 4], 700)[:, None]
    v[40:60] = v[40]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [None] * 12), (702, [float("inf")] * 12), (710, [1.0, 2.0])]
    df = quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    q = np.floor(1024 * v).astype(np.int64)
    want = []
    for i in [*range(0, 700, 20), 41]:
        scores = q @ q[i]
        order = [j for j in np.lexsort((np.arange(700), -scores)) if j != i][:10]
        want += [(i, r + 1, int(j), int(scores[j])) for r, j in enumerate(order)]
    got = top_products(df, df.where("id % 20 = 0 or id in (41, 710)")).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert top_products(df.where("false"), df.where("false")).count() == 0
    few = top_products(df.where("id < 4"), df.where("id = 1")).collect()
    assert sorted(r["vec_id"] for r in few) == [0, 2, 3]
