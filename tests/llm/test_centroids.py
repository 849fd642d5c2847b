"""Bounded k-means rounds against measuring everything."""

import hashlib
import math

import numpy as np
import pytest
from conftest import SF_DIR

from spendguard.llm.centroids import cluster_vectors
from spendguard.llm.queries import QUERIES


def brute(rows, k, rounds, dim, scale=256, seed=2):
    """Sorted (id, cluster, distance) and the centroids."""
    fine = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    vectors = [tuple(max(-(2**26), min(2**26, math.floor(scale * x))) for x in v) for _, v in fine]
    order = sorted(
        range(len(fine)),
        key=lambda n: (hashlib.sha256(f"{seed}:{'' if fine[n][0] is None else fine[n][0]}".encode()).hexdigest(), vectors[n]),
    )
    centroids = [vectors[n] for n in order[:k]]
    for number in range(rounds + 1):
        nearest = [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for v in vectors]
        if number < rounds:
            for j in range(len(centroids)):
                mine = [v for v, (_, m) in zip(vectors, nearest) if m == j]
                if mine:
                    centroids[j] = tuple(sum(x) // len(mine) for x in zip(*mine))
    return sorted(((i, j, d) for (i, _), (d, j) in zip(fine, nearest)), key=str), centroids


@pytest.mark.parametrize("shape", ["blobs", "copies", "few", "wide"])
def test_same_as_measuring_all(spark, shape):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 5)) * 3
    if shape == "blobs":
        points = (centres[rng.integers(0, 6, 500)] + rng.normal(size=(500, 5)) * 0.3).tolist()
    elif shape == "copies":
        points = [[0.5] * 5] * 200 + [[0.5, 0.5, 0.5, 0.5, -1.0]] * 30 + rng.integers(-2, 3, (60, 5)).astype(float).tolist()
    elif shape == "few":
        points = [[1.0, 2.0, 3.0, 4.0, 5.0]] * 2 + [[0.0] * 5]
    else:
        points = (rng.normal(size=(200, 5)) * 1e5).tolist() + [[1e30, -1e30, 0.0, 0.0, 1.0]]
    rows = [(n // 2 if n % 5 else None, p) for n, p in enumerate(points)]
    rows += [(1, None), (2, [1.0]), (3, [1.0, None, 1.0, 1.0, 1.0]), (4, [float("nan")] * 5), (5, [float("inf")] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as cluster", "1 as distance", "2 as _id")
    found = cluster_vectors(table, k=12, rounds=5, dim=5)
    want, centroids = brute(rows, 12, 5, 5)
    got = found.rows.collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == want
    assert [tuple(c) for c in found.centroids.tolist()] == centroids
    assert sum(found.inertia) == sum(d for _, _, d in want)
    if shape == "blobs":  # the bounds spare measurements
        assert sum(r["measured"] for r in got) < 0.6 * 6 * 12 * len(got)


def test_empty_tables(spark):
    table = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    found = cluster_vectors(table)
    assert found.rows.count() == 0 and set(found.rows.columns) >= {"vec_id", "cluster", "distance"} and found.inertia == []


def test_registered_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()]
    want, centroids = brute(rows, 40, 5, 64)
    got = QUERIES["op13_centroids"](spark, SF_DIR).collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == want
    for r in got:
        assert r["inertia"] == sum(d for _, _, d in want)
        assert r["cluster_inertia"] == sum(d for _, j, d in want if j == r["cluster"])
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centroids[r["cluster"]])).encode()).hexdigest()
