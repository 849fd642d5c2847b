"""Exact k-means rounds over integer vectors with bounds that remember when they were measured (Newling & Fleuret 2016).

Every vector keeps its distance to its own centroid and, for every other centroid, a lower bound and the round in
which the distance was measured. All former centroids are kept, so a bound is loosened by the length of the one
straight displacement from then to now, which is never longer than the sum of the steps between. Only centroids whose
loosened bound does not rule them out are measured again, in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendguard.llm.registry import query, table
from spendguard.llm.vectors import all_finite
from spendguard.scratch import delete, materialise, scratch_path, spread

# Components beyond this become it: squared distances of up to 256 of them fit 63 bits.
_LARGEST = 1 << 26
_SLACK = 1e-9  # relative; far above the rounding of a square root, far below what a bound can lose


@dataclass
class Clusters:
    """Rows: the id, `cluster` (int), `distance` (long, squared), `measured` (long: exact distances over all rounds)."""

    rows: DataFrame
    centroids: np.ndarray  # (clusters, components), int64
    inertia: list[int]  # distance summed over each cluster


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the integer rows of `x` to one centroid."""
    difference = x - c
    return np.einsum("ij,ij->i", difference, difference)


def _sums(rows: DataFrame, k: int, dim: int) -> tuple[list[list[int]], list[int]]:
    """Changes of the componentwise sums and of the sizes of the clusters by the rows that changed theirs."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, size = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for column, sign in ((1, 1), (2, -1)):
                cluster = batch.column(column).to_numpy()
                for j in np.unique(cluster[cluster >= 0]):
                    mine = cluster == j
                    total[j] += sign * x[mine].sum(axis=0)
                    size[j] += sign * np.count_nonzero(mine)
        values = np.column_stack([total, size]).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["cell", "value"])

    moved = rows.where("cluster <> former").select("_vector", "cluster", "former")
    cells = moved.mapInArrow(add, "cell long, value long").groupBy("cell").agg(F.sum(F.col("value").cast("decimal(38,0)")))
    table_ = np.zeros(k * (dim + 1), object)
    for cell, value in cells.collect():  # clusters × (components + 1) rows, whatever the input
        table_[cell] = int(value)
    table_ = table_.reshape(k, dim + 1)
    return table_[:, :dim], table_[:, dim]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _assign(rows: DataFrame, history: list[np.ndarray], id_type: str) -> DataFrame:
    """One round: every vector to its nearest centroid of `history[-1]`; ties go to the smaller number."""
    now, (k, dim) = len(history) - 1, history[-1].shape
    centroids = history[-1]
    # far[t, j]: how far centroid j lies from where it was in round t, rounded up.
    far = np.array([np.sqrt(((centroids - old).astype(float) ** 2).sum(1)) for old in history]) * (1 + _SLACK)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, n = _matrix(batch.column(1), dim), len(batch)
            former = batch.column(2).to_numpy().astype(np.int64)
            measured = batch.column(4).to_numpy().copy()
            if now:
                bound = batch.column(5).flatten().to_numpy().reshape(n, k).copy()
                when = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.int8).reshape(n, k).copy()
                own = centroids[former]
                best = np.einsum("ij,ij->i", x - own, x - own)
                measured += 1
                cluster = former.copy()
                reach = np.sqrt(best) * (1 + _SLACK)
                open_ = bound * (1 - _SLACK) - far[when, np.arange(k)] <= reach[:, None]
                open_[np.arange(n), former] = False
                bound[np.arange(n), former] = np.nextafter(np.sqrt(best).astype(np.float32), np.float32(-1))
                when[np.arange(n), former] = now
            else:
                bound, when = np.empty((n, k), np.float32), np.zeros((n, k), np.int8)
                best, cluster = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
                open_ = np.ones((n, k), bool)
            for j in range(k):
                again = np.flatnonzero(open_[:, j])
                if not len(again):
                    continue
                distance = squared(x[again], centroids[j])
                bound[again, j] = np.nextafter(np.sqrt(distance).astype(np.float32), np.float32(-1))
                when[again, j] = now
                measured[again] += 1
                closer = (distance < best[again]) | ((distance == best[again]) & (j < cluster[again]))
                cluster[again[closer]], best[again[closer]] = j, distance[closer]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(cluster.astype(np.int32)),
                    pa.array((former if now else np.full(n, -1)).astype(np.int32)),
                    pa.array(measured),
                    pa.FixedSizeListArray.from_arrays(pa.array(bound.ravel()), k).cast(pa.list_(pa.float32())),
                    pa.array([row.tobytes() for row in when], pa.binary()),
                    pa.array(best),
                ],
                ["_id", "_vector", "cluster", "former", "measured", "_bound", "_when", "distance"],
            )

    return rows.select("_id", "_vector", "cluster", "former", "measured", "_bound", "_when").mapInArrow(
        assign,
        f"_id {id_type}, _vector array<int>, cluster int, former int, measured long, _bound array<float>, "
        "_when binary, distance long",
    )


def cluster_vectors(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dim: int = 64,
    scale: int = 256,
    seed: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> Clusters:
    """Lloyd's rounds over every vector of `dim` finite components, each turned into floor(scale * component).

    The first centroids are the `k` vectors with the smallest SHA-256 of "seed:id" (a null id: empty; of equal ids the
    smaller vector). After each of `rounds` assignments, non-empty centroids become the floor of the mean of their
    vectors, empty ones stay; one more assignment ends it. Repeated rows and ids count each. Vectors that are null, of
    another length, or with a component that is null or not finite take no part; of fewer than `k` vectors each is a
    centroid; an empty table gives no rows. Integers beyond 2^26 in size become 2^26, so that distances stay exact.
    Other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = vectors.where(all_finite(F.col(vector_col)) & (F.size(vector_col) == dim))
    whole = lambda x: F.greatest(
        F.lit(-_LARGEST), F.least(F.lit(_LARGEST), F.floor(F.lit(float(scale)) * x.cast("double")))
    ).cast("int")
    rows = spread(kept.select(F.col(id_col).alias("_id"), F.transform(vector_col, whole).alias("_vector")))
    id_type = rows.schema["_id"].dataType.simpleString()
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_id").cast("string"), F.lit(""))), 256)
    first = rows.select(key.alias("_key"), "_vector").orderBy("_key", "_vector").limit(k).collect()
    history = [np.array([r["_vector"] for r in first], np.int64).reshape(len(first), dim)]
    blank = rows
    for name, kind in (("cluster", "int"), ("former", "int"), ("measured", "long"), ("_bound", "array<float>"), ("_when", "binary")):
        blank = blank.withColumn(name, F.lit(0).cast(kind) if kind in ("int", "long") else F.lit(None).cast(kind))
    if not len(first):
        empty = blank.select(F.col("_id").alias(id_col), "cluster", F.lit(0).cast("long").alias("distance"), "measured")
        return Clusters(empty.where("false"), history[0], [])
    sums, sizes, state, path = 0, 0, blank, None
    for _ in range(rounds):
        former_path, path = path, scratch_path(spark, "assigned")
        assigned = _assign(state, history, id_type)
        assigned.write.parquet(path)
        state = spark.read.schema(assigned.schema).parquet(path)
        if former_path:
            delete(spark, former_path)
        more = _sums(state, len(first), dim)
        sums, sizes = sums + more[0], sizes + more[1]
        moved = [[s // n for s in line] if n else old.tolist() for line, n, old in zip(sums, sizes, history[-1])]
        history.append(np.array(moved, np.int64))
    done = materialise(_assign(state, history, id_type).select("_id", "cluster", "distance", "measured"), "clusters")
    if path:
        delete(spark, path)
    inertia = [0] * len(first)
    for j, total in done.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect():
        inertia[j] = int(total)
    return Clusters(done.withColumnRenamed("_id", id_col), history[-1], inertia)


@query("op13_centroids")
def op13_centroids(spark, sf_dir):
    found = cluster_vectors(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    by_cluster = spark.createDataFrame(
        [(j, inertia, digest) for j, (inertia, digest) in enumerate(zip(found.inertia, digests))],
        "cluster int, cluster_inertia long, centroid_sha256 string",
    )
    return found.rows.join(F.broadcast(by_cluster), "cluster").select(  # one row a centroid
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(found.inertia)).cast("long").alias("inertia"), "centroid_sha256"
    )
