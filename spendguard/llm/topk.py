"""Exact maximum inner products with norm buckets (Teflioudi and Gemulla 2016).

Vectors are sorted by length into buckets of bounded size. For a query, a bucket can only hold a result if the
cosine it would need, threshold / (length of the query x longest in the bucket), is at most 1. Where the needed
cosine is high, vectors are pruned by single coordinates; where it is low, by their length alone. What is left
is verified by inner products. Queries, too, are dealt out in blocks; a task holds one block of each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendguard.llm.registry import query, table
from spendguard.llm.vectors import all_finite, matrices
from spendguard.scratch import materialise

BUCKET = 4096
QUERIES = 512
COORDINATE_COSINE = 0.3


def quantised(rows: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id (long) and v = floor(scale * x) of every vector without null or non-finite components."""
    vector = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return rows.where(all_finite(F.col(vector_col)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), vector.alias("v")
    )


def _blocks(rows: DataFrame, size: int, order: str) -> DataFrame:
    """Blocks of at most `size` vectors of one dimension, the largest `order` (a column; ties by id) first.

    block, dim, longest (vector), least (value of `order`), ids, data, and floors where the rows have a floor.
    """
    floored = "floor" in rows.columns

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        data = pa.Table.from_batches(got).combine_chunks()
        ids, value = data.column("id").to_numpy(), data.column(order).to_numpy()
        floor = data.column("floor").to_numpy() if floored else None
        made = []
        for places, matrix in matrices(data.column("v").combine_chunks()):
            length = np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1))
            ranked = np.lexsort((ids[places], -value[places]))
            for at in range(0, len(ranked), size):
                part = ranked[at : at + size]
                here = places[part]
                made.append((
                    matrix.shape[1], float(length[part].max()), float(value[here].min()), ids[here].tobytes(),
                    matrix[part].astype(np.int64).tobytes(), floor[here].tobytes() if floored else None,
                ))
        base = TaskContext.get().partitionId() << 32
        kinds = (pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(base, base + len(made)), pa.int64())] + [pa.array([m[i] for m in made], t) for i, t in enumerate(kinds)],
            ["block", "dim", "longest", "least", "ids", "data", "floors"],
        )

    tasks = math.ceil(rows.count() / size) or 1  # one task a block
    schema = "block long, dim int, longest double, least double, ids binary, data binary, floors binary"
    return materialise(rows.repartitionByRange(tasks, F.col(order).desc(), "id").mapInArrow(build, schema), "blocks")


def _open(ids: bytes, data: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(data, np.int64).reshape(-1, dim)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; by floating point where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _best(ids: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    keep = np.flatnonzero(ids != own)
    if len(keep) > 4 * k:
        cut = np.partition(scores[keep], len(keep) - k)[len(keep) - k]
        keep = keep[scores[keep] >= cut]
    return keep[np.lexsort((ids[keep], -scores[keep]))[:k]]


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """The best `k` of every block for every query that the block can serve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                q_ids, q = _open(row["q_ids"], row["q_data"], dim)
                ids, v = _open(row["ids"], row["data"], dim)
                floor = np.frombuffer(row["floors"], np.float64) if row["floors"] else np.full(len(q), -np.inf)
                out = [[], [], []]
                length = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
                unit = v / np.maximum(length, 1e-300)[:, None]
                for i, own in enumerate(q_ids):
                    size = math.sqrt(float((q[i].astype(np.float64) ** 2).sum()))
                    needed = floor[i] / max(size * row["longest"], 1e-300)
                    if floor[i] > 0 and needed > 1 + 1e-9:
                        continue
                    left = np.arange(len(v))
                    if floor[i] > 0 and needed >= COORDINATE_COSINE:
                        for f in np.argsort(-np.abs(q[i]))[:3]:
                            x = q[i][f] / size
                            spread = math.sqrt(max(1 - x * x, 0) * max(1 - needed * needed, 0)) + 1e-9
                            at = unit[left, f]
                            left = left[(at >= x * needed - spread) & ((at <= x * needed + spread) | (x >= needed))] if x >= 0 else left[
                                (at <= x * needed + spread) & ((at >= x * needed - spread) | (-x >= needed))
                            ]
                    elif floor[i] > 0:
                        left = left[: np.searchsorted(-length, -floor[i] / max(size, 1e-300) * (1 - 1e-9), "right")]
                    if not len(left):
                        continue
                    scores = _products(q[i : i + 1], v[left])[0]
                    fit = scores >= floor[i]
                    left, scores = left[fit], scores[fit]
                    best = _best(ids[left], scores, own, k)
                    out[0] += [own] * len(best)
                    out[1].append(ids[left[best]])
                    out[2].append(scores[best])
                join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(join(out[1])), pa.array(join(out[2]))], ["query_id", "vec_id", "score"]
                )

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def _asked(queries: DataFrame, order: str) -> DataFrame:
    """Blocks of queries under names of their own."""
    return _blocks(queries, QUERIES, order).select(
        F.col("block").alias("q_block"), F.col("dim").alias("q_dim"), F.col("least").alias("reach"),
        F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "floors",
    )


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 10, seed_blocks: int = 2) -> DataFrame:
    """query_id, rank (from 1), vec_id and score: the `k` largest inner products of every query (id, v) with the
    rows of `vectors` (id, v), without rows of the query's own id; ties go to the smaller id; all if fewer.

    Both tables come from `quantised`, which leaves out vectors with null or non-finite parts. Queries with one
    id count once. Vectors meet only those of their own dimension. Equal vectors are all candidates, rows that
    share an id too.

    The buckets with the longest vectors give every query a floor. Floor / length of the query is the length a
    vector needs; queries are dealt out again in that order, so that the queries of a block need about the same, and
    a block of queries only meets buckets that reach what its least demanding query needs.
    """
    spark = vectors.sparkSession
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    buckets = _blocks(vectors.withColumn("length", length), BUCKET, "length")
    once = materialise(queries.dropDuplicates(["id"]).withColumn("length", length), "queries")
    slim = buckets.select("block", "dim", "longest")
    rank = Window.partitionBy("dim").orderBy(F.col("longest").desc(), "block")  # of blocks, not of vectors
    ranked = materialise(slim.withColumn("_rank", F.row_number().over(rank)), "bucket_ranks")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def search(asked: DataFrame, fit) -> DataFrame:
        """Block pairs are settled first; only those left fetch their vectors."""
        near = asked.select("q_block", "q_dim", "reach").join(ranked, (F.col("q_dim") == F.col("dim")) & fit)
        pairs = materialise(near.select("q_block", "block"), "block_pairs")
        whole = pairs.join(buckets.drop("floors", "least"), "block").join(asked.drop("q_dim", "reach"), "q_block")
        return _search(whole.repartition(tasks, "q_block", "block"), k)

    first = F.col("_rank") <= seed_blocks
    seeds = materialise(search(_asked(once, "length"), first), "seeds")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    kth = seeds.withColumn("_r", F.row_number().over(order)).where(F.col("_r") == k)
    floors = kth.select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    floor = F.coalesce("floor", F.lit(float("-inf")))  # fewer than k rows are known
    needed = F.when(F.col("floor") > 0, F.col("floor") / F.col("length")).otherwise(F.lit(0.0))
    known = once.join(floors, "id", "left").withColumns({"needed": needed, "floor": floor})
    found = seeds.unionByName(search(_asked(known, "needed"), ~first & (F.col("longest") >= F.col("reach") * (1 - 1e-9))))
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


@query("op5_topk")
def op5_topk(spark, sf_dir):
    vectors = materialise(quantised(table(spark, sf_dir, "embeddings")), "quantised")
    return top_products(vectors, vectors.where("id % 100 = 0"))
