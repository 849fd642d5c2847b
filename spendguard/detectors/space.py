"""The standardised feature space shared by all detectors.

A hashed feature with n buckets stands for n standardised 0/1 columns.  Only the bucket number is kept.
Two rows differ in a hashed feature by nothing (same bucket) or by the scales of the two columns that
differ, so squared distances need one weight per bucket: 1 / (p (1 - p)) with p the bucket's share in
training, and 1 for a column that is constant in training.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.params import Params
from spendguard.scratch import materialise


@dataclass(frozen=True)
class Space:
    """Numeric columns, and hashed columns with their number of buckets and short names."""

    numeric: tuple[str, ...] = C.NUMERIC_FEATURES
    buckets: tuple[str, ...] = tuple(b for b, _ in C.BUCKET_FEATURES)
    sizes: tuple[int, ...] = (64, 32)
    names: tuple[str, ...] = tuple(n for _, n in C.BUCKET_FEATURES)
    groups: tuple[str, ...] = field(default=(C.CATEGORY_KEY,))

    @classmethod
    def of(cls, params: Params) -> "Space":
        return cls(sizes=(params.hash_dim_favorecido, params.hash_dim_favorecido // 2))

    @property
    def z(self) -> list[str]:
        return [f"z_{c}" for c in self.numeric]

    @property
    def weights(self) -> list[str]:
        return [f"w_{b}" for b in self.buckets]

    @property
    def point(self) -> list[str]:
        """Columns that describe a point: scaled numbers, buckets, bucket weights."""
        return [*self.z, *self.buckets, *self.weights]

    @property
    def width(self) -> int:
        return len(self.numeric) + sum(self.sizes)

    def feature_names(self) -> list[str]:
        hashed = [f"{n}_{i}" for n, size in zip(self.names, self.sizes) for i in range(size)]
        return [*self.numeric, *hashed]


def fit_scaler(train: DataFrame, space: Space) -> DataFrame:
    """Mean and population deviation per category; a constant column has scale 1."""
    aggs = []
    for c in space.numeric:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        scale = F.when(F.min(v) == F.max(v), F.lit(1.0)).otherwise(F.stddev_pop(v))
        aggs += [F.avg(v).alias(f"mean_{c}"), scale.alias(f"scale_{c}")]
    return materialise(train.groupBy(C.CATEGORY_KEY).agg(F.count(F.lit(1)).alias("n"), *aggs), "scaler")


def fit_buckets(train: DataFrame, space: Space) -> DataFrame:
    """Share and weight of each bucket: (category_key, feature, bucket, share, weight)."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(b).alias("feature"), F.col(b).alias("bucket")) for b in space.buckets])
    )
    counts = (
        train.select(C.CATEGORY_KEY, pairs.alias("_p"))
        .groupBy(C.CATEGORY_KEY, "_p.feature", "_p.bucket")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    totals = train.groupBy(C.CATEGORY_KEY).agg(F.count(F.lit(1)).alias("_n"))
    p = F.col("_c") / F.col("_n")
    weight = F.when(F.col("_c") < F.col("_n"), 1 / (p * (1 - p))).otherwise(F.lit(1.0))
    stats = counts.join(totals, C.CATEGORY_KEY).select(
        C.CATEGORY_KEY, "feature", "bucket", p.alias("share"), weight.alias("weight")
    )
    return materialise(stats, "bucket_stats")


def apply_scaler(rows: DataFrame, scaler: DataFrame, buckets: DataFrame, space: Space) -> DataFrame:
    """Points of the rows: record, category, scaled numbers, buckets and weights.

    Both model tables are bounded by categories × buckets and are written tables, so the planner
    broadcasts them by their size on disk.
    """
    out = rows.join(scaler, C.CATEGORY_KEY)
    for c in space.numeric:
        v = F.coalesce(F.col(c).cast("double"), F.lit(0.0))
        out = out.withColumn(f"z_{c}", (v - F.col(f"mean_{c}")) / F.col(f"scale_{c}"))
    for b in space.buckets:
        side = buckets.where(F.col("feature") == b).select(
            F.col(C.CATEGORY_KEY), F.col("bucket").alias(b), F.col("weight").alias(f"w_{b}")
        )
        out = out.join(side, [C.CATEGORY_KEY, b], "left").withColumn(f"w_{b}", F.coalesce(f"w_{b}", F.lit(1.0)))
    return out.select(C.RECORD_ID, C.CATEGORY_KEY, *space.point)


def squared_distances(a: np.ndarray, b: np.ndarray, n_numeric: int, n_buckets: int) -> np.ndarray:
    """Distances² between two blocks of points laid out as `Space.point`."""
    d, step = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    columns = np.ascontiguousarray(b.T)
    for j in range(n_numeric):
        np.subtract(a[:, j, None], columns[j], out=step)
        np.multiply(step, step, out=step)
        d += step
    for j in range(n_numeric, n_numeric + n_buckets):
        w = j + n_buckets
        np.add(a[:, w, None], columns[w], out=step)
        np.multiply(step, a[:, j, None] != columns[j], out=step)
        d += step
    return d


def paired_distances(a: np.ndarray, b: np.ndarray, n_numeric: int, n_buckets: int) -> np.ndarray:
    """Distances² between row i of `a` and row i of `b`, with the same rounding as `squared_distances`."""
    d = np.zeros(len(a))
    for j in range(n_numeric):
        diff = a[:, j] - b[:, j]
        d += diff * diff
    for j in range(n_numeric, n_numeric + n_buckets):
        w = j + n_buckets
        d += np.where(a[:, j] == b[:, j], 0.0, a[:, w] + b[:, w])
    return d


def rough_distances(a: np.ndarray, b: np.ndarray, n_numeric: int, n_buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances² by matrix product, and a bound per row of `a` on their rounding error."""
    x, y = a[:, :n_numeric], b[:, :n_numeric]
    size_a, size_b = (x * x).sum(1), (y * y).sum(1)
    for j in range(n_numeric + n_buckets, n_numeric + 2 * n_buckets):
        size_a, size_b = size_a + a[:, j], size_b + b[:, j]
    d = x @ (-2.0 * y.T)
    d += size_a[:, None]
    d += size_b
    for j in range(n_numeric, n_numeric + n_buckets):
        # Points in the same bucket have the same weight, so both shares come off again.
        d -= (2.0 * a[:, j + n_buckets])[:, None] * (a[:, j, None].astype(np.int32) == b[:, j].astype(np.int32))
    return d, 1e-12 * (size_a + size_b.max()) + 1e-300


def dense_points(points: np.ndarray, shares: dict, space: Space) -> np.ndarray:
    """Standardised matrix with the hashed columns spelled out (bounded blocks only).

    `shares[j]` holds the bucket shares of hashed feature j, zero for buckets unseen in training.
    """
    m = len(space.numeric)
    parts = [points[:, :m]]
    for j, size in enumerate(space.sizes):
        p = shares[j]
        var = p * (1 - p)
        scale = np.where(var > 0, np.sqrt(np.where(var > 0, var, 1.0)), 1.0)
        hot = np.zeros((len(points), size))
        hot[np.arange(len(points)), points[:, m + j].astype(int)] = 1.0
        parts.append((hot - p) / scale)
    return np.hstack(parts)


def shares_by_category(buckets: DataFrame, space: Space) -> DataFrame:
    """One row per category with the bucket shares of every hashed feature as dense arrays."""
    if not space.buckets:
        return buckets.select(C.CATEGORY_KEY).distinct()
    spread = [
        F.map_from_entries(
            F.collect_list(F.when(F.col("feature") == b, F.struct("bucket", "share")))
        ).alias(f"m_{b}")
        for b in space.buckets
    ]

    def dense_shares(b: str, size: int):
        share = lambda i: F.coalesce(F.try_element_at(F.col(f"m_{b}"), i), F.lit(0.0))
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), share).alias(f"share_{b}")

    dense = [dense_shares(b, size) for b, size in zip(space.buckets, space.sizes)]
    return buckets.groupBy(C.CATEGORY_KEY).agg(*spread).select(C.CATEGORY_KEY, *dense)
