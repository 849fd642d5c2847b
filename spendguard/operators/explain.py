"""Attribution of flagged records: path-dependent tree Shapley values on the isolation forest.

The explained quantity is the mean path length of a record (Lundberg et al. 2020): a negative value
means that the feature shortens the path, that is, makes the record easier to isolate.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.detectors.grouped import map_with_model
from spendguard.detectors.iforest import average_path, tree_bytes
from spendguard.detectors.space import Space, dense_points, shares_by_category
from spendguard.operators.sampling import sample_per_category
from spendguard.params import Params
from spendguard.scratch import materialise, tasks

SHAP_SCHEMA = (
    f"{C.CATEGORY_KEY} string, {C.RECORD_ID} bigint, feature_name string, shap_value double, "
    "feature_value double, base_value double"
)


def _paths(tree: dict, offsets: np.ndarray, n_numeric: int) -> list[dict]:
    """Every leaf with its value and, per feature on its path, the coverage share and the steps taken.

    A hashed feature is one feature per bucket, as in the expanded matrix.
    """
    feature, cut, child, size, depth = (np.asarray(tree[c]) for c in ("feature", "cut", "child", "size", "depth"))
    leaves, open_nodes = [], [(0, {})]
    while open_nodes:
        node, path = open_nodes.pop()
        if feature[node] < 0:
            leaves.append({"value": float(depth[node] + average_path(size[node])), "share": size[node] / size[0], "path": path})
            continue
        f = feature[node]
        name = int(f) if f < n_numeric else int(offsets[f - n_numeric] + cut[node])
        for first, to in ((True, child[node]), (False, child[node] + 1)):
            share, steps = path.get(name, (1.0, ()))
            grown = {**path, name: (share * size[to] / size[node], (*steps, (node, first)))}
            open_nodes.append((int(to), grown))
    return leaves


def _leaf_values(follows: np.ndarray, cover: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Shapley values (features × rows × leaves) of leaves with equally many features.

    `follows` (features × rows × leaves) is 1 where a row keeps to the path of the leaf, `cover` the share of the
    sample that does. The weight of a subset of s of the d - 1 other features is the integral of t^s (1 - t)^(d-1-s)
    from 0 to 1, so the sum over all subsets is the integral of a product of d - 1 linear factors, which
    Gauss-Legendre quadrature with half as many nodes gives exactly.
    """
    d = len(follows)
    nodes, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    inner = np.zeros_like(follows)
    for t, w in zip((nodes + 1) / 2, weights / 2):
        factors = t * follows + (1 - t) * cover.T[:, None, :]  # covers are positive and t is below 1
        inner += w * np.prod(factors, 0) / factors
    return inner * (follows - cover.T[:, None, :]) * value


class TreeShap:
    """Shapley values of one tree's path length.

    What a leaf adds depends only on which features of its path a row satisfies, and a path is short. Where there are
    more rows than such patterns, the values of all patterns are computed once and rows look them up.
    """

    def __init__(self, tree: dict, offsets: np.ndarray, n_numeric: int, width: int, n_rows: int):
        self.leaves = _paths(tree, offsets, n_numeric)
        self.base = sum(leaf["value"] * leaf["share"] for leaf in self.leaves)  # mean over the tree's sample
        self.feature, self.cut = np.asarray(tree["feature"]), np.asarray(tree["cut"])
        self.n_numeric, self.width = n_numeric, width
        self.groups = []
        for d in sorted({len(leaf["path"]) for leaf in self.leaves} - {0}):
            group = [leaf for leaf in self.leaves if len(leaf["path"]) == d]
            value = np.array([leaf["value"] for leaf in group])
            names = np.array([list(leaf["path"]) for leaf in group])
            cover = np.array([[share for share, _ in leaf["path"].values()] for leaf in group])
            patterns = None
            if n_rows > 1 << d:
                bits = (np.arange(1 << d) >> np.arange(d)[:, None] & 1).astype(float)
                patterns = _leaf_values(np.repeat(bits[:, :, None], len(group), 2), cover, value)
            self.groups.append((d, group, value, names, cover, patterns))

    def __call__(self, data: np.ndarray) -> np.ndarray:
        """Rows × features."""
        x = data[:, np.maximum(self.feature, 0)]
        holds = np.where(self.feature < self.n_numeric, x <= self.cut, x != self.cut)
        by_step = {True: holds, False: ~holds}
        phi = np.zeros((len(data), self.width))
        for d, group, value, names, cover, patterns in self.groups:
            follows = np.ones((d, len(data), len(group)), bool)
            for g, leaf in enumerate(group):
                for j, (_, steps) in enumerate(leaf["path"].values()):
                    for node, first in steps:
                        follows[j, :, g] &= by_step[first][:, node]
            if patterns is None:
                parts = _leaf_values(follows.astype(float), cover, value)
            else:
                code = np.tensordot(1 << np.arange(d), follows, 1)
                parts = patterns[:, code, np.arange(len(group))]
            to = np.zeros((d, len(group), self.width))
            to[np.arange(d)[:, None], np.arange(len(group)), names.T] = 1.0
            phi += np.tensordot(parts, to, ([0, 2], [0, 1]))
        return phi


def tree_shap(data: np.ndarray, tree: dict, offsets: np.ndarray, n_numeric: int, width: int) -> tuple[np.ndarray, float]:
    """Shapley values (rows × features) of one tree's path length, and its mean over the tree's sample."""
    explainer = TreeShap(tree, offsets, n_numeric, width, len(data))
    return explainer(data), explainer.base


_ROWS_A_PART = 300
_STRIP = 500


def explain(
    flagged: DataFrame, points: DataFrame, trees: DataFrame, buckets: DataFrame, params: Params, space: Space
) -> DataFrame:
    """Attributions of flagged records, one row per record and feature.

    Every flagged record is explained, unless `shap_max_records` asks for a fixed-seed sample per category.
    """
    wanted = flagged.select(C.CATEGORY_KEY, C.RECORD_ID)
    if params.shap_max_records is not None:
        wanted = sample_per_category(wanted, params.shap_max_records, seed=params.random_seed)
    # Reading a forest costs as much as explaining some hundred records, so a category goes to few tasks.
    parts = wanted.groupBy(C.CATEGORY_KEY).agg(F.ceil(F.count(F.lit(1)) / _ROWS_A_PART).alias("_parts"))
    part = F.pmod(F.xxhash64(C.RECORD_ID), F.col("_parts"))
    rows = points.join(wanted, [C.CATEGORY_KEY, C.RECORD_ID], "left_semi").join(materialise(parts, "explained"), C.CATEGORY_KEY)
    rows = rows.repartition(tasks(points.sparkSession), C.CATEGORY_KEY, part).drop("_parts")
    shares = shares_by_category(buckets, space)
    model = materialise(trees.join(shares, C.CATEGORY_KEY), "explainer")
    layout, width, m = space.point, space.width, len(space.numeric)
    data_cols = [*space.z, *space.buckets]
    offsets = m + np.cumsum([0, *space.sizes[:-1]])
    names = np.array(space.feature_names(), dtype=object)
    share_cols = [f"share_{b}" for b in space.buckets]

    def attribute(part: pd.DataFrame, forest: pd.DataFrame) -> pd.DataFrame:
        data = part[data_cols].to_numpy(float)
        phi, means = np.zeros((len(data), width)), []
        for tree in forest.to_dict("records"):
            explainer = TreeShap(tree, offsets, m, width, len(data))
            for s in range(0, len(data), _STRIP):
                phi[s : s + _STRIP] += explainer(data[s : s + _STRIP]) / len(forest)
            means.append(explainer.base)
        base = float(np.mean(means))
        shown = dense_points(
            part[layout].to_numpy(float), [np.asarray(forest[c].iloc[0], float) for c in share_cols], space
        )
        n = len(part)
        return pd.DataFrame(
            {
                C.CATEGORY_KEY: part[C.CATEGORY_KEY].iloc[0],
                C.RECORD_ID: np.repeat(part[C.RECORD_ID].to_numpy(), width),
                "feature_name": np.tile(names, n),
                "shap_value": phi.ravel(),
                "feature_value": shown.ravel(),
                "base_value": base,
            }
        )

    bytes_each = tree_bytes(params) + 8 * sum(space.sizes)
    return map_with_model(rows, model, attribute, SHAP_SCHEMA, bytes_each, laid_out=True)


def top_features(attributions: DataFrame, n_top: int = 5) -> DataFrame:
    """The features with the largest absolute attribution of each record."""
    order = Window.partitionBy(C.CATEGORY_KEY, C.RECORD_ID).orderBy(F.abs("shap_value").desc(), "feature_name")
    return (
        attributions.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n_top)
        .select(C.CATEGORY_KEY, C.RECORD_ID, "rank", "feature_name", "shap_value", "feature_value")
    )


def feature_importance(attributions: DataFrame, n_top: int = 20) -> DataFrame:
    """Mean absolute attribution per category and feature, the largest ones."""
    order = Window.partitionBy(C.CATEGORY_KEY).orderBy(F.col("mean_abs_shap").desc(), "feature_name")
    return (
        attributions.groupBy(C.CATEGORY_KEY, "feature_name")
        .agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"), F.count(F.lit(1)).alias("n_records"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= n_top)
    )


def summary_points(attributions: DataFrame, n_top: int = 20) -> DataFrame:
    """Attribution and feature value of every explained record for the most important features."""
    chosen = feature_importance(attributions, n_top).select(C.CATEGORY_KEY, "feature_name", "rank")
    return attributions.join(chosen, [C.CATEGORY_KEY, "feature_name"]).select(
        C.CATEGORY_KEY, C.RECORD_ID, "rank", "feature_name", "shap_value", "feature_value"
    )


def waterfall_table(attributions: DataFrame, flagged: DataFrame, top_n: int = 20, max_display: int = 15) -> DataFrame:
    """Steps from the base value to the record's path length for the top records of each category.

    The smallest contributions are joined into one row, so a record has at most `max_display` rows.
    """
    key = [C.CATEGORY_KEY, C.RECORD_ID]
    by_score = Window.partitionBy(C.CATEGORY_KEY).orderBy(F.col("ensemble_score").desc(), C.RECORD_ID)
    explained = attributions.select(*key).distinct()
    records = (
        flagged.join(explained, key, "left_semi")
        .select(*key, "ensemble_score")
        .withColumn("record_rank", F.row_number().over(by_score))
        .where(F.col("record_rank") <= top_n)
    )
    by_size = Window.partitionBy(*key).orderBy(F.abs("shap_value").desc(), "feature_name")
    ranked = attributions.join(records, key).withColumn("_i", F.row_number().over(by_size))
    steps = (
        ranked.withColumn("step", F.least("_i", F.lit(max_display)))
        .groupBy(*key, "record_rank", "base_value", "step")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.sum("shap_value").alias("shap_value"),
            F.min("feature_name").alias("_name"),
            F.max("feature_value").alias("_value"),
        )
    )
    running = Window.partitionBy(*key).orderBy(F.col("step").desc())
    after = F.col("base_value") + F.sum("shap_value").over(running)
    alone = F.col("_n") == 1
    return steps.select(
        *key,
        "record_rank",
        "step",
        F.when(alone, F.col("_name")).otherwise(F.concat(F.col("_n").cast("string"), F.lit(" other features"))).alias("feature_name"),
        F.when(alone, F.col("_value")).alias("feature_value"),
        "shap_value",
        (after - F.col("shap_value")).alias("from_value"),
        after.alias("to_value"),
    )
