"""Distribution tables behind the charts: histogram, box statistics, density curve."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.detectors.grouped import map_with_model
from spendguard.operators.quantiles import quantile_columns
from spendguard.scratch import materialise


def histogram(df: DataFrame, value: str, group: str, bins: int = 80, keys: Sequence[str] = (C.CATEGORY_KEY,)) -> DataFrame:
    """Density histogram with equal bins over the range of all groups of a key.

    Returns keys, group, bin (1..bins), bin_start, bin_end, count, density; bins without rows have count 0.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    ranges = materialise(
        rows.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")), "histogram_ranges"
    )
    totals = rows.groupBy(*keys, group).agg(F.count(F.lit(1)).alias("_n"))
    width = F.when(F.col("_hi") > F.col("_lo"), (F.col("_hi") - F.col("_lo")) / bins).otherwise(F.lit(1.0))
    number = F.least(F.floor((F.col(value) - F.col("_lo")) / F.col("_w")).cast("int") + 1, F.lit(bins))
    counts = (
        rows.join(ranges.withColumn("_w", width), keys)
        .groupBy(*keys, group, number.alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"))
    )
    frame = totals.join(ranges.withColumn("_w", width), keys).withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins))))
    return frame.join(counts, [*keys, group, "bin"], "left").withColumn("count", F.coalesce("count", F.lit(0))).select(
        *keys,
        group,
        "bin",
        (F.col("_lo") + (F.col("bin") - 1) * F.col("_w")).alias("bin_start"),
        (F.col("_lo") + F.col("bin") * F.col("_w")).alias("bin_end"),
        "count",
        (F.col("count") / (F.col("_n") * F.col("_w"))).alias("density"),
    )


def box_stats(df: DataFrame, value: str, keys: Sequence[str], whisker: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (last value within `whisker` × IQR of the box) and the number beyond them."""
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    q = materialise(quantile_columns(rows, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}), "box")
    reach = whisker * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    inside = F.col(value).between(low, high)
    return (
        rows.join(q, keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count(F.lit(1)).alias("n"),
            F.sum((~inside).cast("bigint")).alias("n_outliers"),
        )
    )


def kde_grid(
    df: DataFrame, value: str, group: str, points: int = 200, cut: float = 3.0, keys: Sequence[str] = (C.CATEGORY_KEY,)
) -> DataFrame:
    """Gaussian density curve per key and group on an even grid, bandwidth by Scott's rule.

    Equal amounts are collapsed first.  Each task adds up its own values on the whole grid, so only
    `points` partial sums per group and task are shuffled.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, group, F.col(value).cast("double").alias("_v"))
    stats = (
        rows.groupBy(*keys, group)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.stddev_samp("_v").alias("_s"),
            F.min("_v").alias("_lo"),
            F.max("_v").alias("_hi"),
        )
        .where((F.col("_n") > 1) & (F.col("_s") > 0))
        .withColumn("_h", F.col("_s") * F.pow(F.col("_n").cast("double"), F.lit(-0.2)))
    )
    stats = materialise(stats, "kde_stats")
    curve = F.concat_ws("\u0001", *keys, group)
    weighted = (
        rows.groupBy(*keys, group, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .select(curve.alias(C.CATEGORY_KEY), F.xxhash64("_v").alias(C.RECORD_ID), "_v", "_c")
    )
    model = stats.select(curve.alias(C.CATEGORY_KEY), "_n", "_h", "_lo", "_hi")

    def partial(part: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        n, h, lo, hi = (float(known[c].iloc[0]) for c in ("_n", "_h", "_lo", "_hi"))
        at = np.linspace(lo - cut * h, hi + cut * h, points)
        v, c = part["_v"].to_numpy(), part["_c"].to_numpy(float)
        total = np.zeros(points)
        for s in range(0, len(v), 4096):
            u = (at[:, None] - v[None, s : s + 4096]) / h
            total += np.exp(-0.5 * u * u) @ c[s : s + 4096]
        return pd.DataFrame(
            {"curve": part[C.CATEGORY_KEY].iloc[0], "i": np.arange(points), "x": at, "part": total / (n * h * np.sqrt(2 * np.pi))}
        )

    def add(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return a.assign(part=a["part"].to_numpy() + b["part"].to_numpy())

    schema = "curve string, i int, x double, part double"
    sums = map_with_model(weighted, model, partial, schema, 40, combine=add)
    names = F.split("curve", "\u0001")
    return sums.groupBy("curve", "i", "x").agg(F.sum("part").alias("density")).select(
        *[names[j].alias(k) for j, k in enumerate([*keys, group])], F.col("i").alias("grid_index"), "x", "density"
    )
