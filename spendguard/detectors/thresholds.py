"""Contamination, score thresholds, score scaling and the vote."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.operators.quantiles import exact_quantiles, quantile_columns
from spendguard.params import Params
from spendguard.scratch import materialise


def iqr_fences(train: DataFrame, params: Params, value: str = C.VALOR_ADJUSTED) -> DataFrame:
    """Quartiles and outlier fences per category."""
    q = quantile_columns(train, [C.CATEGORY_KEY], value, {"q1": 0.25, "q3": 0.75})
    m = params.contamination_iqr_multiplier
    spread = F.col("q3") - F.col("q1")
    return q.withColumn("lower", F.col("q1") - m * spread).withColumn("upper", F.col("q3") + m * spread)


def outside_fences(value: str = C.VALOR_ADJUSTED):
    return (F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper"))


def iqr_contamination(train: DataFrame, params: Params, value: str = C.VALOR_ADJUSTED) -> DataFrame:
    """Share of amounts outside the fences per category, clipped to the configured range."""
    fences = materialise(iqr_fences(train, params, value), "fences")
    low, high = F.lit(params.contamination_min), F.lit(params.contamination_max)
    outlier = outside_fences(value).cast("int")
    return (
        train.where(F.col(value).isNotNull())
        .join(fences, C.CATEGORY_KEY)
        .groupBy(C.CATEGORY_KEY, "q1", "q3", "lower", "upper")
        .agg(F.count(F.lit(1)).alias("n_train"), F.sum(outlier).alias("n_outliers"))
        .withColumn("outlier_share", F.col("n_outliers") / F.col("n_train"))
        .withColumn("contamination", F.greatest(low, F.least(high, F.col("outlier_share"))))
    )


def fit_threshold(
    scores: DataFrame, contamination: DataFrame, keys: Sequence[str] = (C.CATEGORY_KEY, "model")
) -> DataFrame:
    """Score above which a record is flagged: the (1 − contamination) quantile of the training scores.

    `scores` has the keys and `score`; the score range is kept for scaling with frozen bounds.
    """
    keys = list(keys)
    rest = [k for k in keys if k != C.CATEGORY_KEY]
    p = contamination.select(C.CATEGORY_KEY, (1 - F.col("contamination")).alias("p"))
    groups = scores.groupBy(*keys).agg(F.min("score").alias("score_min"), F.max("score").alias("score_max"))
    groups = materialise(groups.join(p, C.CATEGORY_KEY), "threshold_groups")
    found = exact_quantiles(scores, keys, "score", per_group=groups.select(C.CATEGORY_KEY, *rest, "p"))
    return found.select(*keys, F.col("quantile").alias("threshold")).join(groups.drop("p"), keys)


def widen(scores: DataFrame, models: Sequence[str]) -> DataFrame:
    """Long scores (category_key, record_id, model, score) → one row per record, `raw_<model>` columns."""
    picks = [F.max(F.when(F.col("model") == m, F.col("score"))).alias(f"raw_{m}") for m in models]
    return scores.groupBy(C.CATEGORY_KEY, C.RECORD_ID).agg(*picks)


def flag_scores(wide: DataFrame, thresholds: DataFrame, models: Sequence[str]) -> DataFrame:
    """`anomaly_<model>`: score above the threshold; a record without a score is not flagged."""
    limits = thresholds.groupBy(C.CATEGORY_KEY).agg(
        *[F.max(F.when(F.col("model") == m, F.col("threshold"))).alias(f"_t_{m}") for m in models]
    )
    flags = {f"anomaly_{m}": F.coalesce((F.col(f"raw_{m}") > F.col(f"_t_{m}")).cast("int"), F.lit(0)) for m in models}
    return wide.join(limits, C.CATEGORY_KEY, "left").withColumns(flags).drop(*[f"_t_{m}" for m in models])


def minmax_scores(wide: DataFrame, models: Sequence[str], frozen: DataFrame | None = None) -> DataFrame:
    """`score_<model>`: raw score scaled to [0, 1] per category, 0 where all scores are equal.

    The range is that of the given rows, or of the training scores when `frozen` thresholds are given
    (then scores outside the training range are clipped).  Ranges are aggregated and joined back: no
    window over a whole category.
    """
    if frozen is None:
        ranges = wide.groupBy(C.CATEGORY_KEY).agg(
            *[f(f"raw_{m}").alias(f"_{n}_{m}") for m in models for n, f in (("lo", F.min), ("hi", F.max))]
        )
        ranges = materialise(ranges, "score_ranges")
    else:
        ranges = frozen.groupBy(C.CATEGORY_KEY).agg(
            *[
                F.max(F.when(F.col("model") == m, F.col(c))).alias(f"_{n}_{m}")
                for m in models
                for n, c in (("lo", "score_min"), ("hi", "score_max"))
            ]
        )
    out = wide.join(ranges, C.CATEGORY_KEY, "left")
    scaled = {}
    for m in models:
        lo, hi = F.col(f"_lo_{m}"), F.col(f"_hi_{m}")
        s = F.when(hi > lo, (F.col(f"raw_{m}") - lo) / (hi - lo)).otherwise(F.lit(0.0))
        if frozen is not None:
            s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), s))
        scaled[f"score_{m}"] = F.coalesce(s, F.lit(0.0))
    return out.withColumns(scaled).drop(*[f"_{n}_{m}" for m in models for n in ("lo", "hi")])


def ensemble(df: DataFrame, models: Sequence[str], strategy: str = "consensus") -> DataFrame:
    """`ensemble_flag` by vote and `ensemble_score` as the mean of the scaled scores."""
    votes = sum((F.col(f"anomaly_{m}") for m in models), F.lit(0))
    need = {"consensus": len(models), "majority": len(models) // 2 + 1, "any": 1}[strategy]
    mean = sum((F.col(f"score_{m}") for m in models), F.lit(0.0)) / len(models)
    return df.withColumn("ensemble_flag", (votes >= need).cast("int")).withColumn("ensemble_score", mean)
