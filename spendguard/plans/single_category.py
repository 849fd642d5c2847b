"""One category, one forest: one-hot encoded suppliers and groups, principal components, isolation forest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.detectors.iforest import fit_iforest, score_iforest
from spendguard.detectors.space import Space
from spendguard.detectors.thresholds import fit_threshold, outside_fences
from spendguard.operators.features import fill_counterparty
from spendguard.operators.quantiles import quantile_columns
from spendguard.params import Params
from spendguard.scratch import materialise

BUCKETS = 512  # every value, null among them, has one of so many codes


def supplier_features(df: DataFrame, keep: Column, supplier: str = C.FAVORECIDO) -> DataFrame:
    """Rows of the category with a non-negative amount, the mean amount of their supplier and date parts.

    A row without a supplier counts for the spender, as everywhere; without either, it shares the mean of such rows.
    """
    rows = fill_counterparty(df.where(keep & (F.col(C.VALOR) >= 0))).drop("mean_value")
    means = rows.groupBy(F.col(supplier).alias("_supplier")).agg(F.avg(C.VALOR_ADJUSTED).alias("mean_value"))
    dates = {"date_year": F.year, "month": F.month, "day": F.dayofmonth}
    return (
        rows.join(means, F.col(supplier).eqNullSafe(F.col("_supplier")), "left").drop("_supplier")
        .withColumns({n: F.coalesce(f(C.VENCIMENTO), F.lit(0)) for n, f in dates.items()})
        .withColumn("mean_value", F.coalesce("mean_value", F.lit(0.0)))
    )


def component_points(
    rows: DataFrame, numeric: Sequence[str], categorical: Sequence[str], k: int, buckets: int = BUCKETS
) -> tuple[DataFrame, Space]:
    """Principal components of standardised numbers and one-hot hash buckets."""
    common = rows.withColumns({f"_{c}": F.pmod(F.xxhash64(c, F.col(c).isNull()), F.lit(buckets)).cast("int") for c in categorical})
    stats = common.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in numeric for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    stats = materialise(stats.withColumn("_one", F.lit(1)), "single_scaler")
    common = common.withColumn("_one", F.lit(1)).join(stats, "_one")
    for c in numeric:
        scale = F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0)
        common = common.withColumn(f"x_{c}", (F.col(c).cast("double") - F.col(f"m_{c}")) / scale)
    stages = [
        OneHotEncoder(inputCols=[f"_{c}" for c in categorical], outputCols=[f"h_{c}" for c in categorical], dropLast=False),
        VectorAssembler(inputCols=[*[f"x_{c}" for c in numeric], *[f"h_{c}" for c in categorical]], outputCol="_x"),
        PCA(k=k, inputCol="_x", outputCol="_pc"),
    ]
    prepared = materialise(common.select(C.RECORD_ID, *[f"x_{c}" for c in numeric], *[f"_{c}" for c in categorical]), "encoded")
    found = Pipeline(stages=stages).fit(prepared).transform(prepared)
    space = Space(numeric=tuple(f"pc{i}" for i in range(k)), buckets=(), sizes=(), names=())
    parts = vector_to_array("_pc")
    points = found.select(
        C.RECORD_ID, F.lit("ONE").alias(C.CATEGORY_KEY), *[parts[i].alias(f"z_pc{i}") for i in range(k)]
    )
    return materialise(points, "component_points"), space


def fence_fraction(rows: DataFrame, params: Params) -> DataFrame:
    """Share of amounts outside the quartile fences, as the contamination of the single category."""
    one = rows.withColumn(C.CATEGORY_KEY, F.lit("ONE"))
    q = quantile_columns(one, [C.CATEGORY_KEY], C.VALOR_ADJUSTED, {"q1": 0.25, "q3": 0.75})
    reach = params.contamination_iqr_multiplier * (F.col("q3") - F.col("q1"))
    fences = q.withColumn("lower", F.col("q1") - reach).withColumn("upper", F.col("q3") + reach)
    return one.join(materialise(fences, "single_fences"), C.CATEGORY_KEY).groupBy(C.CATEGORY_KEY).agg(
        F.avg(outside_fences().cast("int")).alias("contamination")
    )


def single_category_forest(
    df: DataFrame, keep: Column, params: Params, categorical: Sequence[str] = (C.FAVORECIDO,), k: int = 5
) -> DataFrame:
    """Score and flag (`score`, `anomaly`) every kept row of one category."""
    rows = materialise(supplier_features(df, keep), "single_rows")
    points, space = component_points(rows, (C.VALOR_ADJUSTED, "mean_value", "date_year", "month", "day"), categorical, k)
    scores = materialise(score_iforest(points, fit_iforest(points, params, space), params, space), "single_scores")
    limit = fit_threshold(scores, fence_fraction(rows, params), [C.CATEGORY_KEY]).select(C.CATEGORY_KEY, "threshold")
    flagged = scores.join(limit, C.CATEGORY_KEY).select(
        C.RECORD_ID, "score", (F.col("score") > F.col("threshold")).cast("int").alias("anomaly")
    )
    return rows.join(flagged, C.RECORD_ID)
