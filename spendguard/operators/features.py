"""Price adjustment, splits and model features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.functions.hashing import hash_bucket, one_hot
from spendguard.functions.text import category_key
from spendguard.operators.clean import with_counters
from spendguard.params import Params
from spendguard.scratch import materialise

# Labels of the splits in reports.
SPLIT_LABELS = {
    "train": "Treinamento",
    "test": "Avaliação",
    "infer": "Inferência",
    "excluded": "Excluído (COVID)",
    "other": "Outro",
}


def adjust_amount(df: DataFrame, index: DataFrame) -> DataFrame:
    """Multiply the amount by the price factor of its year; years without a factor keep the amount.

    The index has one row per calendar year, so its broadcast does not grow with the data.
    """
    factors = index.select(F.col("year").cast("int").alias("_y"), F.col("ipca_correction_factor").alias("_f"))
    return (
        df.join(F.broadcast(factors), F.col(C.YEAR) == F.col("_y"), "left")
        .withColumn("ipca_factor", F.coalesce("_f", F.lit(1.0)))
        .withColumn(C.VALOR_ADJUSTED, F.col(C.VALOR) * F.col("ipca_factor"))
        .drop("_y", "_f")
    )


def assign_split(df: DataFrame, params: Params) -> DataFrame:
    """`split`: train, test, infer, excluded or other, by year."""
    year = F.col(C.YEAR)
    label = (
        F.when(year.isin(*params.train_years), "train")
        .when(year.isin(*params.test_years), "test")
        .when(year.isin(*params.inference_years), "infer")
        .when(year.isin(*params.excluded_years), "excluded")
        .otherwise("other")
    )
    return df.withColumn(C.SPLIT, label)


def split_label(df: DataFrame) -> DataFrame:
    """`split_label`: the report wording of the split."""
    pairs = [F.lit(x) for pair in SPLIT_LABELS.items() for x in pair]
    return df.withColumn("split_label", F.create_map(*pairs)[F.col(C.SPLIT)])


def modelled_rows(df: DataFrame) -> DataFrame:
    """Rows that enter the models: a known split and not a reversal."""
    return df.where(F.col(C.SPLIT).isin("train", "test", "infer") & ~F.col(C.IS_REVERSAL))


def reversal_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(C.SPLIT).isin("train", "test", "infer") & F.col(C.IS_REVERSAL))


def excluded_years(df: DataFrame, params: Params) -> DataFrame:
    """Years in the data that belong to no split."""
    used = (*params.train_years, *params.test_years, *params.inference_years)
    return df.where(~F.col(C.YEAR).isin(*used)).select(C.YEAR).distinct()


def split_counters(df: DataFrame, name: str = "splits") -> tuple[DataFrame, Observation]:
    """Split sizes and the amount range before and after adjustment."""
    part = {s: F.sum(((F.col(C.SPLIT) == s) & ~F.col(C.IS_REVERSAL)).cast("int")) for s in ("train", "test", "infer")}
    return with_counters(
        df,
        name,
        **part,
        reversals=F.sum(F.col(C.IS_REVERSAL).cast("int")),
        valor_min=F.min(C.VALOR),
        valor_max=F.max(C.VALOR),
        adjusted_min=F.min(C.VALOR_ADJUSTED),
        adjusted_max=F.max(C.VALOR_ADJUSTED),
    )


def fill_counterparty(df: DataFrame) -> DataFrame:
    """A missing payee is the spender."""
    payee = F.when(F.col(C.FAVORECIDO) != "nan", F.col(C.FAVORECIDO))
    return df.withColumn(C.FAVORECIDO, F.coalesce(payee, F.col(C.CONTA)))


def date_features(df: DataFrame) -> DataFrame:
    """Month, quarter and weekday (Monday is 0) of the due date, 0 when it is missing."""
    due = F.col(C.VENCIMENTO)
    return df.withColumns(
        {
            "month": F.coalesce(F.month(due), F.lit(0)),
            "quarter": F.coalesce(F.quarter(due), F.lit(0)),
            "day_of_week": F.coalesce(F.weekday(due), F.lit(0)),
        }
    )


def fit_group_means(train: DataFrame, params: Params) -> DataFrame:
    """Mean adjusted amount per group, from training rows only."""
    group = params.mean_value_group
    known = train
    for c in group:
        known = known.where(F.col(c).isNotNull())
    means = known.groupBy(*group).agg(F.avg(C.VALOR_ADJUSTED).alias("mean_value"))
    return materialise(means, "group_means")


def group_mean_feature(df: DataFrame, means: DataFrame, params: Params) -> DataFrame:
    """`mean_value` of the row's group; groups unseen in training get the mean of the group means.

    The number of groups grows with the number of spenders, so the join is left to the planner.
    """
    overall = means.agg(F.avg("mean_value")).scalar()
    group = list(params.mean_value_group)
    return df.join(means, group, "left").withColumn("mean_value", F.coalesce("mean_value", overall))


def group_mean_over_rows(df: DataFrame, params: Params) -> DataFrame:
    """`mean_value` of each row's own group over the given rows (no separate training table)."""
    means = df.groupBy(*params.mean_value_group).agg(F.avg(C.VALOR_ADJUSTED).alias("mean_value"))
    return df.join(means, list(params.mean_value_group), "left")


def with_buckets(df: DataFrame, params: Params) -> DataFrame:
    """Hash buckets of payee and spender; the one-hot columns they stand for are never expanded."""
    dim = params.hash_dim_favorecido
    return df.withColumns(
        {
            "fav_bucket": hash_bucket(F.col(C.FAVORECIDO), dim, params.hash_mode),
            "cta_bucket": hash_bucket(F.col(C.CONTA), dim // 2, params.hash_mode),
        }
    )


def expand_buckets(df: DataFrame, params: Params) -> DataFrame:
    """The 0/1 columns `fav_0..` and `cta_0..` for consumers that need them spelled out."""
    dim = params.hash_dim_favorecido
    out = df.withColumns({"_fav": one_hot(F.col("fav_bucket"), dim), "_cta": one_hot(F.col("cta_bucket"), dim // 2)})
    fav = [F.col("_fav")[i].alias(f"fav_{i}") for i in range(dim)]
    cta = [F.col("_cta")[i].alias(f"cta_{i}") for i in range(dim // 2)]
    return out.select(*df.columns, *fav, *cta)


FEATURE_COLUMNS = (
    C.RECORD_ID, C.CATEGORY_KEY, C.SPLIT, C.VERBA, C.CONTA, C.FAVORECIDO, C.IS_REVERSAL,
    *C.NUMERIC_FEATURES, *(b for b, _ in C.BUCKET_FEATURES),
)


def prepare_rows(df: DataFrame, params: Params) -> DataFrame:
    """Row-wise features: payee fallback, date parts, buckets, category key."""
    keyed = with_buckets(date_features(fill_counterparty(df)), params)
    return keyed.where(F.col(C.VERBA).isNotNull()).withColumn(C.CATEGORY_KEY, category_key(F.col(C.VERBA)))


def engineer_features(adjusted: DataFrame, params: Params, means: DataFrame | None = None) -> DataFrame:
    """Model features of all modelled rows; group means come from the training rows."""
    rows = prepare_rows(modelled_rows(assign_split(adjusted, params)), params)
    if means is None:
        means = fit_group_means(rows.where(F.col(C.SPLIT) == "train"), params)
    return group_mean_feature(rows, means, params).select(*FEATURE_COLUMNS)


def train_rows_per_category(features: DataFrame) -> DataFrame:
    is_train = (F.col(C.SPLIT) == "train").cast("bigint")
    return features.groupBy(C.CATEGORY_KEY).agg(F.sum(is_train).alias("n_train"))


def eligible_categories(features: DataFrame, params: Params) -> DataFrame:
    """Categories with enough training rows."""
    return train_rows_per_category(features).where(F.col("n_train") >= params.min_rows_train)


def skipped_categories(features: DataFrame, params: Params) -> DataFrame:
    """Categories left out for too few training rows."""
    counts = train_rows_per_category(features)
    return counts.where((F.col("n_train") > 0) & (F.col("n_train") < params.min_rows_train))
