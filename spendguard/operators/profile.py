"""Profiles of an expense table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.operators.quantiles import exact_quantiles, quantile_columns


def value_counts(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Rows per value, most frequent first; null is not a value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    ordered = counts.orderBy(F.col("count").desc(), column)
    return ordered if limit is None else ordered.limit(limit)


def top_values(df: DataFrame, keys: Sequence[str], column: str, k: int) -> DataFrame:
    """The k most frequent values per group as an array of structs (`column`, `count`)."""
    keys = list(keys)
    order = Window.partitionBy(*keys).orderBy(F.col("count").desc(), column)
    ranked = (
        df.where(F.col(column).isNotNull())
        .groupBy(*keys, column)
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= k)
    )
    items = F.array_sort(F.collect_list(F.struct("_r", column, "count")))
    return ranked.groupBy(*keys).agg(
        F.transform(items, lambda s: F.struct(s[column].alias(column), s["count"].alias("count"))).alias(f"top_{column}")
    )


def missing_counterparty() -> Column:
    return F.col(C.FAVORECIDO).isNull() | (F.col(C.FAVORECIDO) == "nan")


def category_profile(df: DataFrame, top_k: int = 5, amount: str = C.VALOR) -> DataFrame:
    """Per category: size, years, amount statistics, missing payees, reversals, top spenders."""
    rows = df.where(F.col(C.VERBA).isNotNull())
    reversal = F.col(C.IS_REVERSAL).cast("int")
    base = rows.groupBy(F.col(C.VERBA).alias("category")).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.count_distinct(C.YEAR).alias("n_years"),
        F.min(C.YEAR).alias("year_min"),
        F.max(C.YEAR).alias("year_max"),
        F.round(F.avg(amount), 2).alias("valor_mean"),
        F.round(F.stddev_samp(amount), 2).alias("valor_std"),
        F.round(F.min(amount), 2).alias("valor_min"),
        F.round(F.max(amount), 2).alias("valor_max"),
        F.round(100 * F.avg(missing_counterparty().cast("int")), 4).alias("null_favorecido_pct"),
        F.sum(reversal).alias("n_reversals"),
        F.round(100 * F.avg(reversal), 4).alias("reversal_rate_pct"),
    )
    renamed = rows.withColumn("category", F.col(C.VERBA))
    medians = quantile_columns(renamed, ["category"], amount, {"valor_median": 0.5})
    top = top_values(renamed, ["category"], C.CONTA, top_k)
    return (
        base.join(medians.withColumn("valor_median", F.round("valor_median", 2)), "category", "left")
        .join(top, "category", "left")
    )


def global_profile(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_distinct(C.VERBA).alias("n_categories"),
        F.min(C.YEAR).alias("year_min"),
        F.max(C.YEAR).alias("year_max"),
        F.count_distinct(C.YEAR).alias("n_years"),
        F.round(100 * F.avg(F.col(C.IS_REVERSAL).cast("int")), 4).alias("overall_reversal_pct"),
        F.round(100 * F.avg(missing_counterparty().cast("int")), 4).alias("overall_null_favorecido_pct"),
    )


def year_drift(df: DataFrame, limit: float = 2.0, amount: str = C.VALOR) -> DataFrame:
    """Years whose mean amount lies more than `limit` deviations from the mean of the yearly means."""
    yearly = (
        df.where(F.col(C.VERBA).isNotNull())
        .groupBy(F.col(C.VERBA).alias("category"), C.YEAR)
        .agg(
            F.avg(amount).alias("mean"), F.stddev_samp(amount).alias("std"), F.count(amount).alias("count")
        )
    )
    over = Window.partitionBy("category")
    spread = F.stddev_samp("mean").over(over)
    z = F.when(spread > 0, (F.col("mean") - F.avg("mean").over(over)) / spread)
    return yearly.withColumn("z_score", z).where(F.abs("z_score") > limit)


def overview(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Rows, year span, distinct spenders and categories."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min(C.YEAR).alias("year_min"),
        F.max(C.YEAR).alias("year_max"),
        distinct(C.CONTA).alias("n_contas"),
        distinct(C.VERBA).alias("n_verbas"),
    )


def records_per_year(df: DataFrame) -> DataFrame:
    """Records per year and split; needs the `split` column."""
    return df.groupBy(C.YEAR, C.SPLIT).agg(F.count(F.lit(1)).alias("n_records"))


def records_per_category(df: DataFrame) -> DataFrame:
    counts = df.where(F.col(C.VERBA).isNotNull()).groupBy(C.VERBA).agg(F.count(F.lit(1)).alias("registros"))
    return counts.orderBy(F.col("registros").desc(), C.VERBA)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct non-null values."""
    return df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column)


def reversal_summary(reversals: DataFrame, top_k: int = 10, amount: str = C.VALOR_ADJUSTED) -> DataFrame:
    """Count and absolute amounts of reversals, per-category counts and the top spenders; one row."""
    size = F.abs(amount)
    totals = reversals.agg(
        F.count(F.lit(1)).alias("total_reversals"),
        F.round(F.sum(size), 2).alias("total_reversal_value_brl"),
        F.round(F.avg(size), 2).alias("mean_reversal_value_brl"),
        F.round(F.max(size), 2).alias("max_reversal_value_brl"),
    ).withColumn("_one", F.lit(1))
    by_verba = (
        value_counts(reversals, C.VERBA)
        .groupBy(F.lit(1).alias("_one"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(C.VERBA, "count")))).alias("by_verba"))
    )
    top = top_values(reversals.withColumn("_one", F.lit(1)), ["_one"], C.CONTA, top_k).withColumnRenamed(
        f"top_{C.CONTA}", "top_parliamentarians"
    )
    return totals.join(by_verba, "_one", "left").join(top, "_one", "left").drop("_one")


def reversals_by_category(reversals: DataFrame, limit: int | None = None) -> DataFrame:
    return value_counts(reversals, C.VERBA, limit)


def column_profile(
    df: DataFrame, drop: Sequence[str] = (C.DESCRICAO, C.TRECHO, C.FAVORECIDO, "valor_raw"), approximate: bool = False
) -> DataFrame:
    """One row per column: type, rows, nulls, distinct values and, for numbers, mean, deviation, quantiles.

    All columns are profiled together: the table is turned into (column, value) pairs once.
    """
    numeric_types = ("int", "bigint", "double", "float", "smallint", "tinyint")
    kept = [(c, t) for c, t in df.dtypes if c not in drop]
    numeric = {c for c, t in kept if t in numeric_types or t.startswith("decimal")}
    pairs = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.lit(t).alias("type"),
                    F.col(c).cast("string").alias("text"),
                    (F.col(c).cast("double") if c in numeric else F.lit(None).cast("double")).alias("number"),
                )
                for c, t in kept
            ]
        )
    )
    long = df.select(pairs.alias("_p")).select("_p.*")
    # One row per distinct value first: partial counts are merged before anything is counted distinct.
    plain = long.groupBy("column", "type").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("text").isNull().cast("bigint")).alias("n_null"),
        F.approx_count_distinct("text").alias("_approx"),
        F.avg("number").alias("mean"),
        F.stddev_samp("number").alias("std"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
    )
    if approximate:
        counted = plain.withColumnRenamed("_approx", "n_distinct")
    else:
        values = long.where(F.col("text").isNotNull()).select("column", "text").distinct()
        exact = values.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
        counted = plain.drop("_approx").join(exact, "column", "left").withColumn(
            "n_distinct", F.coalesce("n_distinct", F.lit(0))
        )
    quartiles = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}
    found = quantile_columns(long.where(F.col("number").isNotNull()), ["column"], "number", quartiles)
    return counted.join(found, "column", "left")


def median_of(df: DataFrame, value: str) -> DataFrame:
    """Exact median of a whole column as one row."""
    return exact_quantiles(df.withColumn("_g", F.lit(1)), ["_g"], value, [0.5]).select(
        F.col("quantile").alias("median")
    )
