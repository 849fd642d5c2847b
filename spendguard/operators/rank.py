"""Materiality-weighted rankings of flagged records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.functions.scores import audit_score
from spendguard.functions.text import format_brl
from spendguard.scratch import materialise


def with_audit_score(df: DataFrame, relative: bool = False) -> DataFrame:
    """`audit_score`; with `relative`, also its share of the largest score (at most 1)."""
    scored = df.withColumn("audit_score", audit_score(F.col("ensemble_score"), F.col(C.VALOR_ADJUSTED)))
    if not relative:
        return scored
    largest = scored.agg(F.max("audit_score")).scalar()
    whole = F.when(largest > 0, largest).otherwise(F.lit(1.0))
    return scored.withColumn("audit_score_relative", F.least(F.col("audit_score") / whole, F.lit(1.0)))


def distributed_rank(df: DataFrame, name: str, order: Sequence[Column], group: Sequence[str] = ()) -> DataFrame:
    """`row_number` over a group of any size, or over the whole table when `group` is empty.

    The rows are range-partitioned in rank order, numbered inside each partition, and shifted by the
    number of rows of their group in earlier partitions.  `order` must end in a unique column.
    """
    group = list(group)
    sort = [*[F.col(g) for g in group], *order]
    ranged = materialise(df.repartitionByRange(*sort).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_size"))
    # One row per partition and group: small whatever the data size.
    earlier = Window.partitionBy(*(group or [F.lit(1)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.withColumn("_shift", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    shift = materialise(shift, "rank_shift")
    inside = Window.partitionBy("_part", *group).orderBy(*order)
    return (
        ranged.join(shift, ["_part", *group])
        .withColumn(name, (F.row_number().over(inside) + F.col("_shift")).cast("bigint"))
        .drop("_part", "_shift")
    )


def flagged_only(predictions: DataFrame) -> DataFrame:
    return predictions.where(F.col("ensemble_flag") == 1)


def rank_anomalies(flagged: DataFrame, global_rank: bool = True) -> DataFrame:
    """Ranks of flagged records by audit score, in the category and overall, and by ensemble score."""
    by_audit = [F.col("audit_score").desc(), F.col(C.RECORD_ID).asc()]
    by_score = [F.col("ensemble_score").desc(), F.col(C.RECORD_ID).asc()]
    ranked = distributed_rank(with_audit_score(flagged), "category_rank", by_audit, [C.CATEGORY_KEY])
    ranked = distributed_rank(ranked, "category_rank_by_score", by_score, [C.CATEGORY_KEY])
    return distributed_rank(ranked, "global_rank", by_audit) if global_rank else ranked


def display_record(df: DataFrame, rank: str) -> DataFrame:
    """The columns of a ranking record."""
    optional = {
        "top_feature": F.lit(""), "top_shap_value": F.lit(0.0), "explanation": F.lit(""), "category_rank": F.lit(1),
        "category_rank_by_score": F.lit(1), "month": F.lit(0), "mean_value": F.lit(0.0), C.FAVORECIDO: F.lit(""),
    }
    get = lambda c: F.col(c) if c in df.columns else optional[c]
    return df.select(
        F.col(rank).alias("rank"),
        F.col(C.CATEGORY_KEY).alias("category"),
        C.RECORD_ID,
        C.CONTA,
        get(C.FAVORECIDO).alias(C.FAVORECIDO),
        F.round(C.VALOR_ADJUSTED, 2).alias(C.VALOR_ADJUSTED),
        format_brl(F.col(C.VALOR_ADJUSTED)).alias("valor_brl"),
        C.YEAR,
        get("month").alias("month"),
        F.round("ensemble_score", 6).alias("ensemble_score"),
        F.round("audit_score", 6).alias("audit_score"),
        get("top_feature").alias("top_feature"),
        F.round(get("top_shap_value"), 6).alias("top_shap_value"),
        F.round(get("mean_value"), 2).alias("mean_value"),
        format_brl(get("mean_value")).alias("mean_value_brl"),
        get("explanation").alias("explanation"),
        get("category_rank").alias("category_rank"),
        get("category_rank_by_score").alias("category_rank_by_score"),
    )


def top_per_category(flagged: DataFrame, k: int = 5) -> DataFrame:
    """The k records with the largest audit score of every category."""
    scored = flagged if "audit_score" in flagged.columns else with_audit_score(flagged)
    order = Window.partitionBy(C.CATEGORY_KEY).orderBy(F.col("audit_score").desc(), C.RECORD_ID)
    return scored.withColumn("category_position", F.row_number().over(order)).where(F.col("category_position") <= k)


def top_global(flagged: DataFrame, n: int = 50) -> DataFrame:
    """The n records with the largest audit score, with their rank."""
    scored = flagged if "audit_score" in flagged.columns else with_audit_score(flagged)
    order = [F.col("audit_score").desc(), F.col(C.RECORD_ID)]
    best = scored.orderBy(*order).limit(n)
    return best.withColumn("global_position", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def ranking_document(flagged: DataFrame, top_n: int = 50, per_category: int = 5) -> DataFrame:
    """One row: time, total, and the top records overall and per category as nested arrays."""
    one = F.lit(1).alias("_one")
    total = flagged.groupBy(one).agg(F.count(F.lit(1)).alias("total_flagged"))
    best = display_record(top_global(flagged, top_n), "global_position")
    each = display_record(top_per_category(flagged, per_category), "category_position")
    top = best.groupBy(one).agg(F.array_sort(F.collect_list(F.struct(*best.columns))).alias("global_top"))
    by_category = (
        each.groupBy("category")
        .agg(F.array_sort(F.collect_list(F.struct(*each.columns))).alias("records"))
        .groupBy(one)
        .agg(F.map_from_entries(F.collect_list(F.struct("category", "records"))).alias("per_category_top"))
    )
    return total.join(top, "_one").join(by_category, "_one").select(
        F.current_timestamp().alias("generated_at"),
        "total_flagged",
        F.lit("audit_score = ensemble_score × log1p(valor_adjusted)").alias("ranking_method"),
        F.lit(top_n).alias("global_top_n"),
        F.lit(per_category).alias("per_category_top_n"),
        "global_top",
        "per_category_top",
    )


def flagged_records(predictions: DataFrame, top: DataFrame | None = None) -> DataFrame:
    """Flagged records with their strongest feature; readable columns first, then scores, then the rest."""
    flagged = flagged_only(predictions)
    if top is not None:
        strongest = top.where(F.col("rank") == 1).select(
            C.CATEGORY_KEY,
            C.RECORD_ID,
            F.col("feature_name").alias("top_feature"),
            F.col("shap_value").alias("top_shap_value"),
        )
        flagged = flagged.join(strongest, [C.CATEGORY_KEY, C.RECORD_ID], "left")
    wanted = (
        C.RECORD_ID, C.CONTA, C.VERBA, C.VALOR_ADJUSTED, C.YEAR, "ensemble_flag", "ensemble_score",
        "top_feature", "top_shap_value",
    )
    front = [c for c in wanted if c in flagged.columns]
    scores = [c for c in flagged.columns if c.startswith(("score_", "anomaly_"))]
    rest = [c for c in flagged.columns if c not in front and c not in scores]
    return flagged.select(*front, *scores, *rest)


def entity_leaderboard(flagged: DataFrame, limit: int | None = None) -> DataFrame:
    """Flags, mean score, total amount and categories per spender, most flags first."""
    board = (
        flagged.where(F.col(C.CONTA).isNotNull())
        .groupBy(C.CONTA)
        .agg(
            F.count("ensemble_score").alias("total_flags"),
            F.avg("ensemble_score").alias("avg_score"),
            F.sum(C.VALOR_ADJUSTED).alias("total_valor"),
            F.array_join(F.array_sort(F.collect_set(C.CATEGORY_KEY)), ", ").alias("categorias"),
        )
        .orderBy(F.col("total_flags").desc(), C.CONTA)
    )
    return board if limit is None else board.limit(limit)


def top_spenders(df: DataFrame, limit: int = 20, amount: str = C.VALOR_ADJUSTED) -> DataFrame:
    return (
        df.where(F.col(C.CONTA).isNotNull())
        .groupBy(C.CONTA)
        .agg(F.sum(amount).alias("total_valor"))
        .orderBy(F.col("total_valor").desc(), C.CONTA)
        .limit(limit)
    )


def explanation_queue(flagged: DataFrame, limit: int | None = None) -> DataFrame:
    """Flagged records without an explanation, largest audit score first."""
    waiting = flagged_only(flagged)
    if "explanation" in flagged.columns:
        waiting = waiting.where(F.coalesce(F.col("explanation"), F.lit("")) == "")
    scored = waiting if "audit_score" in waiting.columns else with_audit_score(waiting)
    ordered = scored.orderBy(F.col("audit_score").desc(), C.RECORD_ID)
    return ordered if limit is None or limit < 0 else ordered.limit(limit)
