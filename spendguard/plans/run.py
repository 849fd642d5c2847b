"""The whole job: features, fit, predict, explain, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.detectors.space import Space, apply_scaler
from spendguard.functions.text import category_key
from spendguard.operators.explain import explain, top_features
from spendguard.operators.features import (
    adjust_amount,
    assign_split,
    engineer_features,
    fit_group_means,
    modelled_rows,
    prepare_rows,
    reversal_rows,
)
from spendguard.operators.metrics import category_metrics, temporal_metrics
from spendguard.operators.profile import reversal_summary
from spendguard.operators.rank import flagged_only, flagged_records
from spendguard.params import Params
from spendguard.plans.fit import Models, fit
from spendguard.plans.score import predict
from spendguard.scratch import materialise


@dataclass
class Run:
    """Tables produced by a run."""

    models: Models
    features: DataFrame
    predictions: DataFrame
    attributions: DataFrame | None
    flagged: DataFrame
    metrics: DataFrame
    temporal: DataFrame
    reversals: DataFrame


def run(
    expenses: DataFrame,
    index: DataFrame,
    params: Params,
    category: str | None = None,
    years: tuple[int, int] | None = None,
    models: Models | None = None,
    force: bool = False,
) -> Run:
    """Run everything for all categories, or for one.

    `years` narrows the train and test years.  Categories found in `models` are scored with those
    tables; only the others are fitted, unless `force` is set.
    """
    if years is not None:
        params = params.for_year_range(*years)
    adjusted = assign_split(adjust_amount(expenses, index), params)
    if category is not None:
        keyed = adjusted.withColumn("_key", category_key(F.col(C.VERBA)))
        wanted = keyed.where(F.col("_key") == category.upper()).drop("_key")
        if wanted.isEmpty():
            keys = keyed.where("_key is not null").select("_key").distinct()
            shown = [r[0] for r in keys.orderBy("_key").limit(100).collect()]
            more = keys.count() - len(shown)
            raise ValueError(
                f"category {category!r} not found; available: {', '.join(shown)}{f' and {more} more' if more else ''}"
            )
        adjusted = wanted
    train_rows = prepare_rows(modelled_rows(adjusted), params).where(F.col(C.SPLIT) == "train")
    means = fit_group_means(train_rows, params)
    features = materialise(engineer_features(adjusted, params, means), "features")
    fitted = _fit_missing(features, params, models, force)
    fitted.tables["group_means"] = means
    scored = features.where(F.col(C.SPLIT).isin("test", "infer"))
    predictions = materialise(predict(scored, fitted), "predictions")
    attributions = top = None
    if fitted.has("iforest"):
        flagged = flagged_only(predictions)
        points = apply_scaler(flagged, fitted["scaler"], fitted["buckets"], fitted.space)
        attributions = materialise(
            explain(flagged, points, fitted["iforest"], fitted["buckets"], params, fitted.space), "attributions"
        )
        top = top_features(attributions)
    return Run(
        models=fitted,
        features=features,
        predictions=predictions,
        attributions=attributions,
        flagged=flagged_records(predictions, top),
        metrics=category_metrics(predictions, fitted["contamination"], params.active_detectors()),
        temporal=temporal_metrics(predictions, params.temporal_trend_start_year, params.temporal_trend_end_year),
        reversals=reversal_summary(reversal_rows(adjusted)),
    )


def _fit_missing(features: DataFrame, params: Params, models: Models | None, force: bool) -> Models:
    """Fit the categories that `models` lacks and append their rows to its tables."""
    if models is None or force:
        return fit(features, params)
    known = materialise(models.registry().select(C.CATEGORY_KEY), "known_models")
    wanted = features.where(F.col(C.SPLIT) == "train").select(C.CATEGORY_KEY).distinct()
    if wanted.join(known, C.CATEGORY_KEY, "left_anti").isEmpty():
        return Models(params, Space.of(params), dict(models.tables))
    new = fit(features, params, force=False, known=known)
    tables = dict(models.tables)
    for name, table in new.tables.items():
        tables[name] = tables[name].unionByName(table, allowMissingColumns=True) if name in tables else table
    return Models(params, new.space, tables)
