"""Result tables: flagged records, metrics, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.scratch import materialise
from spendguard.sources.layers import clear_categories
from spendguard.sources.sets import read_set, write_set


def write_results(flagged: DataFrame, path: str, format: str = "parquet", covered: DataFrame | None = None) -> None:
    """Flagged records as a new version of the results; an earlier run's flags never linger.

    `covered` lists the run's categories (`category_key`): flags of other categories stay, those of covered ones are
    replaced, to none if it has none. Without it the whole result is replaced. Other formats than Parquet are written
    as plain files, one folder per category.
    """
    if format == "parquet":
        write_set({"flagged": flagged}, path, covered)
        return
    if covered is not None:
        flagged = materialise(flagged, "flagged")
        clear_categories(covered, path)
    writer = flagged.write.mode("overwrite").option("header", True)
    if covered is not None:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(C.CATEGORY_KEY).format(format).save(path)


def write_run(done, path: str) -> None:
    """Flagged records and metrics of a `Run` as one set that owns exactly the run's categories."""
    metrics = done.metrics.withColumn(C.CATEGORY_KEY, F.col("category"))
    write_set({"flagged": done.flagged, "metrics": metrics}, path, covered=metrics.select(C.CATEGORY_KEY))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Flagged records of all categories; `category` repeats the key, always as text."""
    found = read_set(spark, path)
    if "flagged" not in found:
        raise FileNotFoundError(f"no results below {path}")
    return found["flagged"].where(F.col("ensemble_flag") == 1).withColumn("category", F.col(C.CATEGORY_KEY))


def write_metrics(metrics: DataFrame, path: str, covered: DataFrame | None = None) -> None:
    """One JSON document per category; `covered` as in `write_results`."""
    if covered is not None:
        metrics = materialise(metrics, "metrics")
        clear_categories(covered, path)
    (
        metrics.withColumn(C.CATEGORY_KEY, F.col("category"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(C.CATEGORY_KEY)
        .json(path)
    )


def write_ranking(document: DataFrame, path: str) -> None:
    """The ranking document as JSON."""
    document.write.mode("overwrite").json(path)
