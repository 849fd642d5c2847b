"""Parquet layers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from spendguard import columns as C
from spendguard.scratch import delete, materialise


def write_layer(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (C.CATEGORY_KEY,),
    mode: str = "overwrite",
    covered: DataFrame | None = None,
) -> None:
    """Write a layer partitioned by category; only partitions present in `df` are replaced.

    `covered` lists the categories that the run dealt with: those without rows in `df` lose their old rows.
    """
    if covered is not None:
        df = materialise(df, "layer")  # the rows may come from the folders that are cleared
        clear_categories(covered, path)
    (
        df.write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def clear_categories(covered: DataFrame, path: str) -> None:
    """Delete the folders of the listed categories below `path`; their list passes through the driver."""
    spark = covered.sparkSession
    names = [r[0] for r in covered.select(C.CATEGORY_KEY).where(f"{C.CATEGORY_KEY} is not null").distinct().collect()]
    escape = spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    delete(spark, *[f"{path}/{C.CATEGORY_KEY}={escape(str(n))}" for n in names])


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_or_build(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Read the layer when it exists, otherwise build it, save it and read it back."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in (missing.getCondition() or ""):
            raise
    write_layer(build(), path, partition_by)
    return spark.read.parquet(path)
