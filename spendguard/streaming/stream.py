"""Scoring and counting over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from spendguard import columns as C
from spendguard.plans.fit import Models
from spendguard.plans.score import score_records
from spendguard.scratch import scope


def score_stream(
    records: DataFrame, index: DataFrame, means: DataFrame, models: Models, path: str, checkpoint: str
) -> DataStreamWriter:
    """Score every micro-batch with frozen models and write it to `path`.

    The models never change, so batches are independent; a batch that is retried replaces its own
    folder, so every record appears once. Its barrier tables are deleted at its end.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with scope(batch.sparkSession):
            scored = score_records(batch, index, means, models)
            scored.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return records.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def temporal_metrics_stream(
    records: DataFrame,
    event_time: str,
    category: str = C.CATEGORY_KEY,
    flag: str = "ensemble_flag",
    window: str = "1 day",
    delay: str = "1 hour",
) -> DataFrame:
    """Records, flagged records and rate per category and event-time window.

    Records later than `delay` are dropped; state is one row per open window and category.
    """
    counted = (
        records.withWatermark(event_time, delay)
        .groupBy(F.window(event_time, window), F.col(category).alias("category"))
        .agg(F.count(F.lit(1)).alias("n_records"), F.sum(flag).cast("bigint").alias("n_flagged"))
    )
    return counted.select(
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "category",
        "n_records",
        "n_flagged",
        (100 * F.col("n_flagged") / F.greatest("n_records", F.lit(1))).alias("flagged_pct"),
    )
