"""Streaming queries, run to the end of the given files."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import HEAVY_AMOUNT, ORDERS_CTE, key_sql, orders, price_index, query, table
from checks.detectors import full_run
from spendguard import columns as C
from spendguard.plans.score import score_records
from spendguard.scratch import scratch_path
from spendguard.sources import as_expenses
from spendguard.streaming import score_stream, temporal_metrics_stream


def _stream(spark, sf_dir, name):
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query(
    "windowed_flag_counts",
    """WITH e AS (SELECT event_type AS category, time_bucket(INTERVAL '1 day', ts) AS window_start, CAST(value > 20 AS INTEGER) AS flag, ts FROM events)
    SELECT window_start, window_start + INTERVAL '1 day' AS window_end, category, count(*) AS n_records, sum(flag)::BIGINT AS n_flagged,
    round(100 * sum(flag) / count(*), 6) AS flagged_pct FROM e GROUP BY ALL
    HAVING window_start + INTERVAL '1 day' <= (SELECT max(ts) FROM e) - INTERVAL '1 hour'""",
)
def windowed_flag_counts(spark, sf_dir):
    """Daily flag counts per event type; windows still open at the end of the input are not emitted."""
    rows = _stream(spark, sf_dir, "events").withColumns(
        {"at": F.col("ts").cast("timestamp"), "flag": (F.col("value") > 20).cast("int")}
    )
    counts = temporal_metrics_stream(rows, "at", "event_type", "flag")
    out = scratch_path(spark, "windowed_counts")
    job = (
        counts.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", scratch_path(spark, "windowed_counts_state"))
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    found = spark.read.schema(counts.schema).parquet(out)
    return found.withColumns(
        {
            "window_start": F.col("window_start").cast("timestamp_ntz"),
            "window_end": F.col("window_end").cast("timestamp_ntz"),
            "flagged_pct": F.round("flagged_pct", 6),
        }
    )


@query(
    "scored_stream",
    f"""WITH {ORDERS_CTE} SELECT {key_sql('verba')} AS category_key, count(*) AS n_records, 0::BIGINT AS n_different FROM adj GROUP BY ALL""",
)
def scored_stream(spark, sf_dir):
    """All orders scored as a stream with the models of the batch run, against the same rows scored as a batch."""
    models = full_run(spark, sf_dir).models
    rows = _stream(spark, sf_dir, "orders")
    records = as_expenses(
        rows, F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_custkey"), F.expr(HEAVY_AMOUNT), F.col("o_orderdate"),
        F.col("o_orderstatus"),
    ).drop("is_reversal", "year")
    out = scratch_path(spark, "scored_stream")
    job = (
        score_stream(records, price_index(spark), models["group_means"], models, out, scratch_path(spark, "scored_stream_state"))
        .trigger(availableNow=True)
        .start()
    )
    job.awaitTermination()
    columns = [C.CATEGORY_KEY, C.RECORD_ID, "ensemble_flag", "ensemble_score"]
    batch = score_records(orders(spark, sf_dir).drop("is_reversal", "year"), price_index(spark), models["group_means"], models)
    both = spark.read.parquet(out).select(*columns).join(
        batch.select(*columns[:2], F.col("ensemble_flag").alias("_flag"), F.col("ensemble_score").alias("_score")), columns[:2], "full"
    )
    same = (F.col("ensemble_flag") == F.col("_flag")) & (F.abs(F.col("ensemble_score") - F.col("_score")) < 1e-9)
    return both.groupBy(C.CATEGORY_KEY).agg(
        F.count("*").alias("n_records"), F.count_if(~F.coalesce(same, F.lit(False))).alias("n_different")
    )
