"""Apply a bounded per-category model table to rows of any number."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.scratch import materialise, session_conf, spread

MODEL_BYTES_LIMIT = 64 << 20
CHUNK_ROWS = 50_000


def map_with_model(
    rows: DataFrame,
    model: DataFrame,
    fn: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame],
    schema: str,
    row_bytes: int,
    bytes_limit: int = MODEL_BYTES_LIMIT,
    chunk_rows: int = CHUNK_ROWS,
    combine: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame] | None = None,
    laid_out: bool = False,
    held_categories: int | None = None,
) -> DataFrame:
    """Run `fn(rows, model rows)` for each category; categories without a model give no rows.

    When the whole model (`row_bytes` × its rows) is below the limit it is sent to every executor once
    and the rows are not shuffled.  Otherwise the rows are cut into chunks of about `chunk_rows` per
    category and each chunk meets only the model rows of its own category.

    With `combine`, the results of one category are merged inside each task before they leave it;
    a task that holds `held_categories` of them passes them on, and later rows give further results.
    `laid_out` says that the caller has already partitioned the rows for the work.
    """
    spark = rows.sparkSession
    # One job reads the model, or one row more than the limit allows.
    most = bytes_limit // max(row_bytes, 1)
    with session_conf(spark, spark__sql__execution__arrow__pyspark__enabled="true"):
        table = model.limit(min(most + 1, (1 << 31) - 1)).toPandas()
    if len(table) <= most:
        parts = dict(list(table.groupby(C.CATEGORY_KEY, sort=False)))
        shared = spark.sparkContext.broadcast(parts)

        def per_batch(batches):
            held: dict[str, pd.DataFrame] = {}
            for batch in batches:
                for key, part in batch.groupby(C.CATEGORY_KEY, sort=False):
                    if key not in shared.value:
                        continue
                    out = fn(part, shared.value[key])
                    if combine is None:
                        yield out
                    else:
                        if key not in held and held_categories and len(held) >= held_categories:
                            yield from held.values()
                            held.clear()
                        held[key] = combine(held[key], out) if key in held else out
            yield from held.values()

        return (rows if laid_out else spread(rows)).mapInPandas(per_batch, schema)

    sizes = rows.groupBy(C.CATEGORY_KEY).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).cast("int").alias("_chunks"))
    sizes = materialise(sizes, "chunks")
    chunk = F.pmod(F.xxhash64(C.RECORD_ID), F.col("_chunks")).cast("int")
    left = rows.join(sizes, C.CATEGORY_KEY).withColumn("_chunk", chunk).drop("_chunks")
    right = model.join(sizes, C.CATEGORY_KEY).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    )

    def per_chunk(left_part, right_part):
        if left_part.empty or right_part.empty:
            return pd.DataFrame({name: [] for name in names})
        return fn(left_part.drop(columns="_chunk"), right_part.drop(columns=["_chunk", "_chunks"]))

    names = [field.split()[0] for field in schema.split(",")]
    return (
        left.groupBy(C.CATEGORY_KEY, "_chunk")
        .cogroup(right.groupBy(C.CATEGORY_KEY, "_chunk"))
        .applyInPandas(per_chunk, schema)
    )
