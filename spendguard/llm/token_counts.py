"""Token counts of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spendguard.llm.bpe import SegmentLengths
from spendguard.llm.memory import slices, tidy
from spendguard.llm.registry import query, table


def count_tokens(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    batch_bytes: int = 2_000_000,
) -> DataFrame:
    """`id_col`, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for every row of `docs`.

    Arrow batches are cut into slices balanced by bytes; long texts are cut at safe boundaries, so no
    text is ever truncated. Only the lengths leave the workers. A null text counts as empty (0 tokens);
    repeated rows are counted each; other columns are ignored, whatever their names.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = SegmentLengths(tokenizer)
        for batch in batches:
            counts: list[int] = []
            for part in slices(batch.column(1), batch_bytes):
                counts += count(part.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["_id", "n_bytes", "n_tokens"]
            )

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    slim = docs.select(
        F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("n_bytes")
    )
    kind = slim.schema["_id"].dataType.simpleString()
    counted = slim.mapInArrow(tidy(lengths), f"_id {kind}, n_bytes long, n_tokens long")
    return counted.select(
        F.col("_id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
