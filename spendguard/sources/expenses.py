"""Reading expense files and price-index tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spendguard import columns as C
from spendguard.sources.quoted import read_records

RAW_COLUMNS = ("Verba", "Descrição", "Conta", "Favorecido", "Trecho", "Vencimento", "Valor")
_CORRUPT = "_corrupt_record"
_COPIES = 100_000


def _field_count(line: Column, sep: str) -> Column:
    """Number of fields of a raw CSV line; separators inside double quotes do not count."""
    unquoted = F.regexp_replace(line, '"[^"]*"', "")
    return F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit(""))) + 1


def read_expenses(
    spark: SparkSession,
    path: str,
    sep: str = ";",
    encoding: str = "ISO-8859-1",
    columns: tuple[str, ...] = RAW_COLUMNS,
    with_ids: bool = True,
    year_pattern: str = r"_(\d{4})\.csv",
    line_breaks: bool = False,
) -> DataFrame:
    """Read yearly delimited files as text columns, with `year` taken from the file path.

    Rows with too many fields are skipped and short rows are padded with null.  `record_id` is a hash
    of file, columns and duplicate number, so it is the same in every run.

    With `line_breaks`, quoted fields may hold line breaks and doubled quotes; files are still read in splits.
    """
    if line_breaks:
        fields = F.from_csv("_record", ", ".join(f"`{c}` string" for c in columns), {"sep": sep, "escape": '"'})
        records = read_records(spark, path, sep, encoding).where(_record_fields(F.col("_record"), sep) <= len(columns))
        rows = records.select("_file", fields.alias("_fields")).select("_file", "_fields.*")
    else:
        rows = _line_records(spark, path, sep, encoding, columns)
    rows = rows.withColumn(C.YEAR, F.regexp_extract("_file", year_pattern, 1).try_cast("int"))
    if not with_ids:
        return rows.drop("_file")
    return _with_ids(rows, columns)


def _record_fields(record: Column, sep: str) -> Column:
    """Number of fields of a record; quotes count only where they open a field, and doubled ones are text."""
    mark = re.escape(sep)
    led = F.concat(F.lit(sep), F.replace(record, F.lit('""'), F.lit("")))
    return F.regexp_count(led, F.lit(f'{mark}(?:"[^"]*+"[^{mark}]*+|[^{mark}]*+)'))


def _line_records(spark: SparkSession, path: str, sep: str, encoding: str, columns: tuple[str, ...]) -> DataFrame:
    """Fields and `_file` of every line but the too long ones."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, _CORRUPT)])
    raw = (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("header", True)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)  # field counts must not depend on the columns a query reads
        .option("columnNameOfCorruptRecord", _CORRUPT)
        .csv(path)
        .withColumn("_file", F.col("_metadata.file_path"))
    )
    # Spark refuses queries that need the corrupt text alone, so the test also touches a data column.
    touched = F.length(F.coalesce(F.col(columns[0]), F.lit(""))) >= 0
    too_long = F.coalesce(_field_count(F.col(_CORRUPT), sep) > len(columns), F.lit(False)) & touched
    return raw.where(~too_long).drop(_CORRUPT)


def _with_ids(rows: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Add `record_id`, a hash of the row and its copy number.

    Copies are counted, not sorted, and then written out again; a row with very many copies is first cut
    into numbered chunks that are dealt out over the tasks.
    """
    counted = rows.groupBy("_file", *columns, C.YEAR).agg(F.count(F.lit(1)).alias("_n"))
    few = counted.where(F.col("_n") <= _COPIES).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    chunk = F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / _COPIES)))
    first, last = F.col("_chunk") * _COPIES + 1, F.least((F.col("_chunk") + 1) * _COPIES, F.col("_n"))
    many = (
        counted.where(F.col("_n") > _COPIES)
        .withColumn("_chunk", chunk)
        .repartition("_chunk", *columns)
        .withColumn("_copy", F.explode(F.sequence(first, last)))
        .drop("_chunk")
    )
    return few.unionByName(many).select(
        # The hash passes over nulls, so their places are hashed too.
        F.xxhash64("_file", *columns, F.array(*[F.col(c).isNull() for c in columns]), "_copy").alias(C.RECORD_ID),
        *columns, C.YEAR,
    )


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Price index: `year`, `ipca_correction_factor`."""
    schema = "year INT, ipca_correction_factor DOUBLE"
    return spark.read.schema(schema).option("header", True).csv(path)


def as_expenses(
    df: DataFrame,
    record_id: Column,
    verba: Column,
    conta: Column,
    valor: Column,
    vencimento: Column,
    favorecido: Column | None = None,
    descricao: Column | None = None,
    year: Column | None = None,
    is_reversal: Column | None = None,
) -> DataFrame:
    """Give any fact table the canonical columns of an expense table."""
    absent = F.lit(None).cast("string")
    return df.select(
        record_id.cast("bigint").alias(C.RECORD_ID),
        verba.cast("string").alias(C.VERBA),
        (absent if descricao is None else descricao.cast("string")).alias(C.DESCRICAO),
        conta.cast("string").alias(C.CONTA),
        (absent if favorecido is None else favorecido.cast("string")).alias(C.FAVORECIDO),
        vencimento.cast("timestamp").alias(C.VENCIMENTO),
        valor.cast("double").alias(C.VALOR),
        (F.year(vencimento) if year is None else year).cast("int").alias(C.YEAR),
        (valor.cast("double") < 0 if is_reversal is None else is_reversal).alias(C.IS_REVERSAL),
    )
