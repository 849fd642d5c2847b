"""Profiles that grow: one mergeable summary per part of a table (a year, say) and column.

Counts, moments and extremes merge exactly; distinct values by HyperLogLog, quantiles by KLL and the values that are new
in a part by theta sketches. A year that arrives or is corrected is summarised alone, and every profile over years or
groups is merged from the summaries, whose number does not depend on the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spendguard import columns as C
from spendguard.scratch import materialise
from spendguard.sources.sets import read_set, write_set

_TABLE = "summaries"
_NUMERIC = ("int", "bigint", "double", "float", "smallint", "tinyint")
QUANTILES = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}


def _summary(column: str, kind: str, hll: int, kll: int, theta: int) -> Column:
    value = F.col(column)
    number = value.cast("double") if kind in _NUMERIC or kind.startswith("decimal") else F.lit(None).cast("double")
    if kind in ("double", "float"):
        value = F.when(~F.isnan(value), value)
        number = F.when(~F.isnan(number), number)
    text = value.cast("string")
    item = F.when(text.isNotNull(), F.xxhash64(text))  # the sketches pass over empty strings
    return F.struct(
        F.lit(column).alias("column"),
        F.lit(kind).alias("type"),
        F.count(F.lit(1)).alias("n"),
        F.count(text).alias("n_values"),
        F.count(number).alias("n_numbers"),
        F.avg(number).alias("mean"),
        (F.var_pop(number) * F.count(number)).alias("squares"),
        F.min(number).alias("min"),
        F.max(number).alias("max"),
        F.hll_sketch_agg(item, hll).alias("distinct"),
        F.theta_sketch_agg(item, theta).alias("members"),
        F.kll_sketch_agg_double(number, F.lit(kll)).alias("order"),
    )


def summarise(
    df: DataFrame,
    part: str = C.YEAR,
    keys: Sequence[str] = (),
    columns: Sequence[str] | None = None,
    hll: int = 14,
    kll: int = 1600,
    theta: int = 14,
) -> DataFrame:
    """One row per value of `part` (as text, `part`), group (`keys`) and column, from one pass over the table.

    Without `columns`, all but `part` and `keys`. Null is a part and a group of its own; NaN counts as null. A sketch is
    bounded in size: 2^hll registers, some multiples of `kll` numbers and 2^theta hashes. Up to 2^theta values the
    theta sketch is exact. The relative error of a distinct count is about 1.04 / 2^(hll/2), the error of a
    quantile's rank with the default `kll` about 0.2 % of the rows. An empty table has no parts and no rows.
    """
    keys = list(keys)
    kinds = dict(df.dtypes)
    names = [c for c in df.columns if c != part and c not in keys] if columns is None else list(columns)
    rows = df.select(F.col(part).cast("string").alias("_part"), *[F.col(c).alias(f"_key_{c}") for c in keys], *dict.fromkeys(names))
    found = rows.groupBy("_part", *[f"_key_{c}" for c in keys]).agg(
        F.array(*[_summary(c, kinds[c], hll, kll, theta) for c in names]).alias("_all")
    )
    return found.select(
        F.col("_part").alias("part"), *[F.col(f"_key_{c}").alias(c) for c in keys], F.explode("_all").alias("_one")
    ).select("part", *keys, "_one.*")


def merge_summaries(summaries: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A profile per column and group of `keys` (columns of the summaries; `part` is one): type, n, n_null, n_distinct,
    mean, std, min, max and quantiles.

    Deviations merge around the common mean, so no digits are lost to large sums. Columns without numbers have null
    statistics. `n_distinct` and the quantiles are estimates; quantiles are values that occur, and as KLL draws at random, a rerun may give a neighbouring one.
    """
    by = [*keys, "column", "type"]
    over = Window.partitionBy(*by)
    weighted = F.col("n_numbers") * F.coalesce("mean", F.lit(0.0))
    centred = summaries.withColumn("_mean", F.sum(weighted).over(over) / F.nullif(F.sum("n_numbers").over(over), F.lit(0)))
    apart = F.col("squares") + F.col("n_numbers") * F.pow(F.col("mean") - F.col("_mean"), 2)
    merged = centred.groupBy(*by).agg(
        F.sum("n").alias("n"),
        (F.sum("n") - F.sum("n_values")).alias("n_null"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("n_distinct"),
        F.first("_mean").alias("mean"),
        F.sum(apart).alias("_squares"),
        F.sum("n_numbers").alias("_numbers"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.kll_merge_agg_double("order").alias("_order"),
    )
    probs = F.array(*map(F.lit, QUANTILES.values()))
    at = F.when(F.col("_numbers") > 0, F.kll_sketch_get_quantile_double("_order", probs))
    std = F.when(F.col("_numbers") > 1, F.sqrt(F.col("_squares") / (F.col("_numbers") - 1)))
    return merged.withColumn("_at", at).select(
        *by, "n", "n_null", "n_distinct", "mean", std.alias("std"), "min", "max",
        *[F.col("_at")[i].alias(name) for i, name in enumerate(QUANTILES)],
    )


def new_values(summaries: DataFrame, keys: Sequence[str] = (), theta: int = 14) -> DataFrame:
    """Per column, group of `keys` and part, in the order of the parts: n_distinct, n_new (values that no earlier part
    has), n_gone (values of the part before that this one lacks) and n_seen (values up to this part).

    Exact while all values seen fit a theta sketch, estimates beyond. The first part's values are all new, null parts
    come first. Numbers as parts are ordered as numbers.
    """
    by = [*keys, "column"]
    parts = summaries.groupBy(*by, "part").agg(F.theta_union_agg("members", theta).alias("_here"))
    order = Window.partitionBy(*by).orderBy(F.expr("try_cast(part as double)"), "part")
    earlier = F.theta_union_agg("_here", theta).over(order.rowsBetween(Window.unboundedPreceding, -1))
    seen = F.theta_union_agg("_here", theta).over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = parts.withColumns({"_earlier": earlier, "_seen": seen, "_before": F.lag("_here").over(order)})
    size = F.theta_sketch_estimate
    gone = F.when(F.col("_before").isNotNull(), size(F.theta_difference("_before", "_here"))).otherwise(F.lit(0))
    return rows.select(
        *by, "part", size("_here").alias("n_distinct"), size(F.theta_difference("_here", "_earlier")).alias("n_new"),
        gone.cast("long").alias("n_gone"), size("_seen").alias("n_seen"),
    )


def store_summaries(summaries: DataFrame, path: str) -> str:
    """Put the parts of `summaries` in the place of those stored under `path`; other parts stay as they are.

    The summaries are a versioned set owned by part: readers see all parts of a call or none. A part that has no rows
    any more is not known here; rewrite the whole set for that. Null parts are an error, as nothing could replace them.
    """
    named = F.coalesce("part", F.raise_error(F.lit("a summary without a part cannot be stored")).cast("string"))
    rows = materialise(summaries.withColumn(C.CATEGORY_KEY, named), _TABLE)  # the table is read once
    return write_set({_TABLE: rows}, path, covered=rows.select(C.CATEGORY_KEY))


def stored_summaries(spark: SparkSession, path: str) -> DataFrame:
    """The summaries stored under `path`; an error if there are none."""
    tables = read_set(spark, path)
    if _TABLE not in tables:
        raise FileNotFoundError(f"no summaries under {path}")
    return tables[_TABLE].drop(C.CATEGORY_KEY)
